"""Spark jobs for real-user web-performance beacons.

Layers, from the bottom up:

* ``functions``  column expressions (no DataFrame in sight)
* ``sources``    readers that produce beacon, range, rule and archive-line DataFrames
* ``operators``  DataFrame -> DataFrame steps (typing, enrichment, latest views, archives)
* ``streaming``  the same operators behind ``readStream`` / ``foreachBatch``
* ``plans``      complete queries, including the ones registered in ``__spark_entry__``
"""
