"""Joining many rows to a dimension, whatever the size of the dimension and the skew of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 128 * 1024 * 1024
HOT_KEYS = 1000
SPREAD = 4096


def _row_bytes(dim: DataFrame) -> Column:
    sizes = [F.lit(16 * len(dim.columns))]
    for field in dim.schema.fields:
        if isinstance(field.dataType, T.StringType):
            sizes.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
    return sum(sizes[1:], sizes[0])


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: str = "seq",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join of ``rows`` to ``dim`` on ``key``; ``dim.n`` is the number of rows per key.

    ``dim`` is measured first (it should be a written table, so this is one small scan):

    * small enough: it is broadcast and the rows are not shuffled at all;
    * else the keys that hold at least 1/``hot_keys`` of the rows - by that definition no more than
      ``hot_keys`` of them - are broadcast, and the rest is joined by a shuffle.  Rows of hot keys
      and rows without a key take part in that shuffle under a spread-out key that matches nothing,
      so no key, and not the missing one either, ends up in a single task.
    """
    size = dim.agg(
        F.coalesce(F.sum(_row_bytes(dim)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("uses"),
    ).head()
    facts = [c for c in dim.columns if c not in (key, "n")]
    if size["bytes"] <= broadcast_bytes:
        return rows.join(F.broadcast(dim.select(key, *facts)), key, "left")

    share = max(size["uses"] // hot_keys, 1)
    fact_struct = F.struct(*facts)
    hot = dim.where(F.col("n") > share).select(key, fact_struct.alias("_hot"))
    cold = dim.where(F.col("n") <= share).select(F.col(key).alias("_key"), fact_struct.alias("_cold"))
    elsewhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("string"))
    joined = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn(
            "_at", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), elsewhere).otherwise(F.col(key))
        )
        .join(cold, F.col("_at") == F.col("_key"), "left")
    )
    fact = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[fact[c].alias(c) for c in facts])
