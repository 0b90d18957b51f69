import corpus_pipeline
from cases import CLASHES, frame
from pyspark.sql import functions as F
from test_near_duplicates import edited_copies
from test_packing import check
from test_toxicity import FOUL

from beaconloom.session import materialise, scratch_path


def folder_of(lake, docs, labels):
    path = scratch_path(lake, "tables")
    docs.write.parquet(f"{path}/documents.parquet")
    lake.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def planted():
    """Clean documents with near copies among them, toxic ones, and some without a letter; labels for a part."""
    rows = edited_copies()
    rows += [(1000 + i, t + f" {FOUL[i % 4]} {FOUL[(i + 1) % 4]} end{i}") for i, (_, t) in enumerate(rows)]
    labels = [(i, 1, int(i >= 1000)) for i, _ in rows]
    return rows + [(5000, None), (5001, ""), (5002, "12 !?")], labels


def test_stages_one_by_one(lake):
    rows, labels = planted()
    docs = frame(lake, rows)
    folder = folder_of(lake, docs, labels)
    kept = [{i for i, _ in rows}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(lake, docs, folder), name)
        assert out.columns == docs.columns
        docs = out
        kept.append({r.doc_id for r in docs.collect()})
    language, toxicity, near = kept[1:]
    assert kept[0] - language == {5000, 5001, 5002}
    assert language - toxicity == {i for i in language if i >= 1000}
    assert near < toxicity and 30 <= len(near) < 110 and {i for i in range(0, 300, 10)} <= near | {i - i % 10 for i in near}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    packed = corpus_pipeline.STAGES[-1][1](lake, docs, folder).collect()
    assert check(texts, packed, 2048) < 2048
    whole = corpus_pipeline.run(lake, folder).collect()
    assert sorted(map(str, whole)) and {r.doc_id for r in whole} == near
    assert check(texts, whole, 2048) < 2048


def test_columns_come_through_unchanged(lake, odd_rows):
    rows = [*odd_rows, (50, "plain words that stay")]
    docs = frame(lake, rows).withColumn("source", F.lit(None).cast("string"))
    folder = folder_of(lake, docs, [(1, 1, 0), (None, None, None)])
    out = corpus_pipeline.STAGES[0][1](lake, docs, folder)
    assert out.columns == docs.columns and set(CLASHES) < set(out.columns)
    by_id = {r.doc_id: r for r in docs.collect() if r.doc_id not in (6, None)}
    assert all(r == by_id[r.doc_id] for r in out.collect() if r.doc_id in by_id)


def test_empty_tables(lake, empty):
    folder = folder_of(lake, empty, [])
    assert corpus_pipeline.run(lake, folder).collect() == []


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
