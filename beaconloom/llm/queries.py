"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconloom.llm import (
    centroids,
    fingerprints,
    language,
    near_duplicates,
    neighbours,
    ngram_scores,
    packing,
    piece_codec,
    shingle_join,
    spelling,
    token_counts,
    token_files,
    toxicity,
)
from beaconloom.llm.common import ship, table
from beaconloom.session import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its function."""

    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        return function(ship(spark), folder)

    QUERIES[function.__name__] = shipped
    return shipped


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = fingerprints.compare_with_edits(table(spark, folder, "documents"))
    return fingerprints.with_neighbours(materialise(compared, "compared"))


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, "word_bpe_49k.json", end=2)
    return token_files.document_digests(token_files.read_token_files(spark, path))


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


@query
def op5_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    done = piece_codec.round_trip(table(spark, folder, "documents"))
    size = F.size("ids").cast("long").alias("n_tokens")
    return done.select("doc_id", "n_bytes", size, "ids", F.col("sha256").alias("decoded_sha256"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.labelled_sample(docs))


@query
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.Index(vectors).search(vectors.where(F.col("vec_id") % neighbours.QUERY_EVERY == 0))


@query
def op8_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = ngram_scores.score_documents(table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


ORACLES["op8_ngram_scores"] = """
WITH words AS (
    SELECT doc_id, w, i FROM (
        SELECT doc_id, unnest(parts) AS w, unnest(range(len(parts))) AS i
        FROM (
            SELECT doc_id, string_split_regex(
                regexp_replace(coalesce(text, ''), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g'), '[ \\t\\n\\v\\f\\r]+'
            ) AS parts
            FROM documents
        )
    ) WHERE w <> ''
),
grams AS (
    SELECT doc_id, i, w AS c, lag(w) OVER d AS b, lag(w, 2) OVER d AS a FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n FROM words),
own1 AS (SELECT doc_id, c, count(*) AS n FROM grams GROUP BY ALL),
own2 AS (SELECT doc_id, b, c, count(*) AS n FROM grams WHERE b IS NOT NULL GROUP BY ALL),
own3 AS (SELECT doc_id, a, b, c, count(*) AS n FROM grams WHERE a IS NOT NULL GROUP BY ALL),
left1 AS (SELECT doc_id, c, sum(n) OVER (PARTITION BY c) - n AS n FROM own1),
left2 AS (SELECT doc_id, b, c, sum(n) OVER (PARTITION BY b, c) - n AS n FROM own2),
left3 AS (SELECT doc_id, a, b, c, sum(n) OVER (PARTITION BY a, b, c) - n AS n FROM own3),
scored AS (
    SELECT g.doc_id,
        CASE
            WHEN c3.n > 0 THEN ln(c3.n) - ln(c2ab.n)
            WHEN c2.n > 0 THEN (CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END) + ln(c2.n) - ln(c1b.n)
            ELSE (CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN g.b IS NULL THEN 0 ELSE ln(0.4) END)
                + ln(greatest(c1.n, 0.5)) - ln(greatest(total.n - sizes.n, 1))
        END AS s
    FROM grams g CROSS JOIN total JOIN sizes USING (doc_id)
    JOIN left1 c1 ON c1.doc_id = g.doc_id AND c1.c = g.c
    LEFT JOIN left1 c1b ON c1b.doc_id = g.doc_id AND c1b.c = g.b
    LEFT JOIN left2 c2 ON c2.doc_id = g.doc_id AND c2.b = g.b AND c2.c = g.c
    LEFT JOIN left2 c2ab ON c2ab.doc_id = g.doc_id AND c2ab.b = g.a AND c2ab.c = g.b
    LEFT JOIN left3 c3 ON c3.doc_id = g.doc_id AND c3.a = g.a AND c3.b = g.b AND c3.c = g.c
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_words, round(coalesce(s.s, 0), 6) AS log_score
FROM documents d LEFT JOIN sizes n USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id) s USING (doc_id)
"""


@query
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


@query
def op12_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.join_documents(table(spark, folder, "documents"))


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def _centroid_sql(rounds: int = 3) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT row, vec_id, v, c, d FROM (
        SELECT w.row, w.vec_id, w.v, c.c, list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM whole w CROSS JOIN c{k} c
    ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
            SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM near{k} CROSS JOIN range(1, 65) t(i) GROUP BY c, i
        ) GROUP BY c
    ) m USING (c)
)""")
    return f"""
WITH whole AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM whole QUALIFY c < 16
),
{", ".join(steps)}
SELECT vec_id, n.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM near{rounds} n JOIN c{rounds} f USING (c)
"""


ORACLES["op11_centroids"] = _centroid_sql()

ORACLES["op12_shingle_join"] = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'
    ), lambda w: w <> '') AS w FROM documents
),
sets AS MATERIALIZED (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    END AS s FROM words
),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON doc_id = a
"""
