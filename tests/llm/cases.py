"""Rows and helpers for the tests of the operators."""

import random

#: Names that the operators use for columns of their own.
CLASHES = (
    "nth _n toxic quality score fingerprint edited_fingerprint rank component_id block ahead _key unit ids counts batch bucket shard start n_tokens "
    "held_out predicted lang_pred label fits n_near _kept root node near _table found leaf cell query _kept_id _kept_hash text_hash least form word place kind"
).split()
WORDS = "river stone cloud amber violet harbor lantern meadow copper saddle winter orchard pebble thunder canvas".split()


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", ", the", "."]) for _ in range(words))


def frame(spark, rows, clashes=True):
    """Rows of (doc_id, text) as documents, with further columns whose names clash."""
    docs = spark.createDataFrame(
        [(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    return docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES]) if clashes else docs


def key(row):
    """Rows without an id first."""
    return (row[0] is not None, row[0] if row[0] is not None else 0)


def ordered(df, *more):
    return sorted(df.collect(), key=lambda r: (key((r["doc_id"],)), *(r[c] for c in more)))
