"""User-agent rules.

A rule is (kind, rule_no, regex, flags, family, v1, v2, v3, brand).  Within a kind the first match
in ``rule_no`` order wins.  Kinds ``browser``, ``os`` and ``device`` give names and versions; kinds
``bot``, ``desktop``, ``tablet`` and ``mobile`` only say that the agent is one.

``family``, ``brand`` and the versions may refer to groups of the match as ``$1`` .. ``$4``; without
them the family is group 1 and the versions are groups 2, 3 and 4.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FIELDS = ["kind", "rule_no", "regex", "flags", "family", "v1", "v2", "v3", "brand"]
RULE_SCHEMA = T.StructType(
    [T.StructField(f, T.LongType() if f == "rule_no" else T.StringType()) for f in FIELDS]
    + [T.StructField("literals", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("gram", "text")])))]
)

# Characters of a literal that agents and rules are joined on.
GRAM = 3

# A rule file is configuration, and rules are broadcast; refuse what is larger in all.
MAX_RULE_BYTES = 16 << 20

# A small rule set of our own, enough for common browsers.  (kind, regex, family, v1, brand)
DEFAULT_RULES: list[tuple[str, str, str | None, str | None, str | None]] = [
    ("browser", r"([A-Za-z]*[Bb]ot)/([0-9]+)(?:\.([0-9]+))?", None, None, None),
    ("browser", r"Edg(?:e|A|iOS)?/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", "Edge", "$1", None),
    ("browser", r"OPR/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", "Opera", "$1", None),
    ("browser", r"SamsungBrowser/([0-9]+)\.([0-9]+)", "Samsung Internet", "$1", None),
    ("browser", r"CriOS/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", "Chrome Mobile iOS", "$1", None),
    ("browser", r"FxiOS/([0-9]+)\.([0-9]+)", "Firefox iOS", "$1", None),
    (
        "browser",
        r"Android.*Chrome/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?.* Mobile",
        "Chrome Mobile",
        "$1",
        None,
    ),
    ("browser", r"(Chrome)/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", None, None, None),
    ("browser", r"(Firefox)/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", None, None, None),
    (
        "browser",
        r"Version/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?.* Mobile/.*Safari/",
        "Mobile Safari",
        "$1",
        None,
    ),
    ("browser", r"Version/([0-9]+)\.([0-9]+)(?:\.([0-9]+))?.*Safari/", "Safari", "$1", None),
    ("os", r"Windows NT 10\.0", "Windows", "10", None),
    ("os", r"Windows NT 6\.3", "Windows", "8.1", None),
    ("os", r"Windows NT 6\.1", "Windows", "7", None),
    ("os", r"(Android) ([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?", None, None, None),
    (
        "os",
        r"(?:iPhone|CPU) OS ([0-9]+)_([0-9]+)(?:_([0-9]+))? like Mac OS X",
        "iOS",
        "$1",
        None,
    ),
    ("os", r"Mac OS X ([0-9]+)[_.]([0-9]+)(?:[_.]([0-9]+))?", "Mac OS X", "$1", None),
    ("os", r"(Ubuntu)", None, None, None),
    ("os", r"CrOS", "Chrome OS", None, None),
    ("os", r"(Linux)", None, None, None),
    ("device", r"bot/[0-9]", "Spider", None, "Spider"),
    ("device", r"(iPhone)", None, None, "Apple"),
    ("device", r"(iPad)", None, None, "Apple"),
    ("device", r"Macintosh", "Mac", None, "Apple"),
    ("device", r"(SM-[A-Z0-9]+)", "Samsung $1", None, "Samsung"),
    ("device", r"(Pixel [0-9a-z ]+)", None, None, "Google"),
    ("bot", r"[Bb]ot\b|[Cc]rawler|[Ss]pider|HeadlessChrome", None, None, None),
    ("desktop", r"Windows NT|Macintosh|X11|CrOS", None, None, None),
    ("tablet", r"iPad|Tablet", None, None, None),
    ("tablet", r"^(?!.*Mobile).*Android", None, None, None),
    ("mobile", r"iPhone|iPod|Android.*Mobile|Windows Phone", None, None, None),
]


def _letter(name: str, arg) -> str:
    """The lower-case ASCII character that an item of a parse tree stands for, whichever case it allows; ``''`` if none."""
    if name == "LITERAL" and arg < 128:
        return chr(arg).lower()
    if name == "IN" and all(str(op) == "LITERAL" and value < 128 for op, value in arg):
        cases = {chr(value).lower() for _, value in arg}
        return cases.pop() if len(cases) == 1 else ""
    return ""


def _literals(regex: str, ignore_case: bool) -> list[str]:
    """Plain texts in lower case of which every match contains at least one; ``['']`` if none is sure.

    Of the sets of texts that serve, the one whose shortest text is longest: alternatives give one text each.
    """
    parser = re._parser  # the parse tree is the only reliable view of what is optional
    try:
        tree = parser.parse(regex)
    except (re.error, OverflowError):
        return [""]

    def best(items) -> frozenset[str]:
        found: list[frozenset[str]] = []

        def add(run: str) -> None:
            # Letters that have a non-ASCII case partner cannot be trusted when case is ignored.
            found.extend(frozenset([part]) for part in (re.split("[ks]", run) if ignore_case else [run]))

        def walk(items, run: str) -> str:
            for op, arg in items:
                name = str(op)
                letter = _letter(name, arg)
                if letter:
                    run += letter
                elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                    run = walk(arg[3], run)
                else:
                    add(run)
                    run = ""
                    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                        found.append(best(arg[2]))
                    elif name == "BRANCH":
                        found.append(frozenset().union(*[best(branch) for branch in arg[1]]))
            return run

        add(walk(items, ""))
        return max(found, key=lambda texts: (min(map(len, texts)), -len(texts)))

    return sorted(best(tree))


def _with_grams(literals: list[list[str]]) -> list[list[dict]]:
    """To each literal the three of its characters that the fewest literals have, ``''`` for shorter ones."""
    grams = [[{text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} for text in texts] for texts in literals]
    uses = Counter(gram for texts in grams for of_text in texts for gram in of_text)
    rarest = lambda of_text: min(of_text, key=lambda gram: (uses[gram], gram), default="")
    return [
        [{"gram": rarest(of_text), "text": text} for text, of_text in zip(texts, of_texts, strict=True)]
        for texts, of_texts in zip(literals, grams, strict=True)
    ]


def _check_size(total: int) -> None:
    if total > MAX_RULE_BYTES:
        raise ValueError(f"{total} bytes of rules; at most {MAX_RULE_BYTES} can be broadcast")


def make_rules(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rules from dictionaries; fails on the first regular expression that does not compile."""
    literals = _with_grams([_literals(row["regex"], "i" in (row.get("flags") or "")) for row in rows])
    table = [(*[row.get(field) for field in FIELDS], needed) for row, needed in zip(rows, literals, strict=True)]
    _check_size(sum(len(str(value).encode()) for rule in table for value in rule))
    columns = {f.name: list(v) for f, v in zip(RULE_SCHEMA.fields, zip(*table))}
    # An Arrow table of this size becomes a local relation: no job reads it.
    raw = spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(RULE_SCHEMA)), RULE_SCHEMA)
    # Wrapping keeps alternatives together; the empty groups make $1 .. $4 valid for every rule.
    flags = F.when(F.col("flags").contains("i"), F.lit("(?i)")).otherwise(F.lit(""))
    rules = raw.withColumn(
        "pattern", F.concat(flags, F.lit("(?:"), F.col("regex"), F.lit(")()()()()"))
    )
    rules.where("'' rlike pattern").count()
    return rules


def default_rules(spark: SparkSession) -> DataFrame:
    numbers: dict[str, int] = {}
    rows = []
    for kind, regex, family, v1, brand in DEFAULT_RULES:
        numbers[kind] = numbers.get(kind, 0) + 1
        row = {"kind": kind, "rule_no": numbers[kind], "regex": regex, "family": family}
        row |= {"v1": v1, "brand": brand}
        if v1 == "$1":
            row |= {"v2": "$2", "v3": "$3"}
        rows.append(row)
    return make_rules(spark, rows)


# Section and key names of the public rule-file format.
YAML_SECTIONS = {"user_agent_parsers": "browser", "os_parsers": "os", "device_parsers": "device"}
YAML_FIELDS = {
    "browser": {"family_replacement": "family", "v1_replacement": "v1", "v2_replacement": "v2"},
    "os": {
        "os_replacement": "family",
        "os_v1_replacement": "v1",
        "os_v2_replacement": "v2",
        "os_v3_replacement": "v3",
    },
    "device": {"device_replacement": "family", "brand_replacement": "brand"},
}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a YAML rule file, or from a JSON-lines file with the fields of a rule.

    A YAML file has no device-type kinds; those of the default rules are added.
    """
    if not path.endswith((".yaml", ".yml")):
        table = spark.read.schema(T.StructType(RULE_SCHEMA.fields[:-1])).json(path)
        _check_size(table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0] or 0)
        return make_rules(spark, [r.asDict() for r in table.collect()])
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading a YAML rule file needs PyYAML; use JSON lines instead") from error
    text = spark.read.text(path, wholetext=True).head().value
    rows = []
    for section, entries in yaml.safe_load(text).items():
        kind = YAML_SECTIONS[section]
        for number, entry in enumerate(entries, start=1):
            row = {"kind": kind, "rule_no": number, "regex": entry["regex"]}
            row["flags"] = entry.get("regex_flag")
            for key, field in YAML_FIELDS[kind].items():
                row[field] = entry.get(key)
            rows.append(row)
    types = default_rules(spark).where("kind in ('bot', 'desktop', 'tablet', 'mobile')")
    rows += [r.asDict() for r in types.select(*FIELDS).collect()]
    return make_rules(spark, rows)
