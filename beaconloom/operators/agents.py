"""User agent to browser, operating system, device brand and device type."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconloom.functions.texts import not_empty, version_text
from beaconloom.operators.tables import append_log, read_log
from beaconloom.session import materialise
from beaconloom.sources.agent_rules import GRAM

AGENT_FACTS = [
    "browser_name",
    "browser_version",
    "operating_system",
    "operating_system_version",
    "device_manufacturer",
    "device_type",
]
AGENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ["user_agent", *AGENT_FACTS]]
)
NAMING_KINDS = ["browser", "os", "device"]
# In order of priority: an agent that is several of these is the first of them.
TYPE_KINDS = ["bot", "desktop", "tablet", "mobile"]


def distinct_agents(rows: DataFrame) -> DataFrame:
    """Each user agent once, with the number of rows that have it."""
    return (
        rows.where(F.col("user_agent").isNotNull())
        .groupBy("user_agent")
        .agg(F.count("*").alias("n"))
    )


def _filled(template: Column, groups: list[Column]) -> Column:
    """Put the groups of the match in place of $1 .. $4."""
    for number, group in enumerate(groups, start=1):
        template = F.replace(template, F.lit(f"${number}"), group)
    return template


def _facts(kind: str) -> list[Column]:
    """Outputs of the winning rule of a kind, whose columns carry the kind as prefix."""
    rule = lambda name: F.col(f"{kind}_{name}")
    groups = [F.get(F.col(f"{kind}_won.groups"), F.lit(i)) for i in range(4)]
    given = lambda name, group: F.coalesce(_filled(rule(name), groups), group)
    if kind == "device":
        brand = _filled(F.coalesce(rule("brand"), F.lit("")), groups)
        return [not_empty(F.trim(brand)).alias("device_manufacturer")]
    name, version = {
        "browser": ("browser_name", "browser_version"),
        "os": ("operating_system", "operating_system_version"),
    }[kind]
    parts = [given(f"v{i}", groups[i]) for i in range(1, 4)]
    return [
        F.coalesce(given("family", groups[0]), F.lit("Other")).alias(name),
        version_text(*parts).alias(version),
    ]


def candidates(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a user agent and a rule of which the agent contains a literal; one pair without a rule for each agent.

    An index join: a literal is filed under three of its characters, an agent under every three that follow each other, and
    the pairs that meet are tested for the whole literal.  Rules without a literal are filed under ``''``, as is each agent.
    The rules are configuration of a checked size; the join keeps the partitioning of the agents.
    """
    index = rules.select("kind", "rule_no", "pattern", F.explode("literals").alias("literal")).select(
        "kind", "rule_no", "pattern", F.col("literal.gram").alias("gram"), F.col("literal.text").alias("literal")
    )
    following = F.regexp_extract_all("_lower", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    filed = agents.withColumn("_lower", F.lower("user_agent")).withColumn(
        "gram", F.explode(F.array_append(F.array_distinct(following), F.lit("")))
    )
    met = filed.join(F.broadcast(index), "gram", "left")
    return met.where(F.expr("gram = '' or contains(_lower, literal)")).drop("gram", "_lower", "literal")


def classify_agents(agents: DataFrame, rules: DataFrame, tasks: int | None = None) -> DataFrame:
    """Dimension of distinct user agents (``user_agent``, ``n``) by ordered rules.

    Only ``candidates`` meet a regular expression, sorted by rule, so that a task compiles each pattern once and not for every
    pair; the groups of matches are taken there too.  Picking the first rule per kind shuffles nothing, as all of it keeps the
    partitioning of the agents.
    """
    tasks = tasks or agents.sparkSession.sparkContext.defaultParallelism * 4
    # regexp_instr and regexp_extract keep the pattern that they compiled last, which rlike does not do.
    groups = [F.call_function("regexp_extract", F.col("user_agent"), F.col("pattern"), F.lit(i)) for i in range(1, 5)]
    pairs = (
        candidates(agents.repartition(tasks, "user_agent"), rules)
        .sortWithinPartitions("kind", "rule_no")
        .withColumn("hit", F.expr("coalesce(regexp_instr(user_agent, pattern) > 0, false)"))
        .withColumn("groups", F.when(F.col("hit") & F.col("kind").isin(NAMING_KINDS), F.array(*groups)))
    )
    first = lambda kind: F.min(F.when(F.col("hit") & (F.col("kind") == kind), F.struct("rule_no", "groups")))
    # ``first`` depends on the order, so the sort stays.
    won = pairs.groupBy("user_agent").agg(
        F.first("n").alias("n"),
        *[first(kind).alias(f"{kind}_won") for kind in NAMING_KINDS],
        *[F.bool_or(F.col("hit") & (F.col("kind") == kind)).alias(f"is_{kind}") for kind in TYPE_KINDS],
    )
    for kind in NAMING_KINDS:
        outputs = ["family", "v1", "v2", "v3", "brand"]
        of_kind = rules.where(F.col("kind") == kind).select(
            F.col("rule_no").alias(f"{kind}_no"), *[F.col(c).alias(f"{kind}_{c}") for c in outputs]
        )
        won = won.join(F.broadcast(of_kind), F.col(f"{kind}_won.rule_no") == F.col(f"{kind}_no"), "left")
    won = won.select("*", *[fact for kind in NAMING_KINDS for fact in _facts(kind)])
    device_type = F.coalesce(
        *[F.when(F.col(f"is_{kind}"), F.lit(kind)) for kind in TYPE_KINDS], F.lit("unknown")
    )
    return won.select("user_agent", "n", *AGENT_FACTS[:-1], device_type.alias("device_type"))


def _constant(rules: list[dict]) -> Column:
    """Rules as a constant array, in their order."""
    schema = (
        "array<struct<pattern:string,literals:array<struct<text:string>>,"
        "family:string,v1:string,v2:string,v3:string,brand:string>>"
    )
    return F.from_json(F.lit(json.dumps(rules)), schema)


def classify_rows(rows: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the facts of each row's user agent, as stored in ``known`` or, for agents that it lacks, by the rules.

    Neither groups nor sorts, so that a stream can use it; the batch form, which classifies distinct agents, is cheaper for many
    rows.  The rules, of a checked size, are constants of the plan; a pattern is tried only on agents with a literal of it.
    """
    table = rules.select("kind", "pattern", "literals", "family", "v1", "v2", "v3", "brand").orderBy("kind", "rule_no")
    of_kind: dict[str, list[dict]] = {kind: [] for kind in (*NAMING_KINDS, *TYPE_KINDS)}
    for rule in table.toLocalIterator():
        given = rule.asDict(recursive=True)
        of_kind[given.pop("kind")].append(given)

    agent, lower = F.col("user_agent"), F.col("_lower")

    def hit(rule: Column) -> Column:
        likely = F.exists(rule["literals"], lambda literal: F.contains(lower, literal["text"]))
        return likely & (F.call_function("regexp_instr", agent, rule["pattern"]) > 0)

    def first(kind: str) -> Column:
        won = F.slice(F.filter(_constant(of_kind[kind]), hit), 1, 1)
        groups = lambda rule: F.array(*[F.call_function("regexp_extract", agent, rule["pattern"], F.lit(i)) for i in range(1, 5)])
        return F.get(F.transform(won, lambda rule: F.struct(rule.alias("rule"), groups(rule).alias("groups"))), F.lit(0))

    found = [F.when(lower.isNotNull(), first(kind)).alias(f"{kind}_won") for kind in NAMING_KINDS]
    found += [F.coalesce(F.exists(_constant(of_kind[kind]), hit), F.lit(False)).alias(f"is_{kind}") for kind in TYPE_KINDS]
    # Rows without an agent meet nothing: a key of their own keeps them apart if the join shuffles.
    key = F.coalesce("user_agent", F.concat(F.lit("\0"), F.xxhash64("seq").cast("string")))
    stored = known.select(F.col("user_agent").alias("_known"), F.struct(*AGENT_FACTS).alias("_facts"))
    new = F.when(F.col("_known").isNull(), F.lower("user_agent"))
    # Emitted as an array of one, so that later steps do not repeat the matching for each use.
    matched = (
        rows.join(stored, key == F.col("_known"), "left")
        .withColumn("_lower", new)
        .withColumn("_found", F.explode(F.array(F.struct(*found))))
        .select("*", "_found.*")
    )
    for kind in NAMING_KINDS:
        outputs = ["family", "v1", "v2", "v3", "brand"]
        matched = matched.withColumns({f"{kind}_{c}": F.col(f"{kind}_won.rule")[c] for c in outputs})
    device_type = F.coalesce(*[F.when(F.col(f"is_{kind}"), F.lit(kind)) for kind in TYPE_KINDS], F.lit("unknown"))
    ruled = [fact for kind in NAMING_KINDS for fact in _facts(kind)]
    by_rule = F.struct(*ruled, device_type.alias("device_type"))
    facts = F.when(F.col("_known").isNotNull(), F.col("_facts")).when(lower.isNotNull(), by_rule)
    return matched.withColumn("_won", facts).select(*rows.columns, *[F.col(f"_won.{name}").alias(name) for name in AGENT_FACTS])


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The stored dimension, one row per user agent, or no rows before the first batch.

    Two writers that both saw an agent as new have both stored it.
    """
    try:
        stored = read_log(spark, path, AGENT_SCHEMA)
        one = stored.groupBy("user_agent").agg(F.min(F.struct(*AGENT_FACTS)).alias("facts"))
        return one.select("user_agent", "facts.*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AGENT_SCHEMA)


def new_agents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct agents that the dimension does not have yet; only these need classifying."""
    return distinct_agents(rows).join(known.select("user_agent"), "user_agent", "left_anti")


def extend_dimension(
    rows: DataFrame,
    rules: DataFrame,
    path: str,
    batch: str | None = None,
    written: list[str] | None = None,
) -> DataFrame:
    """Classify the agents that the stored dimension lacks, add them, and return the part in use.

    Replaying a batch finds its agents stored already and adds nothing.
    """
    spark = rows.sparkSession
    fresh = new_agents(rows, read_dimension(spark, path))
    append_log(classify_agents(fresh, rules).select(*AGENT_SCHEMA.names), path, batch)
    known = read_dimension(spark, path)
    return materialise(distinct_agents(rows).join(known, "user_agent"), "agents", written)


def with_agent_defaults(rows: DataFrame) -> DataFrame:
    """Values for rows without a user agent."""
    return rows.withColumns(
        {
            "browser_name": F.coalesce("browser_name", F.lit("Other")),
            "operating_system": F.coalesce("operating_system", F.lit("Other")),
            "device_type": F.coalesce("device_type", F.lit("unknown")),
        }
    )
