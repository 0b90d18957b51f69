import ipaddress
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from beaconloom.operators import agents, lookups, places
from beaconloom.session import materialise
from beaconloom.sources import agent_rules, ranges


def classified(spark, rules, *texts):
    rows = spark.createDataFrame([(t, 1) for t in texts], "user_agent string, n bigint")
    return {r.user_agent: r for r in agents.classify_agents(rows, rules, tasks=4).collect()}


def test_default_rules(spark, rules):
    windows = "Mozilla/5.0 (Windows NT 10.0; WOW64) AppleWebKit/600.1 Chrome/99.1.2345.6 Safari/600.1"
    phone = "Mozilla/5.0 (iPhone; CPU iPhone OS 15_1_4 like Mac OS X) Version/15.1 Mobile/19A1 Safari/610.2"
    tablet = "Mozilla/5.0 (Linux; Android 12; SM-T870) AppleWebKit/537.36 Chrome/107.0.0.0 Safari/537.36"
    robot = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.example.com/bot.html)"
    found = classified(spark, rules, windows, phone, tablet, robot, "curl/7")
    pick = lambda t, *names: tuple(found[t][n] for n in names)
    assert pick(windows, "browser_name", "browser_version") == ("Chrome", "99.1.2345")
    assert pick(windows, "operating_system", "operating_system_version") == ("Windows", "10")
    assert pick(windows, "device_type", "device_manufacturer") == ("desktop", None)
    assert pick(phone, "device_type", "device_manufacturer") == ("mobile", "Apple")
    assert pick(phone, "operating_system", "operating_system_version") == ("iOS", "15.1.4")
    assert pick(tablet, "device_type", "device_manufacturer") == ("tablet", "Samsung")
    assert pick(robot, "device_type", "browser_name") == ("bot", "Googlebot")
    assert pick("curl/7", "device_type", "browser_name", "operating_system") == ("unknown", "Other", "Other")


def test_first_match_wins_flags_and_groups(spark):
    rules = agent_rules.make_rules(
        spark,
        [
            {"kind": "browser", "rule_no": 2, "regex": r"(Alpha)/(\d+)"},
            {"kind": "browser", "rule_no": 1, "regex": r"beta|alpha/(9)", "flags": "i", "family": "B $1"},
            {"kind": "device", "rule_no": 1, "regex": r"(\w+)-(\w+)", "brand": "$2 by $1"},
            {"kind": "os", "rule_no": 1, "regex": r"(Osx)(?: (\d+))?(?:\.(\d+))?", "v3": "9"},
        ],
    )
    found = classified(spark, rules, "Alpha/7", "Alpha/9", "BETA", "one-two Osx 4", "Osx")
    assert found["Alpha/7"].browser_name == "Alpha" and found["Alpha/7"].browser_version == "7"
    assert found["Alpha/9"].browser_name == "B 9"
    assert found["BETA"].browser_name == "B "
    assert found["one-two Osx 4"].device_manufacturer == "two by one"
    assert found["one-two Osx 4"].operating_system_version == "4.9"
    assert found["Osx"].operating_system_version == "9"


def test_bad_rules_are_refused(spark):
    with pytest.raises(PySparkException):
        agent_rules.make_rules(spark, [{"kind": "os", "rule_no": 1, "regex": "(unclosed"}])
    with pytest.raises(ValueError):
        agent_rules.make_rules(spark, [{"kind": "os", "rule_no": 1, "regex": "x" * (agent_rules.MAX_RULE_BYTES + 1)}])


def test_rule_files(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(
        "user_agent_parsers:\n  - regex: '(Foo)/(\\d+)\\.(\\d+)'\n    family_replacement: 'Foo $1'\n"
        "os_parsers:\n  - regex: 'BarOS'\n    os_replacement: 'Bar'\n    os_v1_replacement: '3'\n"
        "device_parsers:\n  - regex: 'baz (\\w+)'\n    regex_flag: 'i'\n    brand_replacement: '$1'\n"
    )
    found = classified(spark, agent_rules.read_rules(spark, f"{tmp_path}/rules.yaml"), "Foo/1.2 BarOS BAZ qux X11")
    row = found["Foo/1.2 BarOS BAZ qux X11"]
    assert (row.browser_name, row.browser_version) == ("Foo Foo", "1.2")
    assert (row.operating_system, row.operating_system_version) == ("Bar", "3")
    assert (row.device_manufacturer, row.device_type) == ("qux", "desktop")
    (tmp_path / "rules.json").write_text('{"kind":"os","rule_no":1,"regex":"Quux","family":"Q"}\n')
    rules = agent_rules.read_rules(spark, f"{tmp_path}/rules.json")
    assert classified(spark, rules, "Quux")["Quux"].operating_system == "Q"


@pytest.mark.parametrize(
    "regex, examples",
    [
        (r"ab(?:cd)?ef", ["abef", "abcdef"]),
        (r"foo|barbar", ["foo", "barbar"]),
        (r"x{2,}longword[0-9]+", ["xxxlongword7"]),
        (r"(Chrome)/(\d+)", ["Chrome/1"]),
        (r"(?:optional)?", ["", "optional"]),
        (r"end\.$", ["end."]),
    ],
)
def test_literal_is_in_every_match(regex, examples):
    literals = agent_rules._literals(regex, ignore_case=False)
    for text in examples:
        assert re.search(regex, text) and any(literal in text.lower() for literal in literals)
    assert agent_rules._literals("Kiosk", ignore_case=True) == ["io"]


def test_literals_of_alternatives():
    literals = lambda regex: agent_rules._literals(regex, ignore_case=False)
    assert literals(r"[Bb]ot\b|[Cc]rawler") == ["bot", "crawler"]
    assert literals(r"x(?:Alpha|Beta)+y") == ["alpha", "beta"]
    assert literals(r"Windows|[0-9]+") == [""] and literals(r"[BC]ot") == ["ot"]
    grams = agent_rules._with_grams([["abcd", "xy"], ["abce"]])
    assert [[g["gram"] for g in rule] for rule in grams] == [["bcd", ""], ["bce"]]


def test_rules_meet_agents_by_an_index(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abAB/ (") for _ in range(draw.randrange(2, 6)))
    rows = [
        {"kind": draw.choice(["browser", "os", "bot", "mobile"]), "rule_no": i, "regex": draw.choice(["{}", "{}|{}", "({})+x?", "[Aa]{}"]).format(*[re.escape(word()) for _ in range(2)]), "family": f"F{i}"}
        for i in range(80)
    ]
    texts = sorted({"".join(word() for _ in range(draw.randrange(6))) for _ in range(120)})
    rules = agent_rules.make_rules(spark, rows)
    found = classified(spark, rules, *texts)
    assert len(found) == len(texts)
    for text in texts:
        won = {kind: next((r["family"] for r in rows if r["kind"] == kind and re.search(r["regex"], text)), None) for kind in ("browser", "os", "bot", "mobile")}
        assert found[text].browser_name == (won["browser"] or "Other") and found[text].operating_system == (won["os"] or "Other")
        assert found[text].device_type == ("bot" if won["bot"] else "mobile" if won["mobile"] else "unknown")
    agent = spark.createDataFrame([("x", 1)], "user_agent string, n bigint")
    plan = agents.classify_agents(agent, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "RLIKE" not in plan.upper()


def test_dimension_grows_by_new_agents_only(spark, rules, tmp_path):
    path = str(tmp_path / "agents")
    rows = lambda *texts: spark.createDataFrame([(t,) for t in texts], "user_agent string")
    agents.extend_dimension(rows("curl/7", "curl/7", None), rules, path, 0)
    used = agents.extend_dimension(rows("curl/7", "Firefox/9.1"), rules, path, 1)
    assert {(r.user_agent, r.n) for r in used.collect()} == {("curl/7", 1), ("Firefox/9.1", 1)}
    agents.extend_dimension(rows("curl/7", "Firefox/9.1"), rules, path, 1)
    assert agents.read_dimension(spark, path).count() == 2


def test_agents_are_shuffled_once_for_classifying(spark, rules):
    rows = spark.createDataFrame([("curl/7",)], "user_agent string")
    plan = agents.classify_agents(agents.distinct_agents(rows), rules, tasks=4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2  # the distinct and the spreading


def test_lookup_join_is_exact_whatever_the_skew(spark):
    rows = spark.range(6000).selectExpr(
        "id as seq",
        "case when id % 3 = 0 then 'hot' when id % 3 = 1 and id % 2 = 0 then null"
        " else concat('k', id % 500) end as key",
    )
    counts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    dim = materialise(counts.where("key <> 'k7'").withColumn("fact", F.concat("key", F.lit("!"))), "dim")
    expected = sorted(map(str, rows.join(dim.drop("n"), "key", "left").select("seq", "key", "fact").collect()))
    for limit in (lookups.BROADCAST_BYTES, 0):
        joined = lookups.lookup_join(rows, dim, "key", broadcast_bytes=limit, hot_keys=10)
        assert sorted(map(str, joined.select("seq", "key", "fact").collect())) == expected
    sizes = (
        lookups.lookup_join(rows, dim, "key", broadcast_bytes=0, hot_keys=10)
        .groupBy(F.spark_partition_id())
        .count()
        .agg(F.max("count"))
        .head()[0]
    )
    assert sizes < 6000 * 0.7  # neither the hot key nor the missing one sits in a single task


def _random_ranges(rng):
    """Nested and disjoint blocks of both families, as networks."""
    blocks = {ipaddress.ip_network("10.0.0.0/8"), ipaddress.ip_network("2001:db0::/28")}
    for _ in range(60):
        bits = rng.choice([10, 12, 16, 17, 20, 24, 28, 32])
        blocks.add(ipaddress.ip_network((0x0A000000 | rng.getrandbits(24), bits), strict=False))
        bits = rng.choice([30, 32, 40, 48, 64, 128])
        base = (0x20010DB0 << 96) | (rng.getrandbits(100))
        blocks.add(ipaddress.ip_network((base, bits), strict=False))
    return sorted(blocks, key=str)


def test_places_match_brute_force(spark):
    rng = random.Random(5)
    blocks = _random_ranges(rng)
    table = [(str(b[0]), str(b[-1]), f"C{i}", f"city {i}") for i, b in enumerate(blocks)]
    points = ["not an address", "11.0.0.1", "::ffff:10.1.2.3", "::1"]
    for block in blocks:
        points += [str(block[0]), str(block[-1]), str(block[rng.randrange(block.num_addresses)])]
        points.append(str(ipaddress.ip_address(0x0A000000 | rng.getrandbits(24))))
    points = sorted(set(points))

    def brute(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        address = getattr(address, "ipv4_mapped", None) or address
        inside = [(b.num_addresses, i) for i, b in enumerate(blocks) if address in b]
        return f"C{min(inside)[1]}" if inside else None

    addresses = spark.createDataFrame([(p, 1) for p in points], "lookup_ip string, n bigint")
    columns = "ip_start string, ip_end string, country string, city string"
    known = ranges.keyed_ranges(spark.createDataFrame(table, columns))
    located = places.locate(addresses, known)
    found = {r.lookup_ip: r.ip_country for r in located.collect()}
    assert found == {p: brute(p) for p in points if brute(p)}
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_widths_are_measured_once_for_each_range(spark):
    table = spark.createDataFrame([("10.0.0.1", "10.0.3.9", "C", "c")], "ip_start string, ip_end string, country string, city string")
    found = places.range_blocks(ranges.keyed_ranges(table))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" in plan and "conv(" not in plan[: plan.index("Generate")]  # nothing above the explosion into blocks
    rows = found.collect()
    assert len(rows) > 1 and {(r.width.upper, r.width.lower) for r in rows} == {(0, 3 * 256 + 8)}


def test_blocks_make_up_their_range(spark):
    rng = random.Random(8)
    rows = [("0.0.0.0", "255.255.255.255"), ("10.0.0.0", "10.0.255.255"), ("::", "ffff" + ":ffff" * 7), ("1.2.3.4", "1.2.3.4")]
    for _ in range(60):
        a, b = sorted(rng.getrandbits(rng.choice([4, 32, 128])) for _ in range(2))
        rows.append((str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(b))))
    table = spark.createDataFrame([(*r, "X", "") for r in rows], "ip_start string, ip_end string, country string, city string")
    found = places.range_blocks(ranges.keyed_ranges(table)).groupBy("start_key", "end_key", "width").agg(F.collect_list("block").alias("blocks"))
    sizes = set()
    for r in found.collect():
        start, end, at = int(r.start_key, 16), int(r.end_key, 16), None
        for block in sorted(r.blocks):
            low = int(block.ljust(32, "0"), 16)
            assert low == (start if at is None else at)
            at = int(block.ljust(32, "f"), 16) + 1
        assert at == end + 1 and len(r.blocks) <= 960
        assert int(r.width.upper) * 2**64 + int(r.width.lower) == end - start
        sizes.add(len(r.blocks))
    assert {1, 16} <= sizes


def test_addresses_of_one_network_meet_their_ranges_only(spark):
    """All in one /32, which a coarser bucket would pair with every range of it."""
    rows = [(f"2001:db8:{i:x}::", f"2001:db8:{i:x}:ffff:ffff:ffff:ffff:ffff", f"C{i}", "") for i in range(400)]
    table = ranges.keyed_ranges(spark.createDataFrame(rows, "ip_start string, ip_end string, country string, city string"))
    asked = spark.createDataFrame([(f"2001:db8:{i % 400:x}::{i:x}", 1) for i in range(2000)], "lookup_ip string, n bigint")
    blocks = places.prepare(table)
    assert blocks.lengths == (12,) and blocks.rows.count() == 400
    found = places.locate(asked, blocks).collect()
    assert len(found) == 2000 and all(r.ip_country == f"C{int(r.lookup_ip.split(':')[2], 16)}" for r in found)


def test_ranges_from_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ip_start,ip_end,country,city\n1.0.0.0,1.0.0.9,AU,\nbad,1.0.0.9,XX,\n")
    rows = ranges.read_ranges(spark, f"{tmp_path}/r.csv", "csv").collect()
    assert [(r.country, r.city) for r in rows] == [("AU", "")]


def test_agents_stored_by_two_writers_are_one_row(spark, rules, tmp_path):
    path = str(tmp_path / "agents")
    rows = spark.createDataFrame([("curl/7",), ("curl/7",)], "user_agent string")
    for _ in range(2):  # each has seen an empty dimension
        found = agents.classify_agents(agents.distinct_agents(rows), rules, tasks=2)
        found.select(*agents.AGENT_SCHEMA.names).write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 2
    assert agents.read_dimension(spark, path).count() == 1
    assert agents.extend_dimension(rows, rules, path).count() == 1


def test_narrowest_of_overlapping_ranges(spark):
    from beaconloom.operators import places
    from beaconloom.sources import ranges

    table = spark.createDataFrame(
        [
            ("10.0.0.0", "10.0.0.50", "A", "narrow"), ("10.0.0.40", "10.0.200.0", "B", "wide"),
            ("2001:db8::", "2001:db8::ffff", "C", "v6"), ("2001:db8::fff0", "2001:db8:1::", "D", "v6 wide"),
            ("2001:db7:ffff:ffff:ffff:ffff:ffff:ffff", "2001:db8::fff1", "E", "v6 across halves"),
        ],
        "ip_start string, ip_end string, country string, city string",
    )
    asked = spark.createDataFrame([("10.0.0.45", 1), ("10.0.0.51", 1), ("2001:db8::fff1", 1), ("2001:db8:1::", 1)], "lookup_ip string, n bigint")
    found = {r.lookup_ip: r.ip_country for r in places.locate(asked, ranges.keyed_ranges(table)).collect()}
    assert found == {"10.0.0.45": "A", "10.0.0.51": "B", "2001:db8::fff1": "E", "2001:db8:1::": "D"}


def test_rows_are_classified_as_distinct_agents_are(spark):
    rules = agent_rules.make_rules(
        spark,
        [
            {"kind": "browser", "rule_no": 2, "regex": r"(Alpha)/(\d+)"},
            {"kind": "browser", "rule_no": 1, "regex": r"beta|alpha/(9)", "flags": "i", "family": "B $1"},
            {"kind": "browser", "rule_no": 3, "regex": r"(\d)(\d)"},  # no literal
            {"kind": "device", "rule_no": 1, "regex": r"(\w+)-(\w+)", "brand": "$2 by $1"},
            {"kind": "os", "rule_no": 1, "regex": r"(Osx)(?: (\d+))?(?:\.(\d+))?", "v3": "9"},
            {"kind": "mobile", "rule_no": 1, "regex": "one"},
            {"kind": "bot", "rule_no": 1, "regex": "alpha", "flags": "i"},
        ],
    )
    texts = ["Alpha/7", "Alpha/9", "BETA", "one-two Osx 4", "Osx", "12", "none"]
    rows = spark.createDataFrame([(t, n) for n, t in enumerate([*texts, *texts, None])], "user_agent string, seq long")
    nothing = spark.createDataFrame([], agents.AGENT_SCHEMA)
    expected = {t: tuple(r[c] for c in agents.AGENT_FACTS) for t, r in classified(spark, rules, *texts).items()}
    expected[None] = (None,) * len(agents.AGENT_FACTS)
    found = agents.classify_rows(rows, nothing, rules).collect()
    assert len(found) == 15 and all(expected[r.user_agent] == tuple(r[c] for c in agents.AGENT_FACTS) for r in found)
    # What is stored is taken as it is, NULLs too.
    known = spark.createDataFrame([("Osx", "X", None, None, None, None, "desktop")], agents.AGENT_SCHEMA)
    found = {r.user_agent: r for r in agents.classify_rows(rows, known, rules).collect()}
    assert (found["Osx"].browser_name, found["Osx"].operating_system, found["BETA"].browser_name) == ("X", None, "B ")


def test_rows_are_located_as_distinct_addresses_are(spark):
    rng = random.Random(11)
    columns = "ip_start string, ip_end string, country string, city string"
    text = lambda n, v6: str(ipaddress.IPv6Address((0x20010DB8 << 96) + n) if v6 else ipaddress.IPv4Address(n))
    table, asked = [], ["", "none", "300.1.1.1", None]
    for i in range(60):
        v6, low = i % 2, rng.randrange(1 << 31)
        high = low + rng.choice([0, 7, 255, 5000, 1 << 24])
        table.append((text(low, v6), text(high, v6), f"c{i % 7}", f"t{i % 5}"))
        asked += [text(n, v6) for n in (low, high, high + 1, (low + high) // 2)]
    blocks = places.prepare(ranges.keyed_ranges(spark.createDataFrame(table, columns)))
    rows = spark.createDataFrame([(a, n) for n, a in enumerate(asked)], "lookup_ip string, seq long")
    one_each = places.locate(places.distinct_addresses(rows), blocks).collect()
    expected = {r.lookup_ip: (r.ip_country, r.ip_city) for r in one_each}
    found = places.locate_rows(rows, places.best_of_blocks(blocks)).collect()
    assert len(found) == len(asked) and len(expected) > 150
    assert all((r.ip_country, r.ip_city) == expected.get(r.lookup_ip, (None, None)) for r in found)
    empty = places.best_of_blocks(places.prepare(ranges.keyed_ranges(spark.createDataFrame([], columns))))
    assert {r.ip_city for r in places.locate_rows(rows, empty).collect()} == {None}


def test_ranges_of_one_file_are_dealt_to_tasks(spark):
    table = spark.range(4000).selectExpr(
        "concat('10.1.', id % 200, '.', id % 100) as ip_start", "'10.200.0.0' as ip_end", "'C' as country", "'' as city"
    )
    keyed = ranges.keyed_ranges(table.coalesce(1))
    assert keyed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert keyed.count() == 4000


def test_lookup_does_not_broadcast_addresses(spark):
    table = spark.createDataFrame([("10.0.0.0", "10.200.0.0", "C", "")], "ip_start string, ip_end string, country string, city string")
    asked = materialise(spark.createDataFrame([("10.1.1.1", 2)], "lookup_ip string, n bigint"), "asked")
    found = places.locate(asked, ranges.keyed_ranges(table))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.ip_country for r in found.collect()] == ["C"]
