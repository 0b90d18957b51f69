"""Beacons derived from general tables.

The ``events`` and ``pages`` tables hold no beacons, so each event becomes one: the page gives the
URL, the event the rest.  Every parameter is one SQL expression over
``event_id, ts, user_id, event_type, value, url``, written so that any SQL engine gives the same
text; NULL means that the beacon does not have the parameter.  Faulty beacons are among them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1_700_000_000_000
TICK = f"cast({EPOCH_MS} + event_id"

PARAMETERS: dict[str, str] = {
    # Some beacons have two faults: 303, 309 and 404 meet 101 and 103.
    "u": "case when event_id % 101 = 7 then 'http://bad host/x' else url end",
    "created_at": (
        "case when event_id % 89 = 5 then null when event_id % 103 = 9 or event_id % 404 = 7 then 'yesterday'"
        " else substr(cast(ts as string), 1, 19) end"
    ),
    "rt.si": "concat('session-', cast(user_id as string))",
    # A session length beyond 16 bits, and what is no JSON number where one is required.
    "rt.sl": "case when event_id % 113 = 6 or event_id % 309 = 9 then '40000' else cast(event_id % 40 as string) end",
    "rt.quit": "case when event_type = 'error' then '' end",
    "http_initiator": "case when event_type = 'click' then 'click' end",
    "pid": "lpad(cast(event_id % 100000000 as string), 8, '0')",
    "v": "'2.14.7'",
    "vis.st": "case when event_type = 'view' then 'visible' else 'hidden' end",
    "nt_protocol": "case when event_id % 3 = 0 then 'h2' else 'http/1.1' end",
    "nt_con_st": f"{TICK} as string)",
    "nt_con_end": (
        f"{TICK} + cast(floor(value * 1000) as bigint)"
        " - case when event_type = 'error' then 3000 else 0 end as string)"
    ),
    "nt_dns_st": f"case when event_type = 'purchase' then '' else {TICK} as string) end",
    "nt_dns_end": f"{TICK} + event_id % 90 as string)",
    "nt_nav_st": f"case when event_id % 71 = 3 then 'soon' else {TICK} as string) end",
    "nt_res_st": f"{TICK} + event_id % 2500 as string)",
    "pt.fp": "cast(event_id % 3000 as string)",
    "pt.fcp": "cast(event_id % 3000 + 40 as string)",
    "pt.lcp": "case when event_id % 13 = 0 then '' else cast(event_id % 4000 as string) end",
    "c.cls": (
        "case when event_id % 97 = 11 then '0,5' when event_id % 157 = 6 then '1e40' when event_type = 'signup' then ''"
        " else cast(value as string) end"
    ),
    "et.fid": (
        "case when event_id % 127 = 8 then '10.5' when event_id % 2 = 0 then cast(event_id % 300 as string) end"
    ),
    "net.sd": "case when event_id % 131 = 1 or event_id % 303 = 7 then 'on' when event_id % 6 = 0 then '1' end",
    "mob.etype": "case when user_id % 3 = 0 then '4g' when user_id % 3 = 1 then '3g' else '' end",
    "mob.dl": "case when event_id % 17 = 2 then 'fast' when event_id % 151 = 4 then '99999999999' else cast(value as string) end",
    "mob.rtt": (
        "case when event_id % 7 = 0 then '' when event_id % 137 = 2 then '0x1f' else cast(event_id % 500 as string) end"
    ),
    "scr.xy": (
        "case when event_id % 139 = 5 then '99999999999x5' when event_id % 4 = 0 then '1700x920'"
        " when event_id % 4 = 1 then '390x800' when event_id % 4 = 2 then '' else '1x2x3' end"
    ),
    "scr.bpp": "'30/30'",
    "scr.orn": "'90/upright'",
    "cpu.cnc": "cast(user_id % 16 + 1 as string)",
    "dom.res": "case when event_id % 19 = 4 then 'n/a' else cast(event_id % 120 as string) end",
    "dom.doms": "cast(event_id % 9 as string)",
    "dom.ln": "cast(event_id % 900 as string)",
    "dom.sz": "cast(event_id % 500000 + 1000 as string)",
    "dom.ck": "cast(event_id % 350 as string)",
    "dom.img": "cast(event_id % 35 as string)",
    "dom.img.uniq": "cast(event_id % 29 as string)",
    "dom.script": "cast(event_id % 25 as string)",
    "dom.iframe": "cast(event_id % 3 as string)",
    "dom.link": "cast(event_id % 20 as string)",
    "dom.link.css": "cast(event_id % 5 as string)",
    "mem.total": "cast(15000000 + event_id as string)",
    "mem.limit": "'3221225472'",
    "mem.used": "cast(14000000 + event_id as string)",
    "mem.lsln": "'0'",
    "mem.ssln": "cast(event_id % 4 as string)",
    "mem.lssz": "'2'",
    "ua.vnd": "case when user_id % 4 = 0 then '' else 'Example Maker' end",
    "ua.plt": "case when user_id % 5 = 0 then null else 'Desk64' end",
    # Parameters that reach no column, as real beacons have them.
    "sv": "'14'",
    "n": "cast(event_id % 11 as string)",
    "nt_load_end": f"{TICK} + 5000 as string)",
    "c.t.mousepct": (
        "concat('2*', substr('123456789abcdefghij', cast(event_id % 19 as int) + 1, 1), '*',"
        " lpad(cast(event_id % 100 as string), 2, '0'), '__',"
        " lpad(cast(user_id % 100 as string), 2, '0'))"
    ),
    # All modes, a wrapped number, the largest number, an endless claim and an unknown mode.
    "c.t.log": (
        "case event_id % 6 when 0 then concat('0*', cast(event_id % 9 + 1 as string), '*a') when 1 then '0.zz.'"
        " when 2 then '11y2p0ij32e8e7' when 3 then '1*zzzzzzzzz*5' when 4 then '9abc' else '20102__' end"
    ),
    "c.t.fps": (
        "concat('1', cast(event_id % 7 as string), ',*5*', cast(user_id % 9 as string), ',a')"
    ),
}

AGENT = """case user_id % 10
 when 0 then ''
 when 1 then concat('Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/',
   cast(100 + event_id % 20 as string), '.0.', cast(5000 + user_id as string), '.102 Safari/537.36')
 when 2 then concat('Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) AppleWebKit/610.2.7 (KHTML, like Gecko) Version/16.5.',
   cast(event_id % 4 as string), ' Mobile/20F66 Safari/610.2')
 when 3 then 'Mozilla/5.0 (Linux; Android 13; Pixel 6a) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/112.0.0.0 Mobile Safari/537.36'
 when 4 then 'Mozilla/5.0 (Linux; Android 12; SM-T870) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/107.0.0.0 Safari/537.36'
 when 5 then concat('Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:', cast(90 + user_id as string), '.0) Gecko/20100101 Firefox/', cast(90 + user_id as string), '.0')
 when 6 then 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.example.com/bot.html)'
 when 7 then 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.1 Safari/605.1.15'
 when 8 then 'curl/7.88.1'
 else concat('Mozilla/5.0 (Windows NT 6.1) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/108.0.0.0 Safari/537.36 Edg/108.0.', cast(1462 + event_id % 9 as string))
end"""

COUNTRY = "case when event_id % 5 = 0 then '' else concat(' \" ', substr('BGDEFRUSGB', cast(user_id % 5 as int) * 2 + 1, 2), ' \" ') end"
CITY = "case when event_id % 5 < 2 then '' else concat('City ', cast(user_id % 30 as string)) end"

ADDRESS_BASE = 1_342_177_280  # 80.0.0.0
ADDRESS = f"({ADDRESS_BASE} + (event_id * 7919) % 3072000)"


def dotted(number: str) -> str:
    """SQL that writes a 32-bit number as an IPv4 address."""
    octets = [f"cast(cast(floor({number} / {256**i}) as bigint) % 256 as string)" for i in (3, 2, 1, 0)]
    return "concat(" + ", '.', ".join(octets) + ")"


FORWARDED = (
    f"case when event_id % 11 = 0 then 'unknown' else concat({dotted(ADDRESS)}, ', 10.0.0.1') end"
)
RECEIVED = "ts + interval 90 seconds"
# Form requests come late, in weekly uploads, so that arrival and event time differ.
UPLOADED = "date_trunc('week', ts) + interval 7 days + interval 1 hour * (user_id % 5)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Events that one task makes beacons of, at about: some 2 KB of JSON each.
TASK_EVENTS = 64 * 1024


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the URL of their page; pages are assigned in turn.

    An event is a few bytes, the beacon made of it some 2 KB: events are dealt to as many tasks as the beacons need.
    """
    events = table(spark, folder, "events")
    pages = table(spark, folder, "pages").select("page_id", "url")
    count = pages.count()  # from the files' footers
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // TASK_EVENTS))
    events = events.repartition(tasks, "event_id")
    return events.withColumn("page_id", F.col("event_id") % F.lit(count)).join(pages, "page_id")


MISSING = "event_id % 149 = 3"


def request_headers() -> Column:
    """The headers of a request as JSON."""
    headers = F.create_map(
        F.lit("User-Agent"),
        F.array(F.expr(AGENT)),
        F.lit("Cf-Ipcountry"),
        F.array(F.expr(COUNTRY)),
        F.lit("Cf-Ipcity"),
        F.array(F.expr(CITY)),
        F.lit("X-Forwarded-For"),
        F.array(F.expr(FORWARDED), F.lit("198.51.100.7")),
    )
    return F.to_json(headers)


def beacon_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON line per beacon, with ``seq`` and ``received_at``."""
    fields = [F.expr(sql).alias(key) for key, sql in PARAMETERS.items()]
    # Some lines are missing.
    line = F.to_json(F.struct(*fields, request_headers().alias("request_headers")))
    return visits(spark, folder).select(
        F.when(F.expr(f"not ({MISSING})"), F.coalesce(line, F.lit(""))).alias("value"),
        F.col("event_id").alias("seq"),
        F.expr(RECEIVED).cast("timestamp").alias("received_at"),
    )


def form_requests(spark: SparkSession, folder: str, headers: bool = False) -> DataFrame:
    """Form-encoded requests: the URL and session in the body, repeated keys and the rest in the query; with headers on demand."""
    # URL-encoded text; every 53rd body has a broken escape and every 59th a raw semicolon.
    body = F.concat(
        F.lit("u="),
        F.url_encode(F.expr(PARAMETERS["u"])),
        F.lit("&rt.si="),
        F.url_encode(F.expr(PARAMETERS["rt.si"])),
        F.lit("&n=first&n=second&flag"),
        F.expr(
            "case when event_id % 53 = 1 then '&x=%zz' when event_id % 59 = 2 then '&x=1;y=2' else '' end"
        ),
    )
    query = F.concat(
        F.lit("n=third&mob.dl="),
        F.url_encode(F.expr(PARAMETERS["mob.dl"])),
        F.lit("&label=a+b%26c"),
    )
    return visits(spark, folder).select(
        body.alias("body"),
        query.alias("query"),
        (request_headers() if headers else F.lit(None).cast("string")).alias("headers"),
        F.expr(UPLOADED).cast("timestamp").alias("received_at"),
        F.col("event_id").alias("seq"),
    )


# Customers own address blocks inside one wide block, with gaps between them.
RANGE_START = f"({ADDRESS_BASE} + c_custkey * 2048)"
RANGE_END = f"({ADDRESS_BASE} + c_custkey * 2048 + 900 + c_nationkey * 40)"
# Regions own wide blocks, each beginning inside the one before and ending beyond it.
WIDE_START = f"({ADDRESS_BASE} + r_regionkey * 500000)"
WIDE_END = f"({ADDRESS_BASE} + r_regionkey * 700000 + 900000)"


def v6(number: str) -> str:
    """SQL that writes a 32-bit number as the end of an IPv6 address, its groups without leading zeros."""
    whole = f"cast({number} as bigint)"
    return f"concat('2001:DB8::', hex(shiftright({whole}, 16)), ':', lower(hex({whole} & 65535)))"


def address_ranges(spark: SparkSession, folder: str, written: Callable[[str], str] = dotted) -> DataFrame:
    """(ip_start, ip_end, country, city) from customers and, as wide overlapping blocks, from regions."""
    blocks = table(spark, folder, "customer").select(
        F.expr(written(RANGE_START)).alias("ip_start"),
        F.expr(written(RANGE_END)).alias("ip_end"),
        F.expr("concat('C', cast(c_nationkey % 10 as string))").alias("country"),
        F.col("c_mktsegment").alias("city"),
    )
    wide = table(spark, folder, "region").select(
        F.expr(written(WIDE_START)).alias("ip_start"),
        F.expr(written(WIDE_END)).alias("ip_end"),
        F.col("r_name").alias("country"),
        F.lit("").alias("city"),
    )
    return blocks.unionByName(wide)


def owner_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Registrations of hostnames by owners, from orders."""
    return table(spark, folder, "orders").select(
        F.expr("concat('user', cast(o_custkey % 500 as string))").alias("username"),
        F.expr("concat('host', cast(o_orderkey % 20 as string), '.example.com')").alias("hostname"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias(
            "registered_at"
        ),
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderkey").alias("seq"),
    )


def owner_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """Deletions of owned hostnames: urgent orders also delete the previous customer's hostname."""
    return (
        table(spark, folder, "orders")
        .where("o_orderpriority = '1-URGENT'")
        .select(
            F.expr("concat('user', cast((o_custkey + 1) % 500 as string))").alias("username"),
            F.expr("concat('host', cast(o_orderkey % 20 as string), '.example.com')").alias("hostname"),
            F.col("o_orderkey").alias("seq"),
        )
    )
