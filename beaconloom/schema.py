"""The event table: its columns, where each comes from, and its Spark types.

``EVENT_COLUMNS`` is the single description of the 58-column event row.  Each entry is
``(column, spark type, rule, parameter)``.  The rules are:

========== =================================================================================
text       parameter as is; a missing key reads as the empty string
text_null  like ``text``, but an empty value is stored as NULL
whole      whole number; anything that is not one is stored as NULL
derived    computed from several inputs in ``operators.events``
agent      from the user-agent dimension
geo        from the header pair or the address-range dimension
========== =================================================================================
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column order, types and parameter keys of the event table.
EVENT_COLUMNS: list[tuple[str, str, str, str | None]] = [
    ("event_date", "date", "derived", "created_at"),
    ("hostname", "string", "derived", "u"),
    ("created_at", "timestamp", "derived", "created_at"),
    ("event_type", "string", "derived", None),
    ("browser_name", "string", "agent", None),
    ("browser_version", "string", "agent", None),
    ("ua_vnd", "string", "text_null", "ua.vnd"),
    ("ua_plt", "string", "text_null", "ua.plt"),
    ("device_type", "string", "agent", None),
    ("device_manufacturer", "string", "agent", None),
    ("operating_system", "string", "agent", None),
    ("operating_system_version", "string", "agent", None),
    ("user_agent", "string", "derived", None),
    ("next_hop_protocol", "string", "text", "nt_protocol"),
    ("visibility_state", "string", "text", "vis.st"),
    ("session_id", "string", "text", "rt.si"),
    ("session_length", "smallint", "whole", "rt.sl"),
    ("url", "string", "text", "u"),
    ("connect_duration", "int", "derived", None),
    ("dns_duration", "int", "derived", None),
    ("first_byte_duration", "int", "derived", None),
    ("redirect_duration", "int", "derived", None),
    ("redirects_count", "smallint", "derived", None),
    ("first_contentful_paint", "int", "whole", "pt.fcp"),
    ("first_paint", "int", "whole", "pt.fp"),
    ("cumulative_layout_shift", "float", "derived", "c.cls"),
    ("first_input_delay", "int", "whole", "et.fid"),
    ("largest_contentful_paint", "int", "whole", "pt.lcp"),
    ("geo_country_code", "string", "geo", None),
    ("geo_city_name", "string", "geo", None),
    ("page_id", "string", "text", "pid"),
    ("data_saver_on", "smallint", "whole", "net.sd"),
    ("boomerang_version", "string", "text", "v"),
    ("screen_width", "int", "derived", "scr.xy"),
    ("screen_height", "int", "derived", "scr.xy"),
    ("dom_res", "int", "whole", "dom.res"),
    ("dom_doms", "int", "whole", "dom.doms"),
    ("mem_total", "bigint", "whole", "mem.total"),
    ("mem_limit", "bigint", "whole", "mem.limit"),
    ("mem_used", "bigint", "whole", "mem.used"),
    ("mem_lsln", "bigint", "whole", "mem.lsln"),
    ("mem_ssln", "bigint", "whole", "mem.ssln"),
    ("mem_lssz", "bigint", "whole", "mem.lssz"),
    ("scr_bpp", "string", "text", "scr.bpp"),
    ("scr_orn", "string", "text", "scr.orn"),
    ("cpu_cnc", "smallint", "whole", "cpu.cnc"),
    ("dom_ln", "int", "whole", "dom.ln"),
    ("dom_sz", "int", "whole", "dom.sz"),
    ("dom_ck", "int", "whole", "dom.ck"),
    ("dom_img", "int", "whole", "dom.img"),
    ("dom_img_uniq", "int", "whole", "dom.img.uniq"),
    ("dom_script", "int", "whole", "dom.script"),
    ("dom_iframe", "int", "whole", "dom.iframe"),
    ("dom_link", "int", "whole", "dom.link"),
    ("dom_link_css", "int", "whole", "dom.link.css"),
    ("mob_dl", "int", "derived", "mob.dl"),
    ("mob_rtt", "int", "whole", "mob.rtt"),
    ("mob_etype", "string", "text_null", "mob.etype"),
]

# Parameters that must hold a JSON number (or nothing) for the row to be stored.
JSON_NUMBER_KEYS = ["c.cls", "et.fid", "net.sd", "mob.rtt"]

# The columns that the second version of the table added.
ADDED_IN_V2 = ["mob_dl", "mob_rtt", "mob_etype"]

# start/end parameter pairs behind the three durations.
DELTAS = {
    "connect_duration": ("nt_con_st", "nt_con_end"),
    "dns_duration": ("nt_dns_st", "nt_dns_end"),
    "first_byte_duration": ("nt_nav_st", "nt_res_st"),
}

EVENT_KINDS = ("rt.quit", "http_initiator")

EVENT_NAMES = [name for name, *_ in EVENT_COLUMNS]


TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
}


def _struct(columns) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns])


EVENT_SCHEMA = _struct([(name, kind) for name, kind, *_ in EVENT_COLUMNS])
EVENT_SCHEMA_V1 = _struct([(n, k) for n, k, *_ in EVENT_COLUMNS if n not in ADDED_IN_V2])

# Only the parameters that reach a column are ever parsed out of a beacon.
PARAMETER_KEYS = sorted(
    {key for *_, key in EVENT_COLUMNS if key}
    | {key for pair in DELTAS.values() for key in pair}
    | set(EVENT_KINDS)
    | {"request_headers"}
)

CORRUPT = "_corrupt_record"
PARAMETER_STRUCT = T.StructType(
    [T.StructField(key, T.StringType()) for key in PARAMETER_KEYS]
    + [T.StructField(CORRUPT, T.StringType())]
)

HOSTNAME_SCHEMA = _struct([("hostname", "string"), ("updated_at", "timestamp"), ("seq", "bigint")])

OWNER_SCHEMA = _struct(
    [
        ("username", "string"),
        ("hostname", "string"),
        ("subscription_id", "string"),
        ("subscription_expire_at", "timestamp"),
        ("seq", "bigint"),
    ]
)

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"
