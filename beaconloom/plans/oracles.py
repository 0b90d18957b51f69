"""The same queries as plain SQL over the same tables, for comparison by another engine.

Only the *inputs* (the expressions that derive beacons from general tables, and the rule list) are
shared with the Spark queries; what is computed from them is written independently here.
"""

from __future__ import annotations

from beaconloom.plans import inputs
from beaconloom.plans.queries import AS_OF, DAY, V2_SINCE
from beaconloom.schema import EVENT_COLUMNS
from beaconloom.sources.agent_rules import DEFAULT_RULES


def _quote(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


VISITS = """visits as (
  select e.*, p.url from events e
  join pages p on p.page_id = e.event_id % (select count(*) from pages))"""

BEACONS = (
    f"{VISITS},\nbeacons as (select event_id as seq, event_id, user_id, event_type as kind,"
    f" {inputs.RECEIVED} as received_at,\n"
    f" nullif({inputs.AGENT}, '') as agent,\n"
    f" trim(replace({inputs.COUNTRY}, '\"', '')) as head_country, {inputs.CITY} as head_city,\n"
    f" case when event_id % 11 = 0 then null else {inputs.ADDRESS} end as ip,\n "
    + ",\n ".join(f'{sql} as "{key}"' for key, sql in inputs.PARAMETERS.items())
    + f"\nfrom visits where not ({inputs.MISSING}))"
)

TYPED = f"""{BEACONS},
typed as (select *,
  regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1) as hostname,
  case when u like '% %' then 'bad_url'
       when "c.cls" like '%,%' or "rt.sl" = '40000' or "et.fid" = '10.5' or "net.sd" = 'on' or "mob.rtt" = '0x1f'
           or "c.cls" = '1e40' or "mob.dl" = '99999999999' or "scr.xy" like '99999999999x%'
         then 'bad_number'
       when created_at = 'yesterday' then 'bad_created_at' end as reason,
  case when created_at is null then strftime(received_at, '%Y-%m-%d %H:%M:%S')
       when created_at = 'yesterday' then null else created_at end as made
  from beacons),
good as (select * from typed where reason is null)"""


def _delta(start: str, end: str) -> str:
    ticks = f"""try_cast("{end}" as bigint) - coalesce(try_cast("{start}" as bigint), 0)"""
    return f"""case when "{start}" <> '' and "{end}" <> '' then least(greatest({ticks}, 0), 65535) end"""


KIND = """case when http_initiator <> '' then http_initiator
 when "rt.quit" is not null then 'quit_page' else 'visit_page' end"""
SIDE = """case when regexp_matches("scr.xy", '^[0-9]+x[0-9]+$') then
 cast(split_part("scr.xy", 'x', {}) as bigint) end"""
ROUNDED = """case when abs(try_cast("mob.dl" as float)) < 2147483648 then cast(round(try_cast("mob.dl" as float)) as bigint) end"""

_numbers: dict[str, int] = {}
_rules = []
for _kind, _regex, _family, _v1, _brand in DEFAULT_RULES:
    _numbers[_kind] = _numbers.get(_kind, 0) + 1
    if _kind in ("browser", "os", "device"):
        _fields = ", ".join(_quote(x) for x in (f"(?:{_regex})()()()()", _family, _v1, _brand))
        _rules.append(f"('{_kind}', {_numbers[_kind]}, {_fields})")

AGENTS = (
    f"{TYPED},\nrules(kind, rule_no, regex, family, v1, brand) as (values\n "
    + ",\n ".join(_rules)
    + r"""),
agents as (select agent, count(*) as n from good where agent is not null group by agent),
wins as (
  select a.agent, r.*, row_number() over (partition by a.agent, r.kind order by r.rule_no) as place
  from agents a join rules r on regexp_matches(a.agent, r.regex)),
named as (
  select agent, kind, brand,
    coalesce(family, regexp_extract(agent, regex, 1)) as family,
    concat_ws('.',
      nullif(case when v1 is null then regexp_extract(agent, regex, 2)
                  when v1 = '$1' then regexp_extract(agent, regex, 1) else v1 end, ''),
      nullif(case when v1 = '$1' then regexp_extract(agent, regex, 2)
                  else regexp_extract(agent, regex, 3) end, ''),
      nullif(case when v1 = '$1' then regexp_extract(agent, regex, 3)
                  else regexp_extract(agent, regex, 4) end, '')) as version
  from wins where place = 1),
agent_dim as (
  select a.agent as user_agent, a.n,
    coalesce(b.family, 'Other') as browser_name, nullif(b.version, '') as browser_version,
    coalesce(o.family, 'Other') as operating_system, nullif(o.version, '') as operating_system_version,
    d.brand as device_manufacturer,
    case when regexp_matches(a.agent, '[Bb]ot\b|[Cc]rawler|[Ss]pider|HeadlessChrome') then 'bot'
         when regexp_matches(a.agent, 'Windows NT|Macintosh|X11|CrOS') then 'desktop'
         when a.agent like '%iPad%' or a.agent like '%Tablet%'
           or (a.agent like '%Android%' and a.agent not like '%Mobile%') then 'tablet'
         when regexp_matches(a.agent, 'iPhone|iPod|Android.*Mobile|Windows Phone') then 'mobile'
         else 'unknown' end as device_type
  from agents a
  left join named b on b.agent = a.agent and b.kind = 'browser'
  left join named o on o.agent = a.agent and o.kind = 'os'
  left join named d on d.agent = a.agent and d.kind = 'device')"""
)

RANGES = f"""ranges as (
  select {inputs.RANGE_START} as first_ip, {inputs.RANGE_END} as last_ip,
    concat('C', cast(c_nationkey % 10 as varchar)) as country, c_mktsegment as city from customer
  union all
  select {inputs.WIDE_START}, {inputs.WIDE_END}, r_name, '' from region),
located as (
  select ip, country, city from (
    select a.ip, r.country, r.city,
      row_number() over (partition by a.ip order by r.last_ip - r.first_ip, r.first_ip desc) as place
    from (select distinct ip from beacons where ip is not null) a
    join ranges r on a.ip between r.first_ip and r.last_ip)
  where place = 1)"""

FALLBACK = """case when head_country = '' and head_city = '' then coalesce(l.country, '') else head_country end"""
FALLBACK_CITY = """case when head_country = '' and head_city = '' then coalesce(l.city, '') else head_city end"""

_derived = {
    "event_date": "substr(made, 1, 10)",
    "hostname": "hostname",
    "created_at": "made",
    "event_type": KIND,
    "user_agent": "agent",
    "connect_duration": _delta("nt_con_st", "nt_con_end"),
    "dns_duration": _delta("nt_dns_st", "nt_dns_end"),
    "first_byte_duration": _delta("nt_nav_st", "nt_res_st"),
    "redirect_duration": "cast(0 as bigint)",
    "redirects_count": "cast(0 as bigint)",
    "cumulative_layout_shift": 'cast(try_cast("c.cls" as float) as double)',
    "screen_width": SIDE.format(1),
    "screen_height": SIDE.format(2),
    "mob_dl": ROUNDED,
    "browser_name": "coalesce(browser_name, 'Other')",
    "browser_version": "browser_version",
    "operating_system": "coalesce(operating_system, 'Other')",
    "operating_system_version": "operating_system_version",
    "device_manufacturer": "device_manufacturer",
    "device_type": "coalesce(device_type, 'unknown')",
    "geo_country_code": FALLBACK,
    "geo_city_name": FALLBACK_CITY,
}


def _event_column(name: str, rule: str, key: str | None) -> str:
    if name in _derived:
        sql = _derived[name]
    elif rule == "whole":
        sql = f'try_cast("{key}" as bigint)'
    elif rule == "text_null":
        sql = f"nullif(\"{key}\", '')"
    else:
        sql = f"coalesce(\"{key}\", '')"
    return f"{sql} as {name}"


EVENT_SELECT = ",\n ".join(_event_column(n, rule, key) for n, _, rule, key in EVENT_COLUMNS)
EVENT_FROM = "from good left join agent_dim d on d.user_agent = agent left join located l on l.ip = good.ip"
EVENTS_CTE = f"with {AGENTS},\n{RANGES}"

FORM_ROWS = f"""forms as (select event_id as seq, {inputs.UPLOADED} as received_at,
  {inputs.PARAMETERS["u"]} as u, {inputs.PARAMETERS["rt.si"]} as si, {inputs.PARAMETERS["mob.dl"]} as dl,
  event_id % 53 = 1 or event_id % 59 = 2 as broken
  from visits)"""
FORMS = f"{VISITS},\n{FORM_ROWS}"

LINES = rf"""{FORMS},
lines as (
  select replace(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), '.', '_') as host,
    strftime(received_at, '%Y-%m-%d') as day,
    concat(cast(year(received_at) as varchar), '-', cast(month(received_at) as varchar), '-',
      cast(day(received_at) as varchar)) as day_name,
    hour(received_at) as hour, seq,
    concat('{{"flag":"","label":"a b\u0026c","mob.dl":"', dl, '","n":"first","rt.si":"', si,
      '","u":"', replace(u, '&', '\u0026'), '"}}') as value
  from forms where not broken and u not like '% %')"""

HOUR_RANGES = f"""{LINES},
counts as (select host, day, day_name, hour, count(*) as n from lines group by all),
hour_ranges as (select host, day, day_name, hour, n,
  sum(n) over (partition by host, day order by hour rows unbounded preceding) as last_line from counts)"""

OWNERS = """asked as (
  select concat('user', cast(o_custkey % 500 as varchar)) as username,
    concat('host', cast(o_orderkey % 20 as varchar), '.example.com') as hostname,
    o_orderdate + to_seconds(o_orderkey % 86400) as made, o_orderkey as seq, o_custkey from orders),
dated as (select *,
    date_trunc('month', made) + interval 3 month + to_days(cast(day(made) - 1 as integer))
      + (made - date_trunc('day', made)) as ends from asked),
log as (select username, hostname,
    concat(strftime(ends, '%Y-%m-%d'), '|', cast(seq as varchar)) as subscription_id,
    strftime(ends, '%Y-%m-%d %H:%M:%S') as subscription_expire_at, seq from dated),
gone as (
  select concat('user', cast((o_custkey + 1) % 500 as varchar)) as username,
    concat('host', cast(o_orderkey % 20 as varchar), '.example.com') as hostname,
    max(o_orderkey) as seq
  from orders where o_orderpriority = '1-URGENT' group by 1, 2),
kept as (select l.* from log l where not exists (
    select 1 from gone g where g.username = l.username and g.hostname = l.hostname and l.seq < g.seq)),
owners as (select * exclude (place) from (
    select *, row_number() over (partition by username, hostname order by seq desc) as place from kept)
  where place = 1)"""

HOSTS = f"""with {TYPED},
ranked as (select hostname, made, seq, row_number() over (partition by hostname order by seq desc) as place
  from typed where made is not null and (reason is null or reason = 'bad_number'))
select hostname, made as updated_at{{}} from ranked where place = 1"""

MOUSE = f"""{BEACONS},
mouse as (select seq, regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1) as hostname,
  event_id % 19 + 1 as r, event_id % 100 as a, user_id % 100 as b from beacons)"""

_faulty_form = "case when broken then 'bad_form' when u like '% %' then 'bad_url'"
_faulty_form += " when dl = '99999999999' then 'bad_number' end"

ORACLES: dict[str, str] = {
    "beacon_events": f"{EVENTS_CTE}\nselect {EVENT_SELECT},\n seq\n{EVENT_FROM}",
    "stream_events": f"{EVENTS_CTE}\nselect {EVENT_SELECT}\n{EVENT_FROM}",
    "stream_event_sink": f"{EVENTS_CTE}\nselect {EVENT_SELECT}\n{EVENT_FROM}",
    "stream_rejects": f"with {TYPED} select seq, reason from typed where reason is not null",
    "count_where": f"""with {TYPED}
select 'all' as predicate, count(*) as n from good
union all select 'greater', count(*) from good where try_cast("c.cls" as float) > 2.25
union all select 'equal', count(*) from good where try_cast("et.fid" as bigint) = 24
union all select 'text', count(*) from good where "mob.etype" = '3g' and "ua.vnd" = 'Example Maker'
union all select 'null', count(*) from good where "ua.plt" is null or "ua.plt" = ''""",
    "event_kinds": f"with {TYPED} select {KIND} as event_type, count(*) as n from good group by 1",
    "screen_sizes": f"""with {TYPED}
select {SIDE.format(1)} as screen_width, {SIDE.format(2)} as screen_height, count(*) as n
from good group by 1, 2""",
    "page_hosts": """select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as hostname, count(*) as n
from pages group by 1""",
    "timing_delta": f"""with {BEACONS}
select seq, {_delta("nt_con_st", "nt_con_end")} as connect_duration,
 {_delta("nt_dns_st", "nt_dns_end")} as dns_duration,
 {_delta("nt_nav_st", "nt_res_st")} as first_byte_duration from beacons""",
    "round_param": f"with {BEACONS} select seq, {ROUNDED} as mob_dl from beacons",
    "event_days": f"""with {TYPED}
select seq, made as created_at, substr(made, 1, 10) as event_date from good""",
    "rejects": f"""with {TYPED}, {FORM_ROWS}
select 'lines' as source, seq, reason from typed where reason is not null
union all
select 'forms', seq, {_faulty_form} from forms
where broken or u like '% %' or dl = '99999999999'""",
    "form_parse": f"""with {FORMS}
select seq, case when not broken then u end as u, case when not broken then si end as rt_si,
 case when not broken then 'first' end as n, case when not broken then '' end as flag,
 case when not broken then dl end as mob_dl, case when not broken then 'a b&c' end as label,
 case when not broken then cast(6 as bigint) end as parameters,
 case when broken then 'bad_form' end as unreadable from forms""",
    "event_table": f"""with {TYPED}
select substr(made, 1, 10) as event_date, hostname, count(*) as n,
 cast(sum(try_cast("pt.lcp" as bigint)) as bigint) as paint
from good where substr(made, 1, 10) between '2024-01-10' and '2024-01-20' group by 1, 2""",
    "schema_evolution": f"""with {TYPED},
days as (select substr(made, 1, 10) as event_date, made >= '{V2_SINCE}' as v2, {ROUNDED} as dl,
  try_cast("mob.rtt" as bigint) as rtt, nullif("mob.etype", '') as etype from good)
select event_date, count(*) as n,
 count(case when v2 then dl end) as mob_dl_known, count(case when v2 then rtt end) as mob_rtt_known,
 count(case when v2 then etype end) as mob_etype_known,
 cast(sum(case when v2 then dl end) as bigint) as mob_dl_total
from days group by 1""",
    "ua_classify": f"with {AGENTS} select * from agent_dim",
    "ua_rules_file": f"with {AGENTS} select * from agent_dim",
    "ua_rules_yaml": f"with {AGENTS} select * from agent_dim",
    "ua_increment": f"with {AGENTS} select * from agent_dim",
    "ua_join": f"""with {AGENTS}
select coalesce(d.browser_name, 'Other') as browser_name, coalesce(d.device_type, 'unknown') as device_type,
 count(*) as n from good left join agent_dim d on d.user_agent = good.agent group by 1, 2""",
    "geo_range": f"""with {BEACONS}, {RANGES}
select seq, coalesce(l.country, '') as country, coalesce(l.city, '') as city
from beacons b left join located l on l.ip = b.ip""",
    "geo_range_v6": f"""with {BEACONS}, {RANGES}
select seq, coalesce(l.country, '') as country, coalesce(l.city, '') as city
from beacons b left join located l on l.ip = b.ip""",
    "form_headers": f"""with {FORMS},
headed as (select f.seq, nullif({inputs.AGENT}, '') as user_agent, trim(replace({inputs.COUNTRY}, '"', '')) as country,
  {inputs.CITY} as city, split_part({inputs.FORWARDED}, ',', 1) as address
  from forms f join visits v on v.event_id = f.seq where not f.broken and f.u not like '% %')
select seq, user_agent, country, city, case when country = '' and city = '' then address end as lookup_ip from headed""",
    "geo_fallback": f"""with {BEACONS}, {RANGES}
select seq, {FALLBACK} as country, {FALLBACK_CITY} as city
from beacons b left join located l on l.ip = b.ip""",
    "host_registry": HOSTS.format(", seq"),
    "stream_hosts": HOSTS.format(""),
    "stream_registry": HOSTS.format(""),
    "subscription_register": f"""with {OWNERS}
select username, hostname, subscription_id, subscription_expire_at, seq from log""",
    "owners_current": f"""with {OWNERS}
select username, hostname, subscription_id, subscription_expire_at, seq from owners""",
    "registry_compacted": f"""with {OWNERS}
select username, hostname, subscription_id, subscription_expire_at, seq from owners""",
    "owner_deletes": f"""with {OWNERS}
select username, hostname, subscription_id, subscription_expire_at, seq from kept""",
    "subscriptions_by_id": f"""with {OWNERS},
newest as (select *, row_number() over (partition by username, hostname order by seq desc) as place from log),
shared as (select concat(substr(subscription_id, 1, 11), cast(seq % 3 as varchar)) as subscription_id,
  subscription_expire_at, hostname, seq from newest where place = 1)
select subscription_id, subscription_expire_at, hostname, seq from (
  select *, row_number() over (partition by subscription_id order by seq desc) as place from shared)
where place = 1""",
    "subscription_get": f"""with {OWNERS}
select subscription_id, subscription_expire_at, hostname from owners
where subscription_id = (select max(subscription_id) from owners)""",
    "subscription_lookup": f"""with {OWNERS}
select l.subscription_id, l.hostname,
 case when o.seq is null then 'NOT_FOUND' when '{AS_OF}' > o.subscription_expire_at then 'EXPIRED'
 else 'FOUND' end as status
from log l left join owners o on o.subscription_id = l.subscription_id and o.hostname = l.hostname""",
    "archive_meta": f"""with {HOUR_RANGES}
select host, day, hour, cast(last_line - n + 1 as bigint) as first_line,
 cast(last_line as bigint) as last_line from hour_ranges""",
    "archive_lines": f"""with {LINES}
select host, day, hour, seq, row_number() over (partition by host, day order by hour, seq) as line_no, value
from lines""",
    "archive_hours": f"with {LINES} select host, day, hour, value from lines",
    "stream_archive": f"with {LINES} select host, day, hour, value from lines",
    "stream_archive_sink": f"with {LINES} select host, day, hour, value from lines",
    "archive_day": f"with {LINES} select host, day_name as day, value from lines where day = '{DAY}'",
    "archive_day_removed": f"with {LINES} select host, day_name as day, value from lines where day = '{DAY}'",
    "archive_days_gzip": f"with {LINES} select host, day_name as day, value from lines",
    "archive_days_zst_text": f"with {LINES} select host, day_name as day, value from lines",
    "archive_days_zstd": f"with {LINES} select host, day_name as day, value from lines",
    "archive_meta_files": f"""with {HOUR_RANGES}
select host, day_name as day, concat_ws(',', hour, cast(last_line - n + 1 as bigint),
 cast(last_line as bigint)) as value from hour_ranges""",
    "archive_replay": f"""with {FORMS}
select regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1) as hostname, si as session_id, count(*) as n,
 cast(sum(cast(round(try_cast(dl as float)) as bigint)) as bigint) as mob_dl_total
from forms where not broken and u not like '% %' and dl <> '99999999999' group by 1, 2""",
    "timeline_stats": f"""with {MOUSE}
select hostname, cast(sum(r + 2) as bigint) as buckets, cast(sum(r * a + 100 + b) as bigint) as total,
 cast(100 as bigint) as largest from mouse group by 1""",
    "timeline_buckets": f"""with {MOUSE},
rows_ as (select unnest(list_concat(list_transform(range(r), lambda x: a), [100, b])) as value,
  unnest(range(r + 2)) as bucket from mouse)
select bucket, count(*) as n, cast(sum(value) as bigint) as total, cast(max(value) as bigint) as largest
from rows_ group by 1""",
    "timeline_intervals": f"""with {BEACONS},
claims as (select seq, event_id % 6 as kind, event_id % 9 + 1 as r from beacons),
runs as (
  select '0' as mode, 10 as value, 0 as s, r as e from claims where kind = 0
  union all select '0', 1295, 0, 1 from claims where kind = 1
  union all select '1', 9223372036854775807, 0, 1 from claims where kind = 2
  union all select '1', 5, 0, 101559956668415 from claims where kind = 3
  union all select '2', unnest([1, 2, 100]), unnest([0, 1, 2]), unnest([1, 2, 3]) from claims where kind = 5),
places as (select mode, s as p from runs union select mode, e from runs),
stretches as (select mode, p, lead(p) over (partition by mode order by p) - 1 as q from places)
select mode, cast(p as bigint) as first_bucket, cast(q as bigint) as last_bucket, count(*) as n,
 try_cast(sum(value) as bigint) as total, cast(max(value) as bigint) as largest
from stretches join runs using (mode) where s <= p and p < e group by mode, p, q""",
    "timeline_modes": f"""with {BEACONS},
claims as (select seq, event_id % 6 as kind, event_id % 9 + 1 as r from beacons)
select seq,
 cast(case kind when 0 then r when 1 then 1 when 2 then 1 when 3 then 101559956668415 when 5 then 3 end as bigint) as buckets,
 cast(case kind when 0 then 10 * r when 1 then 1295 when 2 then 9223372036854775807 when 3 then 507799783342075
   when 5 then 103 end as bigint) as total,
 cast(case kind when 0 then 10 when 1 then 1295 when 2 then 9223372036854775807 when 3 then 5 when 5 then 100 end
   as bigint) as largest,
 cast(case kind when 0 then r when 1 then 1 when 2 then 1 when 5 then 3 else 0 end as bigint) as n,
 case kind when 3 then 'endless_timeline' when 4 then 'bad_timeline' end as reason
from claims""",
    "timeline_arrays": f"""with {BEACONS}
select seq, concat_ws(',', event_id % 7, user_id % 9, user_id % 9, user_id % 9, user_id % 9, user_id % 9, 10)
 as numbers from beacons""",
}
