"""Queries of the general data-pipeline operators: p1, p3, p4 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators.nested_tables import endpoint_members
from ..operators.schema_drift import schema_changes, unified
from ..operators.snapshot_changes import listing_changes
from ..operators.timestamps import ABBREVIATIONS, listing_instants


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return listing_changes(table(spark, sf, "model_snapshot"), table(spark, sf, "observation"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return endpoint_members(table(spark, sf, "endpoint_payload"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return listing_instants(table(spark, sf, "model_listing"), table(spark, sf, "source_zone"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "list_payload"))


def p6_unified(spark: SparkSession, sf: str) -> DataFrame:
    return unified(table(spark, sf, "list_payload"))


def p6_compared(spark: SparkSession, sf: str) -> DataFrame:
    """The effort support and the context limit of each record, and which of its fields states them."""
    return unified(table(spark, sf, "list_payload"), fields=False).select("feed_id", "file_no", "record_id", "id", "effort_supported", "effort_path", "context_limit", "context_path")


def p6_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of the consistent table in long form, with its canonical value."""
    wide = unified(table(spark, sf, "list_payload"))
    if "fields" not in wide.columns:
        return wide.select("feed_id", "file_no", "record_id", F.lit("").alias("path"), F.lit("").alias("value")).where("false")
    arrays = lambda f: F.lower(F.to_json(F.try_parse_json(f"fields.`{f.name}`.array"))) if "array" in f.dataType.fieldNames() else F.lit(None)
    entries = [F.struct(F.lit(f.name).alias("path"), F.coalesce(arrays(f), F.col(f"fields.`{f.name}`.value")).alias("value")) for f in wide.schema["fields"].dataType.fields]
    long = wide.select("feed_id", "file_no", "record_id", F.explode(F.array(*entries)).alias("_e"))
    return long.select("feed_id", "file_no", "record_id", "_e.path", "_e.value").where("value is not null")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p6_found, p6_unified, p6_compared, p6_fields)}

_DAY = """coalesce(
  try_cast(case when regexp_full_match(trim(shutdown_date), '\\d{4}[-/]\\d{2}[-/]\\d{2}.*') then replace(substr(trim(shutdown_date), 1, 10), '/', '-')
                when regexp_full_match(trim(shutdown_date), '\\d{8}') then strftime(try_strptime(trim(shutdown_date), '%Y%m%d'), '%Y-%m-%d') end as date),
  try_strptime(trim(shutdown_date), '%b %d, %Y')::date)"""

_ABBREVIATED = ", ".join(f"('{name}', {(-1 if offset[0] == '-' else 1) * (int(offset[1:3]) * 60 + int(offset[4:]))})" for name, offset in ABBREVIATIONS.items())
_MONTHS = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(lower({m}), 3))"

_LEAVES = """recs as (select distinct feed_id, file_no, record_id, case when json_valid(payload) then payload::json end j from list_payload where feed_id is not null and file_no is not null),
leaf as (select r.feed_id, r.file_no, r.record_id, replace(substr(t.fullkey, 3), '"', '') path, t.type, t.value v, t.value->>'$' txt from recs r, json_tree(r.j) t
  where json_type(r.j) = 'OBJECT' and t.type not in ('OBJECT', 'NULL') and t.fullkey <> '$' and not regexp_matches(t.fullkey, '\\[\\d+\\]')),
kinded as (select *, case type when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'ARRAY' then 'array' else 'integer' end kind,
  case when type not in ('BOOLEAN', 'ARRAY') and regexp_full_match(txt, '[+-]?\\d+(\\.\\d+)?([eE][+-]?\\d+)?') then coalesce(try_cast(txt as decimal(38, 12)), try_cast(try_cast(txt as double) as decimal(38, 12))) end num from leaf),
said as (select *, case when num is not null then regexp_replace(regexp_replace(num::varchar, '0+$', ''), '\\.$', '') when type = 'ARRAY' then lower(v::varchar) else lower(txt) end canon from kinded),
named as (select *, max(txt) filter (path = 'id') over (partition by feed_id, file_no, record_id) id from said)"""

_EFFORT = "list_position(['capabilities.effort.supported', 'capabilities.reasoning_effort.supported', 'capabilities.effort', 'supports_effort'], path)"
_CONTEXT = "list_position(['max_model_len', 'maxModelLen', 'context_window', 'contextWindow', 'limits.context_window', 'context_length'], path)"

SQL = {
    "p6_fields": f"with {_LEAVES} select distinct feed_id, file_no, record_id, path, canon \"value\" from named",
    "p6_compared": f"""
with {_LEAVES}, records as (select feed_id, file_no, record_id from recs where json_type(j) = 'OBJECT' group by all),
facts as (select feed_id, file_no, record_id, max(id) id, arg_min(canon, {_EFFORT}) filter ({_EFFORT} is not null) e, arg_min(path, {_EFFORT}) filter ({_EFFORT} is not null) effort_path,
  arg_min(canon, {_CONTEXT}) filter ({_CONTEXT} is not null) c, arg_min(path, {_CONTEXT}) filter ({_CONTEXT} is not null) context_path from named group by all)
select feed_id, file_no, record_id, id, case when e in ('true', '1') then true when e in ('false', '0') then false end effort_supported, effort_path,
  case when regexp_full_match(c, '\\d{{1,18}}') then c::bigint end context_limit, context_path from records left join facts using (feed_id, file_no, record_id)""",
    "p6_found": f"""
with {_LEAVES},
vals as (select distinct feed_id, file_no, id, path, canon from named where id is not null), there as (select distinct feed_id, file_no, id from vals),
files as (select feed_id, file_no, lag(file_no) over (partition by feed_id order by file_no) before from (select distinct feed_id, file_no from list_payload where feed_id is not null and file_no is not null)),
kinds as (select feed_id, file_no, path, list_sort(list(distinct kind)) k from said group by all),
later as (select f.feed_id, f.file_no, path, k from files f join kinds k on k.feed_id = f.feed_id and k.file_no = f.file_no where before is not null),
sooner as (select f.feed_id, f.file_no, path, k from files f join kinds k on k.feed_id = f.feed_id and k.file_no = f.before),
f as (select feed_id, file_no, path, n.k nk, o.k ok from later n full join sooner o using (feed_id, file_no, path) where n.k is distinct from o.k),
have as (select g.feed_id, g.file_no, g.path x, o.id, o.canon from f g join files using (feed_id, file_no) join vals o on o.feed_id = g.feed_id and o.file_no = files.before and o.path = g.path
  join there t on t.feed_id = g.feed_id and t.file_no = g.file_no and t.id = o.id where g.nk is null),
total as (select feed_id, file_no, x, count(distinct id) n from have group by all),
equal as (select h.feed_id, h.file_no, h.x, c.path y, count(distinct h.id) e from have h join f c on c.feed_id = h.feed_id and c.file_no = h.file_no and c.ok is null
  join vals v on v.feed_id = h.feed_id and v.file_no = h.file_no and v.path = c.path and v.id = h.id and v.canon = h.canon group by all),
fit as (select feed_id, file_no, x, list(y order by y) ys from equal join total using (feed_id, file_no, x) where e >= 0.9 * n - 1e-9 group by all),
options as (select feed_id, file_no, list([{{'x': x, 'ys': ys, 'y': null::varchar}}] order by x) os from fit group by all),
taken as (select feed_id, file_no, unnest(list_reduce(os, lambda acc, e: list_append(acc, {{'x': e[1].x, 'ys': e[1].ys, 'y': list_filter(e[1].ys, lambda y: not list_contains(list_transform(acc, lambda t: t.y), y))[1]}}), [{{'x': null::varchar, 'ys': []::varchar[], 'y': null::varchar}}])) r from options),
renames as (select feed_id, file_no, r.x x, r.y y from taken where r.y is not null)
select feed_id, file_no, path field_name, case when ok is null then 'added' when nk is null then 'removed' else 'retyped' end change_kind from f
  where not exists (select 1 from renames r where r.feed_id = f.feed_id and r.file_no = f.file_no and f.path in (r.x, r.y))
union all select feed_id, file_no, y, 'renamed' from renames
union all select r.feed_id, r.file_no, r.y, 'retyped' from renames r join f a on a.feed_id = r.feed_id and a.file_no = r.file_no and a.path = r.y join f b on b.feed_id = r.feed_id and b.file_no = r.file_no and b.path = r.x where a.nk <> b.ok""",
    "p4_found": rf"""
with long as (select distinct listing_id, source_id, field_name, trim(regexp_replace(t, '\s+', ' ', 'g')) t from (
  select listing_id, source_id, 'created' field_name, created t from model_listing union all select listing_id, source_id, 'created_at', created_at from model_listing
  union all select listing_id, source_id, 'openrouter.created', openrouter.created::varchar from model_listing union all select listing_id, source_id, 'fetched_at', fetched_at from model_listing) where listing_id is not null and t is not null),
zoned as (select l.*, coalesce(tz_name, 'UTC') tz, lower(coalesce(date_order, '')) o from long l left join source_zone using (source_id)),
numbered as (select *, case when regexp_full_match(t, '[+-]?\d+(\.\d*)?([eE][+-]?\d+)?') then try_cast(t as decimal(38, 10)) end n from zoned),
counted as (select *, case when n >= 1420070400 and n < 2051222400 then floor(n * 1000000)::hugeint when n >= 1420070400000 and n < 2051222400000 then floor(n * 1000)::hugeint
  when n >= 1420070400000000 and n < 2051222400000000 then floor(n)::hugeint when n >= 1420070400000000000 and n < 2051222400000000000 then floor(n)::hugeint // 1000 end us from numbered),
split as (select *, case
  when regexp_matches(t, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(\D|$)') then regexp_extract(t, '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(.*)$', ['y', 'm', 'd', 'r'])
  when regexp_matches(t, '^\d{{8}}(\D|$)') then regexp_extract(regexp_replace(t, '^(\d{{8}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})', '\1T\2:\3:\4'), '^(\d{{4}})(\d{{2}})(\d{{2}})(.*)$', ['y', 'm', 'd', 'r'])
  when regexp_matches(t, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}') and (o = 'mdy' or o <> 'dmy' and regexp_extract(t, '^\d{{1,2}}[-/.](\d{{1,2}})', 1)::int > 12) then regexp_extract(t, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(.*)$', ['m', 'd', 'y', 'r'])
  when regexp_matches(t, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}') and (o = 'dmy' or o <> 'mdy' and regexp_extract(t, '^(\d{{1,2}})', 1)::int > 12) then regexp_extract(t, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(.*)$', ['d', 'm', 'y', 'r'])
  when regexp_matches(t, '^([A-Za-z]+, )?\d{{1,2}} [A-Za-z]{{3,9}} \d{{4}}') then regexp_extract(t, '^(?:[A-Za-z]+, )?(\d{{1,2}}) ([A-Za-z]{{3,9}}) (\d{{4}})(.*)$', ['d', 'm', 'y', 'r'])
  when regexp_matches(t, '^[A-Za-z]{{3,9}} \d{{1,2}}, \d{{4}}') then regexp_extract(t, '^([A-Za-z]{{3,9}}) (\d{{1,2}}), (\d{{4}})(.*)$', ['m', 'd', 'y', 'r']) end p from counted where us is null),
timed as (select *, regexp_extract(p.r, '^(?:[T ](\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?:[.,](\d+))?(?: ([AP])M)?)? ?([A-Za-z/_]*)((?:[+-]\d{{2}}:?\d{{2}})?)(?:\[.*\])?$', ['h', 'i', 's', 'f', 'ap', 'z', 'off']) c,
  regexp_full_match(p.r, '(?:[T ]\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[.,]\d+)?(?: [AP]M)?)? ?[A-Za-z/_]*(?:[+-]\d{{2}}:?\d{{2}})?(?:\[.*\])?') whole from split where p is not null),
local as (select *, try_cast(p.y || '-' || lpad(case when regexp_full_match(p.m, '\d+') then p.m else coalesce({_MONTHS.format(m='p.m')}::varchar, '99') end, 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' ||
  lpad((case when c.h = '' then 0 when c.ap = '' then c.h::int when c.h::int between 1 and 12 then c.h::int % 12 + case when c.ap = 'P' then 12 else 0 end else 99 end)::varchar, 2, '0') || ':' || case when c.i = '' then '00' else c.i end || ':' ||
  case when c.s = '' then '00' else c.s end || '.' || rpad(left(c.f, 6), 6, '0') as timestamp) moment from timed where whole),
abbreviated(z, minutes) as (values {_ABBREVIATED}),
placed as (select l.*, a.minutes, case when c.z = '' then l.tz when contains(c.z, '/') then c.z end region from local l left join abbreviated a on a.z = upper(c.z) where moment is not null),
instants as (select *, case when c.off <> '' then epoch_us(moment) - (case when left(c.off, 1) = '-' then -1 else 1 end) * (substr(c.off, 2, 2)::int * 60 + right(c.off, 2)::int)::bigint * 60000000
  when minutes is not null then epoch_us(moment) - minutes::bigint * 60000000
  when timezone(region, timezone(region, moment) - interval 1 hour) = moment then epoch_us(timezone(region, moment)) - 3600000000 else epoch_us(timezone(region, moment)) end u from placed where c.off <> '' or minutes is not null or region is not null)
select listing_id, field_name, us::bigint utc_us from counted where us is not null union select listing_id, field_name, u::bigint from instants where u >= 1420070400000000 and u < 2051222400000000""",
    "p1_found": f"""
with latest as (select feed_id, snapshot_no, arg_max(completeness, observed_at) c from observation group by all),
pairs as (select feed_id, snapshot_no, lag(snapshot_no) over (partition by feed_id order by snapshot_no) before from latest where c = 'complete'),
held as (select feed_id, snapshot_no, id, arg_max(struct_pack(a := active, d := {_DAY}), received_at) v from model_snapshot group by all),
now as (select p.feed_id, p.snapshot_no, h.id, h.v from pairs p join held h using (feed_id, snapshot_no) where p.before is not null),
old as (select p.feed_id, p.snapshot_no, h.id, h.v from pairs p join held h on h.feed_id = p.feed_id and h.snapshot_no = p.before)
select feed_id, snapshot_no, id, case when o.v is null then 'added' when n.v is null then 'removed' else 'changed' end change_kind
from now n full join old o using (feed_id, snapshot_no, id)
where o.v is null or n.v is null or n.v.a is distinct from o.v.a or n.v.d is distinct from o.v.d""",
    "p3_found": """
with p as (select distinct payload_id, payload::json j from endpoint_payload where json_valid(payload)),
d as (select payload_id, case when json_type(j, '$.data') = 'VARCHAR' then (j->>'$.data')::json else j->'$.data' end d from p),
e as (select payload_id, d, case json_type(d, '$.endpoints') when 'ARRAY' then cast(d->'$.endpoints' as json[]) when 'OBJECT' then [d->'$.endpoints'] end es,
  case json_type(d, '$.architecture.input_modalities') when 'ARRAY' then cast(d->>'$.architecture.input_modalities[*]' as varchar[])
       when 'VARCHAR' then string_split(d->>'$.architecture.input_modalities', ',') end ms from d),
x as (select payload_id, unnest(es) item, unnest(range(len(es))) pos from e),
m as (select payload_id, unnest(ms) item, unnest(range(len(ms))) pos from e)
select payload_id, 'provider_name' field_name, pos::int item_pos, trim(item->>'$.provider_name') found_value from x where trim(item->>'$.provider_name') <> ''
union all select payload_id, 'context_length', pos::int, cast(trim(item->>'$.context_length')::double::bigint as varchar) from x where item->>'$.context_length' is not null
union all select payload_id, 'input_modality', pos::int, trim(item) from m where trim(item) <> ''""",
}
