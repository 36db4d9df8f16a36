"""Queries of reconciliation, evidence and typed differences over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..functions import scalars as S
from ..operators.diff import change_rows
from ..operators.ranking import fact_by_evidence
from ..operators.reconcile import Reconciled, reconcile
from ..operators.typed_diff import AUTHOR_PATHS, MODEL_PATHS, PROVIDER_PATHS, typed_changes

#: The sources of the listings by their names in the policies; mirrors have none.
SOURCES = {"providers": "providers", "models_dev": "models_dev_http", "local_catalog": "local_catalog", "openrouter": "release_artifact", "archive_east": "embedded_catalog"}
CUT = "2024-01-01"


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Listings as observations of models."""
    sane = lambda n: F.nullif(F.col(n), F.lit(2**63 - 1))
    limits = F.struct(sane("openrouter.context_length").alias("context_window"), sane("max_input_tokens").alias("input_tokens"))
    return table(spark, sf, "model_listing").select(
        "model_ref", S.mapped(F.col("source_id"), SOURCES, F.col("source_id")).alias("source"), F.col("id").alias("name"),
        F.array_compact(F.array("owned_by")).alias("authors"), limits.alias("limits"), F.col("openrouter.prompt").alias("pricing"), "observed_at", "listing_id",
    )


def _merged(rows: DataFrame, **options) -> Reconciled:
    seen = [F.col("observed_at"), F.col("listing_id")]
    return reconcile(rows, "model", ["model_ref"], "source", seen=seen, **options)


_SQL_SOURCE = "case source_id " + " ".join(f"when '{a}' then '{b}'" for a, b in SOURCES.items()) + " else source_id end"
_PROVIDER_FIRST = "list_position(['providers', 'models_dev_http', 'models_dev_git', 'local_catalog', 'release_artifact', 'embedded_catalog'], source)"
_UPSTREAM_FIRST = "list_position(['models_dev_http', 'models_dev_git', 'providers', 'local_catalog', 'release_artifact', 'embedded_catalog'], source)"


def _sql_merged(name: str, where: str = "true") -> str:
    """Common tables with the latest row of each source (`name`_l) and the claims that win (`name`)."""
    first = lambda value, claim, what: f"arg_min({value}, {_PROVIDER_FIRST}) filter ({claim} and {_PROVIDER_FIRST} is not null) {what}"
    return f"""{name}_o as (select distinct model_ref, {_SQL_SOURCE} source, observed_at, listing_id, id, owned_by, nullif(openrouter.context_length, 9223372036854775807) c, nullif(max_input_tokens, 9223372036854775807) i, openrouter.prompt p from model_listing where {where}),
{name}_l as (select * exclude n from (select *, row_number() over (partition by model_ref, source order by observed_at desc nulls last, listing_id desc, id desc nulls last, owned_by desc nulls last, c desc nulls last, i desc nulls last, p desc nulls last) n from {name}_o where model_ref is not null and source is not null) where n = 1),
{name} as (select model_ref, {first('id', "trim(id) <> ''", 'name')}, {first('source', "trim(id) <> ''", 'name_source')},
 list_sort(list(distinct owned_by) filter (owned_by is not null and {_PROVIDER_FIRST} is not null)) authors,
 {first('c', 'c is not null', 'context_window')}, {first('i', 'i is not null', 'input_tokens')}, {first('source', 'true', 'lead')},
 {first('p', "trim(p) <> ''", 'pricing')}, {first('source', "trim(p) <> ''", 'pricing_source')} from {name}_l group by 1)"""


def reconcile_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = _merged(_observed(spark, sf)).rows
    return rows.select("model_ref", "name", F.array_sort("authors").alias("authors"), "limits.context_window", "limits.input_tokens", "pricing")


def reconcile_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(_observed(spark, sf).drop("authors")).provenance.drop("reason")


def reconcile_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the later observations change in a catalog made of the earlier ones; nothing is lost that they don't mention."""
    rows = _observed(spark, sf).drop("authors")
    before = _merged(rows.where(F.col("observed_at") < F.lit(CUT).cast("timestamp_ntz"))).rows
    later = rows.where(F.coalesce(F.col("observed_at") >= F.lit(CUT).cast("timestamp_ntz"), F.lit(True)))
    return change_rows(_merged(later, baseline=before).changes, ["model_ref"])


_SCORE = "(7 - list_position({order}, {source})) / 6.0"
_BEFORE, _LATER = f"observed_at < timestamp '{CUT} 00:00:00'", f"coalesce(observed_at >= timestamp '{CUT} 00:00:00', true)"
_LIMITS = "case when {c} is null and {i} is null then '{{}}' else '{{' || concat_ws(',', '\"context_window\":' || {c}, '\"input_tokens\":' || {i}) || '}}' end"
_UNITED = "coalesce(n.{c}, o.{c})"


def _provider_rows(spark: SparkSession, sf: str) -> DataFrame:
    local = table(spark, sf, "provider").select("id", F.lit("local_catalog").alias("source"), "name", "aliases", "headquarters", "status_page_url")
    seen = table(spark, sf, "model_snapshot").groupBy(F.col("provider_id").alias("id")).agg(F.min("owned_by").alias("name"))
    served = seen.select("id", F.lit("models_dev_http").alias("source"), "name", F.array(F.upper("id")).alias("aliases"), F.lit(None).cast("string").alias("headquarters"), F.lit(None).cast("string").alias("status_page_url"))
    return local.unionByName(served)


def reconcile_providers(spark: SparkSession, sf: str) -> DataFrame:
    primary = table(spark, sf, "model_listing").where("source_id = 'providers'").select(F.col("provider_id").alias("id")).distinct()
    found = reconcile(_provider_rows(spark, sf), "provider", ["id"], "source", primary=primary, aliases="aliases").rows
    return found.select("id", "name", "headquarters", "status_page_url", F.array_sort("aliases").alias("aliases"))


def fact_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The input limit of each model by the evidence behind it, unknown where the best disagree."""
    listed = table(spark, sf, "source_authority").where("field_name = 'max_input_tokens'").select(F.col("source_id").alias("_source"), "priority")
    facts = table(spark, sf, "model_listing").join(F.broadcast(listed), F.col("source_id") == F.col("_source"), "left")  # fixed, a few rows
    evidence = {
        "has_evidence": F.col("priority").isNotNull(), "authority": 1 / F.col("priority"), "observed_at": F.date_trunc("year", "observed_at"),
        "confidence": F.when(F.col("max_input_tokens") > 0, 1.0).otherwise(0.0),
    }
    return fact_by_evidence(facts, ["model_ref"], evidence, "max_input_tokens", "provider_id")


def _first_and_last(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each provider's models as they were delivered first and last."""
    rows = table(spark, sf, "model_snapshot")
    row = F.struct("received_at", "feed_id", "snapshot_no", "active", "context_window", "max_completion_tokens", "owned_by", "created")
    both = rows.groupBy("provider_id", "id").agg(F.min(row).alias("old"), F.max(row).alias("new"))
    return tuple(both.select("provider_id", "id", f"{s}.active", f"{s}.context_window", f"{s}.max_completion_tokens", f"{s}.owned_by", f"{s}.created") for s in ("old", "new"))


_VERSIONS = """b as (select provider_id, id, min(struct_pack(r := received_at, f := feed_id, s := snapshot_no, a := active, c := context_window, m := max_completion_tokens, o := owned_by, k := created)) x,
max(struct_pack(r := received_at, f := feed_id, s := snapshot_no, a := active, c := context_window, m := max_completion_tokens, o := owned_by, k := created)) y from model_snapshot group by 1, 2)"""


def diff_features(spark: SparkSession, sf: str) -> DataFrame:
    def features(df: DataFrame) -> DataFrame:
        modes = F.struct(F.filter(F.split(F.lower("owned_by"), "[^a-z]+"), lambda x: x != "").alias("input"))
        flags = F.struct(S.presence(F.col("active"), F.lit(True)).alias("streaming"), S.presence(F.col("context_window") > 100_000, F.col("context_window").isNotNull()).alias("tools"), modes.alias("modalities"))
        return df.select("provider_id", "id", F.when(F.col("max_completion_tokens").isNotNull(), flags).alias("features"))

    old, new = _first_and_last(spark, sf)
    return change_rows(typed_changes(features(old), features(new), ["provider_id", "id"], MODEL_PATHS), ["provider_id", "id"])


def diff_limits(spark: SparkSession, sf: str) -> DataFrame:
    def limits(df: DataFrame) -> DataFrame:
        said = lambda c: S.presence(F.col(c), F.coalesce(F.col("active"), F.lit(False)) | F.col(c).isNotNull())
        return df.select("provider_id", "id", F.struct(said("context_window").alias("context_window"), said("max_completion_tokens").alias("output_tokens")).alias("limits"))

    old, new = _first_and_last(spark, sf)
    return change_rows(typed_changes(limits(old), limits(new), ["provider_id", "id"], MODEL_PATHS), ["provider_id", "id"])


def diff_metadata(spark: SparkSession, sf: str) -> DataFrame:
    def facts(df: DataFrame) -> DataFrame:
        metadata = F.struct(
            F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created") / 86_400).cast("int")).alias("release_date"), S.presence(F.col("active"), F.lit(True)).alias("open_weights"),
            F.filter(F.split("owned_by", " "), lambda x: x != "").alias("tags"),
        )
        return df.select("provider_id", "id", S.presence(F.nullif(F.col("owned_by"), F.lit("")), F.col("owned_by").isNotNull()).alias("description"), F.when(F.col("context_window").isNotNull(), metadata).alias("metadata"))

    old, new = _first_and_last(spark, sf)
    return change_rows(typed_changes(facts(old), facts(new), ["provider_id", "id"], MODEL_PATHS), ["provider_id", "id"])


def diff_providers(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "provider").withColumn("catalog", F.struct(F.length("name").alias("n")))
    new = old.where("id > 'b'").select("id", F.trim(F.replace("name", F.lit("Cloud"))).alias("name"), F.array_distinct(F.concat("aliases", F.array(F.upper("id")))).alias("aliases"), F.coalesce("headquarters", F.lit("Vask")).alias("headquarters"), F.lit(None).cast("string").alias("status_page_url"))
    new = new.withColumn("catalog", F.struct(F.length("name").alias("n")))
    return change_rows(typed_changes(old, new, ["id"], PROVIDER_PATHS), ["id"])


def diff_authors(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "author")
    new = old.select("id", F.initcap("name").alias("name"), F.coalesce("website", F.lit("")).alias("website"), F.reverse("description").alias("description"))
    return change_rows(typed_changes(old, new, ["id"], AUTHOR_PATHS), ["id"])


QUERIES = {f.__name__: f for f in (reconcile_models, reconcile_provenance, reconcile_changes, reconcile_providers, fact_rank, diff_features, diff_limits, diff_metadata, diff_providers, diff_authors)}

_PRESENT = "case when {s} = 0 then 'missing' when {s} = 1 then 'unknown' else {v} end"


def _sql_presence(value: str, claimed: str, shown: str) -> tuple[str, str]:
    """(state, text) of a value that may be unstated."""
    state = f"case when not coalesce({claimed}, false) then 0 when {value} is null then 1 else 2 end"
    return state, _PRESENT.format(s=f"({state})", v=shown)


def _sql_diff(path: str, value: str, claimed: str, shown: str, where: str) -> str:
    (s0, t0), (s1, t1) = (_sql_presence(*(x.replace("$", side) for x in (value, claimed, shown))) for side in ("x", "y"))
    return f"select provider_id, id, 'updated' change_type, '{path}' path, {t0} old, {t1} \"new\" from b where {where} and ({s0} <> {s1} or {s0} = 2 and ({value.replace('$', 'x')}) is distinct from ({value.replace('$', 'y')}))"


_SHORT = "case when {v} >= 1000000 then printf('%.1fM', {v} / 1000000) when {v} >= 1000 then printf('%.1fK', {v} / 1000) else ({v})::varchar end"
_BOTH = "x.m is not null and y.m is not null"
_WORDS = "coalesce(array_to_string(list_filter(regexp_split_to_array(lower({s}.o), '[^a-z]+'), lambda w: w <> ''), ','), '')"

_KNOWN = "x.c is not null and y.c is not null"
_DAY = "(date '1970-01-01' + floor({s}.k / 86400)::integer)"
_TAGS = "list_filter(string_split({s}.o, ' '), lambda w: w <> '')"

SQL = {
    "reconcile_models": f"with {_sql_merged('m')} select model_ref, name, authors, context_window, input_tokens, pricing from m",
    "reconcile_provenance": f"""with {_sql_merged('m')} select model_ref, 'name' field, name_source source, name \"value\", {_SCORE.format(order="['providers', 'models_dev_http', 'models_dev_git', 'local_catalog', 'release_artifact', 'embedded_catalog']", source='name_source')}::double authority from m where name is not null
union all select model_ref, 'pricing', pricing_source, pricing, {_SCORE.format(order="['providers', 'models_dev_http', 'models_dev_git', 'local_catalog', 'release_artifact', 'embedded_catalog']", source='pricing_source')}::double from m where pricing is not null
union all select model_ref, 'limits', lead, {_LIMITS.format(c='context_window', i='input_tokens')}, {_SCORE.format(order="['providers', 'models_dev_http', 'models_dev_git', 'local_catalog', 'release_artifact', 'embedded_catalog']", source='lead')}::double from m where lead is not null""",
    "reconcile_changes": f"""with {_sql_merged('o', _BEFORE)}, {_sql_merged('n', _LATER)},
j as (select coalesce(n.model_ref, o.model_ref) model_ref, o.model_ref is null fresh, o.name a0, coalesce(n.name, o.name) a1, o.pricing p0, coalesce(n.pricing, o.pricing) p1,
 case when o.lead is not null then {_LIMITS.format(c='o.context_window', i='o.input_tokens')} end l0,
 case when n.lead is not null then {_LIMITS.format(c='n.context_window', i='n.input_tokens')} when o.lead is not null then {_LIMITS.format(c='o.context_window', i='o.input_tokens')} end l1 from o full join n using (model_ref))
select model_ref, 'added' change_type, null path, null old, null \"new\" from j where fresh
union all select model_ref, 'updated', 'name', a0, a1 from j where not fresh and a0 is distinct from a1
union all select model_ref, 'updated', 'limits', l0, l1 from j where not fresh and l0 is distinct from l1
union all select model_ref, 'updated', 'pricing', p0, p1 from j where not fresh and p0 is distinct from p1""",
    "reconcile_providers": """with s as (select provider_id id, min(owned_by) name from model_snapshot group by 1), k as (select distinct provider_id id from model_listing where source_id = 'providers'),
j as (select coalesce(s.id, p.id) id, case when trim(s.name) <> '' then s.name else case when trim(p.name) <> '' then p.name end end name, case when trim(p.headquarters) <> '' then p.headquarters end headquarters, case when trim(p.status_page_url) <> '' then p.status_page_url end status_page_url,
 list_concat(coalesce(p.aliases, []), case when s.id is not null then [upper(s.id)] else [] end) aliases from provider p full join s using (id))
select id, name, headquarters, status_page_url, nullif(list_sort(list_distinct(aliases)), []) aliases from j where id is not null and (id in (select id from k) or list_has_any(aliases, (select list(id) from k)))""",
    "fact_rank": """with f as (select l.model_ref, l.max_input_tokens v, l.provider_id p, a.priority, rank() over (partition by l.model_ref order by a.priority is not null desc, 1.0 / a.priority desc nulls last, date_trunc('year', l.observed_at) desc nulls last, case when l.max_input_tokens > 0 then 1.0 else 0.0 end desc) r
 from model_listing l left join source_authority a on a.field_name = 'max_input_tokens' and a.source_id = l.source_id where l.max_input_tokens is not null)
select model_ref, case when min(v) = max(v) then min(v) end max_input_tokens, min(struct_pack(v := v, p := p)).p provider_id, min(v) = max(v) agreed, min(v) held from f where r = 1 group by 1""",
    "diff_features": f"""with {_VERSIONS}, f as (select provider_id, id, 'updated' change_type, 'features' path, (x.m is not null)::varchar old, (y.m is not null)::varchar \"new\" from b where (x.m is null) <> (y.m is null))
select * from f union all {_sql_diff('features.streaming', '$.a', 'true', '($.a)::varchar', _BOTH)} union all {_sql_diff('features.tools', '($.c > 100000)', '($.c is not null)', '($.c > 100000)::varchar', _BOTH)}
union all select provider_id, id, 'updated', 'features.modalities.input', {_WORDS.format(s='x')}, {_WORDS.format(s='y')} from b where {_BOTH} and {_WORDS.format(s='x')} <> {_WORDS.format(s='y')}""",
    "diff_limits": f"""with {_VERSIONS} {_sql_diff('limits.context_window', '$.c', '(coalesce($.a, false) or $.c is not null)', _SHORT.format(v='$.c'), 'true')} union all {_sql_diff('limits.output_tokens', '$.m', '(coalesce($.a, false) or $.m is not null)', _SHORT.format(v='$.m'), 'true')}""",
    "diff_metadata": f"""with {_VERSIONS}, s as (select provider_id, id, 'updated' change_type, 'metadata' path, (x.c is not null)::varchar old, (y.c is not null)::varchar \"new\" from b where (x.c is null) <> (y.c is null))
select * from s union all {_sql_diff('description', "nullif($.o, '')", '($.o is not null)', "nullif($.o, '')", 'true')}
union all select provider_id, id, 'updated', 'metadata.release_date', coalesce({_DAY.format(s='x')}::varchar, ''), coalesce({_DAY.format(s='y')}::varchar, '') from b where {_KNOWN} and {_DAY.format(s='x')} is distinct from {_DAY.format(s='y')}
union all {_sql_diff('metadata.open_weights', '$.a', 'true', '($.a)::varchar', _KNOWN)}
union all select provider_id, id, 'updated', 'metadata.tags', coalesce(len({_TAGS.format(s='x')}), 0) || ' tags', coalesce(len({_TAGS.format(s='y')}), 0) || ' tags' from b where {_KNOWN} and {_TAGS.format(s='x')} is distinct from {_TAGS.format(s='y')}""",
    "diff_providers": """with n as (select id, trim(replace(name, 'Cloud', '')) name, list_distinct(list_append(aliases, upper(id))) aliases, coalesce(headquarters, 'Vask') headquarters from provider where id > 'b')
select id, 'removed' change_type, null path, null old, null "new" from provider where id not in (select id from n)
union all select id, 'updated', 'name', p.name, n.name from provider p join n using (id) where p.name <> n.name
union all select id, 'updated', 'aliases', len(p.aliases) || ' aliases', len(n.aliases) || ' aliases' from provider p join n using (id) where list_sort(p.aliases) <> list_sort(n.aliases)
union all select id, 'updated', 'headquarters', coalesce(p.headquarters, ''), n.headquarters from provider p join n using (id) where p.headquarters is null
union all select id, 'updated', 'catalog', 'settings changed', 'updated' from provider p join n using (id) where length(p.name) <> length(n.name)
union all select id, 'updated', 'status_page_url', status_page_url, '' from provider where id > 'b' and status_page_url is not null""",
    "diff_authors": """with n as (select id, name, array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') low, coalesce(description, '') d, reverse(coalesce(description, '')) e from author)
select id, 'updated' change_type, 'name' path, name old, low "new" from n where name <> low
union all select id, 'updated', 'description', case when length(d) <= 50 then d else left(d, 47) || '...' end, case when length(e) <= 50 then e else left(e, 47) || '...' end from n where d <> e""",
}
