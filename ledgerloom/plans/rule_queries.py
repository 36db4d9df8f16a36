"""Queries of scalar rules, projections, invariants, references and converters over the driver's tables, each beside its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import file_uri, shared_folder, shared_uri, table
from ..engine import Engine
from ..functions import scalars as S
from ..operators import authority as A
from ..operators import filters as P
from ..operators import invariants as I
from ..operators import lookup as L
from ..operators import projections as J
from ..operators import setops as U
from ..operators.reconcile import reconcile
from ..snapshots import GenerationStore
from ..sources.converters import anthropic_models, google_models, upstream_models
from ..sources.payloads import oversized, strict_problems
from ..sources.workspace import read_provenance, write_provenance
from ..streaming.publications import frames, parse_frames
from .catalog_queries import _MODELS, _PUBLICATIONS, _publications, models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _texts(*values: str | None):  # noqa: ANN202
    return F.array(*(F.lit(v).cast("string") for v in values))


# Scalars.


@query("""select p_partkey, case when p_size > 25 then list_filter(['minimum', 'high', case when p_type in ('LOW', 'MEDIUM', 'HIGH') then lower(p_type) end], lambda x: x is not null) end levels, case when p_size > 25 then list_filter(['minimal', 'high', case when p_type in ('LOW', 'MEDIUM', 'HIGH') then lower(p_type) end], lambda x: x is not null) end shown, case when p_size = 1 then 0 else p_size end::bigint low, case when p_size = 1 then 2 else 0 end::bigint high from part""")
def effort_options(spark: SparkSession, sf: str) -> DataFrame:
    option = lambda kind, values, low, high: F.struct(kind.alias("type"), values.alias("values"), low.cast("bigint").alias("min"), high.cast("bigint").alias("max"))
    none = F.lit(None)
    options = F.array(
        option(F.lit("tokens"), none.cast("array<string>"), F.nullif(F.col("p_size"), F.lit(1)), none),
        option(F.when(F.col("p_size") > 25, "Effort").otherwise("other"), F.concat(_texts("minimal", "HIGH ", "none"), F.array("p_type")), none, none),
        option(F.lit("budget"), none.cast("array<string>"), none, F.col("p_size") * 2),
    )
    rows = table(spark, sf, "part").select("p_partkey", S.effort_levels(options).alias("levels"), S.token_range(options).alias("r"))
    return rows.select("p_partkey", "levels", F.transform("levels", S.shown_effort).alias("shown"), "r.min", "r.max").withColumnsRenamed({"min": "low", "max": "high"})


@query("""select p_partkey, case when p_size % 5 = 1 then ['text', 'audio'] else ['text'] end ins, case when p_size > 40 then ['video'] else case p_size % 5 when 0 then ['embedding'] when 2 then ['audio'] when 3 then ['image'] else ['text'] end end outs from part""")
def tag_modalities(spark: SparkSession, sf: str) -> DataFrame:
    first = F.coalesce(F.get(_texts("embed", "STT", "tts", "image-gen"), F.col("p_size") % 5), F.col("p_type"))
    tags = F.array_compact(F.array(first, F.when(F.col("p_size") > 40, "Text_To_Video")))
    told = S.modalities_by_tags(_texts("text"), _texts("text"), tags)
    return table(spark, sf, "part").select("p_partkey", told["input"].alias("ins"), told["output"].alias("outs"))


@query("""select p_partkey, case p_size % 3 when 0 then ['reasoning', 'tool_calls', 'tool_choice', 'tools'] when 1 then ['reasoning', 'structured_outputs'] else ['reasoning'] end flags, case when p_size > 20 then ['top_p', 'seed'] else ['top_p'] end sampling,
concat_ws(', ', case when p_size > 10 then 'vision' end, case when p_size > 30 then 'audio_output' end, case when p_size % 2 = 0 then 'tool_calls' end, 'reasoning') label from part""")
def listed_flags(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    names = F.array(F.get(_texts("TOOLS", "json_schema", "thinking"), size % 3), F.col("p_type"), F.lit("Thinking"))
    label = S.feature_label(F.when(size > 10, _texts("text", "image")), F.when(size > 30, _texts("audio")), {"tool_calls": size % 2 == 0, "web_search": F.lit(None).cast("boolean"), "reasoning": F.lit(True)})
    sampling = F.array_compact(F.array(F.lit("Top_P"), F.when(size > 20, "seed")))
    return table(spark, sf, "part").select("p_partkey", F.array_sort(S.flags_of(names, S.FEATURE_FLAGS)).alias("flags"), S.flags_of(sampling, S.SAMPLING_FLAGS).alias("sampling"), label.alias("label"))


_PATHS = "['description', 'features.tools', 'limits', 'price', 'Delivery', 'ReasoningTokens', 'Metadata.Tags', 'featuresX']"


@query(f"""with p as (select event_id, ({_PATHS})[event_id % 8 + 1] p from events), n as (select *, case p when 'Delivery' then 'response' when 'ReasoningTokens' then 'reasoning_tokens' else lower(p) end n from p)
select event_id, n normal, p in ('description', 'attachments', 'generation', 'reasoning', 'reasoning_tokens', 'verbosity', 'tools', 'response') or starts_with(p, 'features') or starts_with(p, 'pricing') or starts_with(p, 'limits') or starts_with(p, 'metadata') enriched, n = 'features' or starts_with(n, 'features.') covered from n""")
def change_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.get(_texts("description", "features.tools", "limits", "price", "Delivery", "ReasoningTokens", "Metadata.Tags", "featuresX"), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select("event_id", S.normal_path(path).alias("normal"), S.is_enrichment(path).alias("enriched"), S.covers(F.lit("Features"), path).alias("covered"))


@query("""select p_partkey, coalesce(try_cast(trunc(try_cast(v as double)) as bigint), 0) long_, try_cast(trim(v) as double) double_, case when abs(round(x, 6) - x) <= abs(x) * 1e-7 then round(x, 6) else x end snapped, case when p_retailprice is null then null else format('{:,.0f}', round(p_retailprice)) end shown
from (select *, case p_size % 4 when 0 then ' 12.0 ' when 1 then '7.9' when 2 then 'many' else null end v, p_size / 10 + case when p_size % 2 = 0 then 0.000000001 else 0.0004 end x from part)""")
def scalar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    v = F.get(_texts(" 12.0 ", "7.9", "many", None), F.col("p_size") % 4)
    x = F.col("p_size") / 10 + F.when(F.col("p_size") % 2 == 0, 0.000000001).otherwise(0.0004)
    return table(spark, sf, "part").select("p_partkey", S.lenient_long(v).alias("long_"), S.optional_double(v).alias("double_"), S.snapped(x, 1e6).alias("snapped"), S.thousands(F.round("p_retailprice")).alias("shown"))


@query("""select p_partkey, list_filter(['text', lower(p_type), 'image'], lambda m: m in ('text', 'image')) modalities, list_filter([trim(p_brand), 'x'], lambda t: t <> '') tags, string_split(p_name, ' ')[-1] last_, split_part(p_name, ' ', 1) publisher from part""")
def scalar_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("publishers"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("models"), F.replace("p_name", F.lit(" "), F.lit("/")))
    return table(spark, sf, "part").select(
        "p_partkey", S.known_values(F.array(F.lit("Text "), F.col("p_type"), F.lit("IMAGE")), ("text", "image")).alias("modalities"), S.cleaned_tags(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.lit("x "))).alias("tags"),
        F.substring_index(S.last_path_part(path, "none/"), "/", -1).alias("last_"), S.part_after(path, "publishers").alias("publisher"),
    )


@query("""select o_orderkey, case when o_orderstatus = 'F' then true else o_orderdate >= timestamp '1995-01-01' end and (o_orderpriority = '5-LOW' or o_orderdate < timestamp '1997-01-01') effective,
case when o_totalprice > 300000 then 2 when o_orderstatus = 'O' then 1 when o_totalprice > 0 then 2 else 0 end::tinyint implied from orders""")
def effective_orders(spark: SparkSession, sf: str) -> DataFrame:
    start = F.when(F.col("o_orderstatus") != "F", F.lit("1995-01-01").cast("timestamp_ntz"))
    end = F.when(F.col("o_orderpriority") != "5-LOW", F.lit("1997-01-01").cast("timestamp_ntz"))
    state = F.when(F.col("o_totalprice") > 300_000, 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", S.effective_at(F.col("o_orderdate").cast("timestamp_ntz"), start, end).alias("effective"), S.implied_presence(F.col("o_totalprice"), state).alias("implied"))


# Capabilities, parameters and views.


@query(f"with {_MODELS} select provider_id, id, coalesce(active, false) or coalesce(context_window > 100000, false) tools, id like '%vision%' vision, false odd, coalesce(active, false) streaming from models")
def capability_search(spark: SparkSession, sf: str) -> DataFrame:
    flags = {"tool_calls": F.col("active"), "tools": F.col("context_window") > 100_000, "streaming": F.col("active")}
    inputs = F.when(F.col("id").contains("vision"), _texts("text", "image"))
    fits = lambda name: P.matches_capability(name, flags, inputs)
    return models(spark, sf).select("provider_id", "id", fits("Tools").alias("tools"), fits("IMAGE").alias("vision"), fits("flight").alias("odd"), fits("streaming").alias("streaming"))


@query("""select p_partkey, list_filter([case when p_size > 10 then 'tools' end, case when p_size % 2 = 0 then 'web_search_options' end, case when p_size % 3 = 0 then 'max_completion_tokens' end, 'response_format'], lambda x: x is not null) parameters,
case when p_size > 5 then p_retailprice / 1000 end temperature, case when p_size % 3 = 0 then p_size end::double most, p_size <= 5 and p_size % 3 <> 0 none from part""")
def parameter_names(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    flags = F.create_map(*(x for n, c in {"response_format": F.lit(False), "format_response": F.lit(True), "tools": size > 10, "max_output_tokens": size % 3 == 0, "web_search": size % 2 == 0, "seed": F.lit(None)}.items() for x in (F.lit(n), c.cast("boolean"))))
    told = F.create_map(*(x for n, c in {"temperature": F.when(size > 5, F.col("p_retailprice") / 1000), "max_output_tokens": F.when(size % 3 == 0, size), "top_k": F.lit(None)}.items() for x in (F.lit(n), c.cast("double"))))
    rows = table(spark, sf, "part").select("p_partkey", J.parameters_of(flags).alias("parameters"), J.defaults_of(told).alias("d"))
    return rows.select("p_partkey", "parameters", F.try_element_at("d", F.lit("temperature")).alias("temperature"), F.try_element_at("d", F.lit("max_completion_tokens")).alias("most"), F.col("d").isNull().alias("none"))


@query(f"""with {_MODELS} select provider_id, id, case when coalesce(active, false) or context_window > 100000 then coalesce(active, false) end enabled, case when context_window > 100000 then ['minimal', 'high'] when active then []::varchar[] end efforts, case when context_window > 100000 then 'minimal' end standard from models""")
def reasoning_views(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.when(F.col("context_window") > 100_000, _texts("minimum", "high"))
    rows = models(spark, sf).select("provider_id", "id", J.reasoning_view(F.col("active"), levels, F.lit("minimum")).alias("v"))
    return rows.select("provider_id", "id", F.col("v.default_enabled").alias("enabled"), F.col("v.supported_efforts").alias("efforts"), F.col("v.default_effort").alias("standard"))


@query("select a.id, a.name, count(l.listing_id) listings from author a left join (select distinct listing_id, owned_by from model_listing) l on l.owned_by = a.name group by all")
def author_counts(spark: SparkSession, sf: str) -> DataFrame:
    owned = table(spark, sf, "model_listing").select("listing_id", "owned_by").distinct().groupBy(F.col("owned_by").alias("name")).agg(F.count("listing_id").alias("n"))
    return table(spark, sf, "author").select("id", "name").join(owned, "name", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("listings"))


# Filters.


def _part_relation() -> P.Relation:
    return P.Relation(
        id=F.col("p_partkey").cast("string"), name=F.col("p_name"), status=F.lower("p_type"), input_modalities=F.when(F.col("p_size") > 5, _texts("Text", "image")), output_modalities=_texts("text"),
        tags=F.split("p_name", " "), open_weights=F.when(F.col("p_size") % 2 == 0, F.col("p_size") > 20), context_window=F.col("p_size").cast("bigint"),
    )


@query("select p_partkey from part where p_size > 5 and list_has_any(string_split(lower(p_name), ' '), ['green', 'red']) and p_size % 2 = 0 and p_size > 20 order by lower(p_name), p_partkey::varchar limit 200")
def filter_lists(spark: SparkSession, sf: str) -> DataFrame:
    wanted = P.ModelFilter(modality_input=(" IMAGE ", "text"), modality_output=("Text",), tags=("Green", "RED"), open_weights=True, sort="name", order="ASC", max_results=1000, limit=200)
    return wanted.apply(table(spark, sf, "part"), _part_relation()).select("p_partkey")


@query("select p_partkey from part where p_size >= 30 order by p_size desc, p_partkey::varchar limit 40 offset 10")
def filter_leniently(spark: SparkSession, sf: str) -> DataFrame:
    """Malformed parameters fall back to what holds without them; max_results bounds the list before the page is taken."""
    wanted = P.parse_filter({"min_context": "30", "max_output": "lots", "open_weights": "maybe", "sort": "context_window", "order": "Desc", "offset": "10", "limit": "100", "max_results": "50"})
    return wanted.apply(table(spark, sf, "part"), _part_relation()).select("p_partkey")


# Invariants and references.


_TAGGED = "case p_size % 5 when 0 then ['Embed'] when 1 then ['stt', 'x'] when 2 then ['tts'] when 3 then ['image-gen'] end"


@query("""select p_partkey, list_filter([case when p_size > 45 then 'timestamps' end, case when p_size between 20 and 30 then 'reasoning' end, case when p_size % 5 = 0 and p_size > 10 then 'embedding output' end, case when p_size % 5 = 1 and p_size > 10 then 'speech to text' end,
case when p_size % 5 = 2 and p_size > 10 then 'text to speech' end, case when p_size % 5 = 3 and p_size > 10 then 'image output' end], lambda x: x is not null) violations from part where p_size > 45 or p_size between 20 and 30 or p_size > 10 and p_size % 5 < 4""")
def fact_consistency(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    tags = F.get(F.array(_texts("Embed"), _texts("stt", "x"), _texts("tts"), _texts("image-gen")), size % 5)
    rules = I.fact_rules(created=size, updated=F.when(size > 10, F.lit(45)), reasons=F.when(size < 25, F.lit(False)), controls=[size.between(20, 30), F.lit(None).cast("boolean")], tags=tags, inputs=F.when(size > 10, _texts("text")), outputs=F.when(size > 10, _texts("text")))
    return I.checked(table(spark, sf, "part"), rules, ["p_partkey"])


@query("""select s_suppkey, list_filter([case when s_suppkey % 7 = 0 then 'id' end, case when s_acctbal < 0 then 'name' end, case when s_nationkey % 3 = 0 then 'authors' end, case when s_suppkey % 5 = 0 then 'lineage.root' end], lambda x: x is not null) violations
from supplier where s_suppkey % 7 = 0 or s_acctbal < 0 or s_nationkey % 3 = 0 or s_suppkey % 5 = 0""")
def definition_invariants(spark: SparkSession, sf: str) -> DataFrame:
    identity = F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name"))
    authors = F.when(F.col("s_nationkey") % 3 == 0, _texts("a", "a")).when(F.col("s_nationkey") % 3 == 1, _texts("a", "b"))
    rules = I.definition_rules(identity=identity, name=F.when(F.col("s_acctbal") >= 0, F.col("s_name")), authors=authors, root=F.when(F.col("s_suppkey") % 5 == 0, identity), parent=F.concat("s_name", F.lit("x")))
    return I.checked(table(spark, sf, "supplier"), rules, ["s_suppkey"])


@query("""select s_suppkey, list_filter([case when s_acctbal < 0 then 'availability' end, case when s_suppkey % 4 = 0 then 'lifecycle' end, case when s_nationkey % 4 = 0 then 'regions' end, case when s_nationkey % 5 = 0 then 'operations' end, case when s_suppkey % 3 = 0 then 'endpoints' end], lambda x: x is not null) violations
from supplier where s_acctbal < 0 or s_suppkey % 4 = 0 or s_nationkey % 4 = 0 or s_nationkey % 5 = 0 or s_suppkey % 3 = 0""")
def offering_invariants(spark: SparkSession, sf: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    rules = I.offering_rules(
        provider=F.col("s_name"), model=F.col("s_name"), definition=F.col("s_name"), availability=F.when(F.col("s_acctbal") >= 0, "available").otherwise("sold"), lifecycle=F.when(key % 4 > 0, "preview"),
        regions=F.when(nation % 4 == 0, _texts("eu", "")), operations=F.when(nation % 5 == 0, _texts("chat-completions", "sing")).otherwise(_texts("chat-completions")), endpoints=F.when(key % 3 == 0, _texts("embeddings")).otherwise(_texts("chat-completions")),
    )
    return I.checked(table(spark, sf, "supplier"), rules, ["s_suppkey"])


@query("""with o as (select distinct * from observation), v as (select id, list_filter([case when coalesce(completeness not in ('complete', 'partial'), true) then 'completeness' end, case when accepted < 0 or rejected < 0 then 'counts' end, case when completeness = 'complete' and coalesce(rejected, 0) > 0 then 'complete' end,
case when status = 'failed' and coalesce(accepted, 0) > 0 then 'failed' end], lambda x: x is not null) violations from o) select * from v where len(violations) > 0""")
def observation_invariants(spark: SparkSession, sf: str) -> DataFrame:
    rules = I.observation_rules(**{n: F.col(n) for n in ("observed_at", "completeness", "status", "accepted", "rejected")}, identity=F.col("id"), source=F.col("provider_id"))
    return I.checked(table(spark, sf, "observation").distinct(), rules, ["id"])


@query("select distinct listing_id, owned_by from model_listing where owned_by is not null and owned_by not in (select name from author)")
def dangling_owners(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "model_listing").select("listing_id", "owned_by").distinct()
    return I.dangling(rows, ["listing_id"], "owned_by", table(spark, sf, "author"), "name")


@query("with l as (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) b from orders) select o_custkey, o_orderkey from l where b > o_orderdate")
def orders_out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    return I.out_of_order(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate"])


def _rule(owner: str, provider: Column, pattern: str | None):  # noqa: ANN202
    return F.struct(F.lit(owner).alias("owner"), provider.cast("string").alias("provider"), F.lit(pattern).cast("string").alias("pattern"))


@query(f"""with {_MODELS}, a as (select provider_id, id, list_sort(list_filter([case when id like '%/%a%' and regexp_full_match(lower(id), '[^/]*/[^/]*a[^/]*') then 'any' end, case when provider_id = (select min(id) from provider) then 'whole' end,
case when provider_id = (select max(id) from provider) and regexp_full_match(lower(id), 'l[^/]*/[^/]*') then 'some' end], lambda x: x is not null)) owners from models) select * from a""")
def attributed_owner_sets(spark: SparkSession, sf: str) -> DataFrame:
    provider = table(spark, sf, "provider").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    rules = F.array(
        _rule("any", F.lit(None), "*/*A*"),
        _rule("whole", F.col("low"), None), _rule("some", F.col("high"), "L*/*"), _rule("none", F.lit(""), None),
    )
    patterns = provider.select(F.inline(rules))
    return L.attributed_owners(models(spark, sf).select("provider_id", "id"), "provider_id", "id", patterns)


@query(f"with {_MODELS} select id, case when min(provider_id) = max(provider_id) then min(provider_id) end provider_id, list_sort(list(distinct provider_id)) candidates from models group by 1")
def unique_providers(spark: SparkSession, sf: str) -> DataFrame:
    return L.unique_owner(models(spark, sf), "id", "provider_id")


@query("""with n as (select id alias, id target from provider union select unnest(aliases), id from provider), u as (select alias, min(target) target from n group by 1 having count(distinct target) = 1 or bool_or(alias = target))
select l.listing_id, u.target provider_id, l.id from (select distinct listing_id, upper(provider_id) p, id from model_listing where provider_id is not null) l join (select upper(alias) a, min(target) target from u group by 1) u on u.a = l.p""")
def offering_by_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Listings under the provider that a spelling of it names."""
    names = L.alias_table(L.alias_rows(table(spark, sf, "provider"), "id", F.coalesce("aliases", F.array().cast("array<string>"))))
    folded = names.where("target is not null").groupBy(F.upper("alias").alias("alias")).agg(F.min("target").alias("target"))
    rows = table(spark, sf, "model_listing").where("provider_id is not null").select("listing_id", F.upper("provider_id").alias("provider_id"), "id").distinct()
    return U.restricted(rows, "provider_id", folded).select("listing_id", "provider_id", "id")


@query(f"""with {_MODELS}, n as (select lower(id) a, id t from author union select lower(unnest(aliases)), id from author), u as (select a, min(t) t from n group by 1 having count(distinct t) = 1)
select m.provider_id, m.id, t || '/' || string_split(m.id, '/')[2] definition_id from models m join u on a = lower(string_split(m.id, '/')[1]) where len(string_split(m.id, '/')) = 2""")
def definition_by_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Models whose owner is written as an author's id or alias, under the definition of that author."""
    names = L.alias_table(L.alias_rows(table(spark, sf, "author"), "id", F.coalesce("aliases", F.array().cast("array<string>")), fold_case=True).withColumn("direct", F.lit(False)))
    parts = S.definition_parts(F.col("id"))
    rows = models(spark, sf).select("provider_id", "id", F.lower(parts["owner"]).alias("owner"), parts["slug"].alias("slug")).where("owner is not null")
    return L.resolve(rows, "owner", names).where("target is not null").select("provider_id", "id", F.concat_ws("/", "target", "slug").alias("definition_id"))


# Payloads, converters and documents.


@query("""with p as (select distinct payload_id, payload from endpoint_payload), v as (select payload_id, payload, case when json_valid(payload) then payload::json end j from p)
select payload_id, case when payload is null or trim(payload) = '' then 'missing' when j is null then case when json_valid('[' || payload || ']') then 'trailing' else 'syntax' end when json_type(j) <> 'OBJECT' then 'no object'
else 'unknown: ' || list_sort(list_filter(json_keys(j), lambda k: k not in ('data', 'generation_id')))[1] end problem from v
where payload is null or trim(payload) = '' or j is null or json_type(j) <> 'OBJECT' or len(list_filter(json_keys(j), lambda k: k not in ('data', 'generation_id'))) > 0""")
def strict_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "endpoint_payload").select("payload_id", "payload").distinct()
    return strict_problems(rows, "payload_id", "payload", ["data", "generation_id"])


@query("""with p as (select distinct payload_id, payload from endpoint_payload) select payload_id, case when payload is null then 'missing' when strlen(payload) > 1200 then 'size' else 'syntax' end problem from p where payload is null or strlen(payload) > 1200 or not json_valid(payload)""")
def oversized_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return oversized(table(spark, sf, "endpoint_payload").select("payload_id", "payload").distinct(), "payload_id", "payload", most_bytes=1200)


@query(f"""with {_MODELS} select provider_id, id, id name, 'anthropic' owner, created, context_window, max_completion_tokens output_tokens, case when active then ['text', 'image'] else ['text'] end modalities, case when active then ['batch', 'effort:maximum'] else ['effort:maximum'] end capabilities from models where trim(id) <> ''""")
def anthropic_wire(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda c: F.struct(c.alias("supported"))
    record = F.to_json(F.struct(
        "id", F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("context_window").alias("max_input_tokens"), F.col("max_completion_tokens").alias("max_tokens"),
        F.struct(said(F.col("active")).alias("image_input"), said(F.col("active")).alias("batch"), F.struct(said(F.lit(True)).alias("max"), said(F.lit(False)).alias("low")).alias("effort")).alias("capabilities"),
    ))
    found = anthropic_models(models(spark, sf).select("provider_id", record.alias("record")))
    return found.select("provider_id", "id", "name", "owner", "created", "context_window", "output_tokens", F.col("input_modalities").alias("modalities"), "capabilities")


@query(f"""with {_MODELS} select provider_id, id, string_split(id, '/')[1] owner, context_window, max_completion_tokens output_tokens, list_filter([case when active then 'streaming' end, 'chat', case when context_window > 100000 then 'reasoning' end], lambda x: x is not null) capabilities from models where trim(id) <> ''""")
def google_wire(spark: SparkSession, sf: str) -> DataFrame:
    methods = F.array_compact(F.array(F.lit("generateContent"), F.when(F.col("active"), "streamGenerateContent")))
    record = F.to_json(F.struct(
        F.concat(F.lit("publishers/"), F.substring_index("id", "/", 1), F.lit("/models/"), "id").alias("name"), methods.alias("supportedGenerationMethods"), F.col("context_window").alias("inputTokenLimit"),
        F.col("max_completion_tokens").cast("string").alias("outputTokenLimit"), (F.col("context_window") > 100_000).alias("thinking"),
    ))
    return google_models(models(spark, sf).select("provider_id", record.alias("record"))).select("provider_id", "id", "owner", "context_window", "output_tokens", "capabilities")


@query(f"""with {_MODELS} select p.id provider_id, m.id, case when m.active then 'active' when m.active is null then '' else 'unknown' end status, context_window, max_completion_tokens output_tokens, case when m.active then ['minimum', 'maximum'] end effort_levels, list_filter([case when m.active then 'reasoning' end, 'tool_call'], lambda x: x is not null) capabilities
from models m join provider p on upper(p.id) = upper(m.provider_id) where trim(m.id) <> ''""")
def upstream_records(spark: SparkSession, sf: str) -> DataFrame:
    """An index from provider to models to record, a payload for each model; providers by their aliases."""
    options = F.when(F.col("active"), F.array(F.struct(F.lit("effort").alias("type"), _texts("minimal", "odd", "max").alias("values"))))
    record = F.struct(
        F.when(F.col("active"), " Active ").when(F.col("active").isNull(), None).otherwise("rumoured").alias("status"), F.struct(F.col("context_window").alias("context"), F.col("max_completion_tokens").alias("output")).alias("limit"),
        options.alias("reasoning_options"), F.coalesce("active", F.lit(False)).alias("reasoning"), F.lit(True).alias("tool_call"),
    )
    index = F.to_json(F.create_map(F.upper("provider_id"), F.struct(F.create_map("id", record).alias("models"))))
    names = table(spark, sf, "provider").select(F.upper("id").alias("alias"), F.col("id").alias("target"))
    found = upstream_models(models(spark, sf).select(index.alias("payload")), "payload", names)
    return found.select("provider_id", "id", "status", "context_window", "output_tokens", "effort_levels", "capabilities")


@query("select id resource, n::integer place, ['local_catalog', 'providers'][n + 1] source, 'name' field, case n when 0 then name else upper(name) end \"value\" from author, range(2) t(n)")
def provenance_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Land the evidence of the authors' names as a provenance file and read it back."""
    entries = table(spark, sf, "author").select(F.col("id").alias("resource"), F.posexplode(F.array(F.struct(F.lit("local_catalog").alias("source"), F.col("name").alias("value")), F.struct(F.lit("providers").alias("source"), F.upper("name").alias("value")))).alias("place", "e"))
    path = os.path.join(shared_folder(spark), "provenance.yaml")
    write_provenance(entries.select("resource", "place", "e.source", F.lit("name").alias("field"), "e.value"), path)
    return read_provenance(spark, file_uri(path))[0].select("resource", "place", "source", "field", "value")


@query(f"with {_PUBLICATIONS} select stream, sequence, generation_id, null::varchar problem from p")
def frames_read_back(spark: SparkSession, sf: str) -> DataFrame:
    return parse_frames(frames(_publications(spark, sf)))


# Writes and merges.


@query("select p_partkey k, p_brand v from part union all select p_partkey, p_type from part where p_size > 25")
def appended_entries(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return U.appended(part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v")), part.where("p_size > 25").select(F.col("p_type").alias("v"), F.col("p_partkey").alias("k")))


@query("select p_partkey k, p_brand v from part")
def first_corpus(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    return U.first_filled(rows.where("k < 0"), rows, rows.where("v is null"))


@query("""with r as (select p_brand, p_type, min(p_size) low, max(p_retailprice) high from part group by all), s as (select *, case p_type when 'PROMO' then 'local_catalog' when 'ECONOMY' then 'models_dev_http' when 'LARGE' then 'providers' else 'elsewhere' end source from r)
select p_brand, coalesce(max(low) filter (source = 'local_catalog'), max(low) filter (source = 'models_dev_http'), max(low) filter (source = 'providers'))::varchar low, coalesce(max(high) filter (source = 'models_dev_http'), max(high) filter (source = 'providers')) high,
 bool_or(low > 1) filter (source = 'providers') flag_top, coalesce(bool_or(low > 2) filter (source = 'providers'), bool_or(low > 2) filter (source = 'models_dev_http'), bool_or(low > 2) filter (source = 'local_catalog')) flag from s where source <> 'elsewhere' group by 1""")
def leaf_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of maps merged leaf by leaf and flags merged flag by flag: a known false of a higher source stays, a gap is filled."""
    ranges = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("low"), F.max("p_retailprice").alias("high"))
    source = S.mapped(F.col("p_type"), {"PROMO": "local_catalog", "ECONOMY": "models_dev_http", "LARGE": "providers"}, F.lit("elsewhere"))
    high = F.when(F.col("p_type") != "PROMO", F.format_string("%.2f", "high"))
    extensions = F.create_map(F.lit("x"), F.create_map(F.lit("low"), F.col("low").cast("string"), F.lit("high"), high))
    features = F.create_map(F.lit("top"), F.when(F.col("p_type") == "LARGE", F.col("low") > 1), F.lit("any"), F.col("low") > 2)
    rows = ranges.select("p_brand", source.alias("source"), extensions.alias("extensions"), features.alias("features"))
    found = reconcile(rows, "model", ["p_brand"], "source").rows.where("extensions is not null")
    leaf = lambda c, *steps: F.try_element_at(leaf(c, *steps[:-1]), F.lit(steps[-1])) if steps else F.col(c)
    return found.select("p_brand", leaf("extensions", "x", "low").alias("low"), leaf("extensions", "x", "high").cast("double").alias("high"), leaf("features", "top").alias("flag_top"), leaf("features", "any").alias("flag"))


@query("""select p_partkey, case when p_size > 30 and p_type = 'PROMO' and p_brand >= 'Brand#3' then null else p_retailprice end price, case when p_type = 'PROMO' and p_size <= 20 and p_brand < 'Brand#3' then null else p_size > 20 end flag from part""")
def suppressed_claims(spark: SparkSession, sf: str) -> DataFrame:
    """A stale fallback makes no claim where the baseline knows the value; neither does an all-false local block that had none before."""
    rows = table(spark, sf, "part").withColumn("flags", F.create_map(F.lit("big"), F.col("p_size") > 20))
    rows = A.without_stale(rows, "p_retailprice", (F.col("p_size") > 30) & (F.col("p_type") == "PROMO"), F.col("p_brand") >= "Brand#3")
    rows = A.without_blank_projections(rows, "p_type", "PROMO", "flags", F.col("p_brand") >= "Brand#3")
    return rows.select("p_partkey", F.col("p_retailprice").alias("price"), F.try_element_at("flags", F.lit("big")).alias("flag"))


@query("""select * from (values ('limits.context_window', 'limits', 'providers'), ('name', 'name', 'providers'), ('metadata.tags', 'metadata', 'models_dev_http'), ('extensions.x.y', 'extensions', 'local_catalog'), ('nothing', null, null), ('lineage.root', 'lineage.root', 'providers'), ('description', 'description', 'models_dev_http')) t(path, policy, first)""")
def policy_matches(spark: SparkSession, sf: str) -> DataFrame:
    paths = ["limits.context_window", "name", "metadata.tags", "extensions.x.y", "nothing", "lineage.root", "description"]
    found = [(p, A.find_policy(A.POLICIES, "model", p)) for p in paths]
    return spark.createDataFrame([(p, f and f.path, f and f.sources[0]) for p, f in found], "path string, policy string, first string")


@query(f"with {_MODELS} select provider_id, id, case when context_window is null then 'removed' else 'updated' end change_type from models where context_window is null or active")
def planned_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an update would change: rows without a context go, active ones double it. Nothing is committed."""
    store = GenerationStore(spark, f"{shared_uri(spark)}/store")
    engine = Engine(store, {"models": models(spark, sf).select("provider_id", "id", "context_window", "active")}, seed_id="first")
    doubled = F.when(F.col("active"), F.col("context_window") * 2).otherwise(F.col("context_window"))
    build = lambda old: {"models": old["models"].where("context_window is not null").withColumn("context_window", doubled)}
    changes = engine.planned(build, {"models": ["provider_id", "id"]})["models"]
    return changes.select("provider_id", "id", "change_type")
