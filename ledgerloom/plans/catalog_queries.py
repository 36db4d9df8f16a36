"""Queries of the catalog operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import table
from ..exports import display_rows, model_list
from ..functions import scalars as S
from ..operators import authority as A
from ..operators import diff as D
from ..operators import filters as P
from ..operators import lookup as L
from ..operators import projections as J
from ..operators import ranking as R
from ..operators import setops as U
from ..operators import views as V
from ..sources.converters import model_status, openai_models
from ..sources.payloads import decode_records, quarantined, unknown_members
from ..streaming.publications import decided, newest, frames

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


# Base relations.


def offerings(spark: SparkSession, sf: str) -> DataFrame:
    """One offering for each supplier and part of lineitem, with its lowest unit price."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("provider_id"), F.col("l_partkey").alias("definition_id")).agg(F.min(unit).alias("price"))


_OFFERINGS = "offerings as (select l_suppkey provider_id, l_partkey definition_id, min(l_extendedprice / l_quantity) price from lineitem group by all)"


def models(spark: SparkSession, sf: str) -> DataFrame:
    """The latest delivered row of each model of a provider."""
    rows = table(spark, sf, "model_snapshot")
    return R.first_by(rows, ["provider_id", "id"], [F.col("received_at").desc(), F.col("feed_id").desc(), F.col("snapshot_no").desc()])


_MODELS = "models as (select * exclude n from (select *, row_number() over (partition by provider_id, id order by received_at desc, feed_id desc, snapshot_no desc) n from model_snapshot) where n = 1)"


def _sane(name: str):  # noqa: ANN202
    """A count without the stand-in value that is the greatest of its type."""
    return F.nullif(F.col(name), F.lit(2**63 - 1)).alias(name.split(".")[-1])


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "model_listing").select("listing_id", "model_ref", "source_id", "provider_id", "owned_by", _sane("max_input_tokens"), _sane("openrouter.context_length"), F.col("openrouter.prompt").alias("prompt"), "observed_at").distinct()


_LISTINGS = "listings as (select distinct listing_id, model_ref, source_id, provider_id, owned_by, nullif(max_input_tokens, 9223372036854775807) max_input_tokens, nullif(openrouter.context_length, 9223372036854775807) context_length, openrouter.prompt prompt, observed_at from model_listing)"

SOURCES = ("providers", "models_dev", "local_catalog", "openrouter")
_RANK = "coalesce(list_position(['providers', 'models_dev', 'local_catalog', 'openrouter'], source_id), 5)"
FIRST = A.Policy("model", "value", SOURCES)
CLAIMED = A.Policy("model", "value", SOURCES, empty="authoritative")


def relation() -> P.Relation:
    return P.Relation(
        id=F.col("id"), name=F.col("id"), flags={"streaming": F.col("active")}, context_window=F.col("context_window"), output_tokens=F.col("max_completion_tokens"),
        created_at=F.timestamp_seconds("created"), release_date=F.timestamp_seconds("created").cast("date"),
    )


# Filters, searches, sorts and pages.


@query(f"with {_OFFERINGS}, r as (select *, row_number() over (partition by definition_id order by price nulls last, provider_id) n from offerings) select definition_id, p_name, provider_id, s_name, price from r join supplier on s_suppkey = provider_id join part on p_partkey = definition_id where n = 1")
def preferred_offering(spark: SparkSession, sf: str) -> DataFrame:
    first = R.first_by(offerings(spark, sf), ["definition_id"], [F.col("price").asc_nulls_last(), F.col("provider_id")])
    named = first.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"), "s_name"), "provider_id")
    return named.join(table(spark, sf, "part").select(F.col("p_partkey").alias("definition_id"), "p_name"), "definition_id").select("definition_id", "p_name", "provider_id", "s_name", "price")


@query(f"with {_MODELS} select provider_id, id, owned_by, active, context_window from models order by provider_id, id")
def models_latest(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).select("provider_id", "id", "owned_by", "active", "context_window").orderBy("provider_id", "id")


@query(f"""with {_MODELS} select provider_id, id, context_window from models where contains(lower(id), 'lumen') and coalesce(active, false)
and context_window > 0 and context_window between 8000 and 300000 and max_completion_tokens > 0 and max_completion_tokens <= 131072
and make_timestamp(created * 1000000)::date between date '2022-01-01' and date '2026-06-30'""")
def model_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    wanted = P.ModelFilter(name_contains="Lumen", features={"streaming": True}, min_context=8000, max_context=300_000, max_output=131_072, released_after="2022-01-01", released_before="2026-06-30")
    return wanted.apply(models(spark, sf), relation(), F.col("provider_id")).select("provider_id", "id", "context_window")


@query(f"with {_MODELS} select provider_id, id, context_window from models where context_window > 0 and context_window >= 16384 order by context_window desc nulls last, id, provider_id limit 20 offset 5")
def model_list_page(spark: SparkSession, sf: str) -> DataFrame:
    wanted = P.parse_filter({"min_context": "16384", "sort": "context_window", "order": "desc", "limit": "20", "offset": "5"}, strict=True)
    return wanted.apply(models(spark, sf), relation(), F.col("provider_id")).select("provider_id", "id", "context_window")


@query(f"with {_MODELS} select provider_id, id, owned_by from models where lower(owned_by) = (select lower(min(name)) from author) or contains(lower(id), '-vision')")
def model_options(spark: SparkSession, sf: str) -> DataFrame:
    owner = table(spark, sf, "author").agg(F.lower(F.min("name")).alias("_owner"))  # one row
    rows = models(spark, sf).join(F.broadcast(owner), (F.lower("owned_by") == F.col("_owner")) | P.search("-VISION", F.col("id")))
    return rows.select("provider_id", "id", "owned_by")


@query("select doc_id, lang from documents where contains(lower(text), 'committee') or contains(lower(speaker), 'committee')")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(P.search("Committee", F.col("text"), F.col("speaker"))).select("doc_id", "lang")


@query("select id, name, headquarters from provider where contains(lower(id), 'a') and (contains(lower(name), 'cloud') or contains(lower(headquarters), 'vask')) order by id limit 10")
def search_providers(spark: SparkSession, sf: str) -> DataFrame:
    hit = P.search("a", F.col("id")) & P.search("Cloud", F.col("name")) | P.search("a", F.col("id")) & P.search("vask", F.col("headquarters"))
    return table(spark, sf, "provider").where(hit).orderBy("id").limit(10).select("id", "name", "headquarters")


@query("select id, name from author where contains(lower(id), 'labs') or contains(lower(name), 'labs') or contains(lower(description), 'labs') or len(list_filter(aliases, lambda x: contains(lower(x), 'labs'))) > 0 order by id limit 50")
def search_authors(spark: SparkSession, sf: str) -> DataFrame:
    hit = P.search("LABS", F.col("id"), F.col("name"), F.col("description"), arrays=[F.col("aliases")])
    return table(spark, sf, "author").where(hit).orderBy("id").limit(50).select("id", "name")


@query("select p_partkey from part where list_has_any(string_split(lower(p_name), ' '), ['green', 'steel'])")
def tags_any(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(P.contains_any(F.split("p_name", " "), ["Green", "STEEL"])).select("p_partkey")


@query("select p_partkey from part where list_has_all(string_split(lower(p_name), ' '), ['red'])")
def tags_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(P.contains_all(F.split("p_name", " "), ["Red"])).select("p_partkey")


@query("with o as (select l_partkey, min(l_extendedprice) price from lineitem where l_discount > 0.05 group by 1) select p_partkey, price from part left join o on l_partkey = p_partkey where coalesce(price <= 1500, true)")
def missing_passes(spark: SparkSession, sf: str) -> DataFrame:
    cheapest = table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy("l_partkey").agg(F.min("l_extendedprice").alias("price"))
    rows = table(spark, sf, "part").join(cheapest, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.where(P.at_most_or_missing(F.col("price"), 1500)).select("p_partkey", "price")


@query("select o_orderkey, nullif(o_orderstatus, 'P') status from orders order by nullif(o_orderstatus, 'P') desc nulls last, o_orderkey limit 50 offset 100")
def sort_missing_last(spark: SparkSession, sf: str) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    rows, _ = P.page(table(spark, sf, "orders").withColumn("status", status), [F.col("status").desc_nulls_last(), F.col("o_orderkey")], limit=50, offset=100)
    return rows.select("o_orderkey", "status")


@query("select event_id, event_type from events where regexp_full_match(lower(event_type), 'c[^/]*') or regexp_full_match(event_type, '[^/]*r[^/]r')")
def glob_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(P.matches_field(F.col("event_type"), ["C*", "*r?r"])).select("event_id", "event_type")


# Lookups and references.


@query(f"with {_MODELS} select p.id, p.name, count(m.id) model_count, p.headquarters from provider p left join models m on m.provider_id = p.id group by all")
def provider_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = models(spark, sf).groupBy(F.col("provider_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "provider").join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("model_count"), "headquarters")


_ALIASES = "flat as (select id a, id t, true d from author union all select name, id, false from author union all select unnest(aliases), id, false from author), named as (select a, coalesce(min(t) filter (d), case when min(t) = max(t) then min(t) end) t, count(distinct t) n from flat where a is not null and a <> '' group by a)"


@query(f"with {_ALIASES}, {_LISTINGS} select listing_id, t target, case when t is not null then 'found' when n is not null then 'ambiguous' else 'missing' end found from listings left join named on a = owned_by")
def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    names = L.alias_rows(table(spark, sf, "author"), "id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return L.resolve(listings(spark, sf), "owned_by", L.alias_table(names)).select("listing_id", "target", "found")


@query("with f as (select p_name a, p_partkey t from part) select a alias, case when count(distinct t) = 1 then min(t) end target, count(distinct t) candidates from f group by 1")
def alias_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("target"), F.lit(False).alias("direct"))
    return L.alias_table(rows)


@query("select lower(trim(p_type)) alias, list_sort(list(distinct p_brand)) targets from part group by 1 having count(distinct p_brand) > 1")
def alias_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return L.alias_conflicts(table(spark, sf, "part").select(F.col("p_type").alias("alias"), F.col("p_brand").alias("target")))


@query("select l_orderkey, l_linenumber, count(*) times from lineitem group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return L.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"with {_OFFERINGS} select p_partkey definition_id, provider_id, price from part join offerings on definition_id = p_partkey where p_size <= 10")
def offerings_by_definition(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("definition_id"))
    return offerings(spark, sf).join(wanted, "definition_id").select("definition_id", "provider_id", "price")


@query("select p_brand owner, list_sort(list(distinct p_type)) members from part group by 1")
def author_membership(spark: SparkSession, sf: str) -> DataFrame:
    return V.membership(table(spark, sf, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("member")), "owner", "member")


@query("""with k as (select o_orderkey, case when o_orderkey % 10 < 7 then o_custkey when o_orderkey % 10 = 7 then null else o_custkey + 10000000 end ref from orders),
b as (select o_orderkey, o_custkey ref from orders where o_orderkey % 20 < 18)
select k.o_orderkey, coalesce(c.c_custkey, b.ref) ref, case when coalesce(c.c_custkey, b.ref) is not null then null when k.ref is null then 'no reference' else 'unknown reference' end reason
from k left join customer c on c.c_custkey = k.ref left join b on b.o_orderkey = k.o_orderkey""")
def reference_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    digit = F.col("o_orderkey") % 10
    rows = orders.select("o_orderkey", F.when(digit < 7, F.col("o_custkey")).when(digit == 7, None).otherwise(F.col("o_custkey") + 10_000_000).alias("ref"))
    baseline = orders.where("o_orderkey % 20 < 18").select("o_orderkey", F.col("o_custkey").alias("ref"))
    kept, rejected = L.carried_reference(rows, ["o_orderkey"], "ref", table(spark, sf, "customer"), "c_custkey", baseline)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected.withColumn("ref", F.lit(None).cast("bigint")))


@query(f"with {_LISTINGS}, r as (select *, row_number() over (partition by model_ref order by listing_id) n from listings l where source_id <> 'providers' and exists (from listings p where p.model_ref = l.model_ref and p.source_id = 'providers')) select model_ref, listing_id, source_id from r where n = 1")
def primary_semi(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    first = L.enriched_by_primary(rows.where("source_id <> 'providers'"), rows.where("source_id = 'providers'"), ["model_ref"], [F.col("listing_id")])
    return first.select("model_ref", "listing_id", "source_id")


@query("""with k as (select distinct feed_id, id from model_snapshot), m as (select feed_id, max(snapshot_no) n from model_snapshot group by 1),
s as (select distinct feed_id, id from model_snapshot join m using (feed_id) where snapshot_no = n)
select k.feed_id, count(*) filter (s.id is null) missing, count(*) known, count(*) filter (s.id is null) > 0 degraded from k left join s using (feed_id, id) group by 1""")
def volume_guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "model_snapshot").select("feed_id", "snapshot_no", "id")
    last = rows.groupBy("feed_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    return L.missing_from(rows, rows.join(last, ["feed_id", "snapshot_no"]), ["feed_id", "id"], "feed_id")


@query("""with t as (select s_suppkey place, s_suppkey from supplier union all select 1000000 + s_suppkey, s_suppkey + 1000000 from supplier where s_suppkey <= 5),
o as (select l_suppkey, bool_or(l_discount >= 0.1) ok from lineitem where l_returnflag = 'R' and l_quantity > 49 group by 1)
select place, s_suppkey, case when ok is null then 'missing' when not ok then 'unavailable' end reason from t left join o on l_suppkey = s_suppkey""")
def route_targets(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier")
    targets = supplier.select(F.col("s_suppkey").alias("place"), F.col("s_suppkey").alias("l_suppkey"))
    targets = targets.unionAll(supplier.where("s_suppkey <= 5").select(F.col("s_suppkey") + 1_000_000, F.col("s_suppkey") + 1_000_000))
    offers = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 49")
    return L.routed(targets, offers, ["l_suppkey"], F.col("l_discount") >= 0.1).select("place", F.col("l_suppkey").alias("s_suppkey"), "reason")


@query("""select p_partkey, case when p_brand = 'Brand#11' then 'exact' when lower(p_brand) = 'brand#12' then 'folded' when regexp_full_match(lower(p_brand), 'brand#[^/]5') then 'five' when regexp_full_match(lower(p_brand), 'brand#1[^/]*') then 'long' when regexp_full_match(lower(p_brand), 'brand[^/]*') then 'any' end owner from part""")
def glob_attribution(spark: SparkSession, sf: str) -> DataFrame:
    patterns = spark.createDataFrame([("Brand#11", "exact"), ("BRAND#12", "folded"), ("brand#1*", "long"), ("Brand#?5", "five"), ("brand*", "any"), (None, "none")], "pattern string, owner string")
    return L.attributed(table(spark, sf, "part"), "p_brand", patterns).select("p_partkey", "owner")


@query("""with l as (select s_suppkey id, case s_suppkey % 4 when 0 then null when 1 then s_name when 2 then 'nobody' else (select min(s_name) from supplier) end link from supplier)
select l.id, case when s.s_suppkey <> l.id then s.s_suppkey end link, case when link is null then 'none' when s.s_suppkey = l.id then 'self' when s.s_suppkey is not null then 'found' else 'missing' end link_state
from l left join supplier s on s.s_name = l.link""")
def lineage_links(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    low = supplier.agg(F.min("s_name").alias("_low"))
    digit = F.col("id") % 4
    rows = supplier.join(F.broadcast(low)).select("id", F.when(digit == 1, F.col("s_name")).when(digit == 2, "nobody").when(digit == 3, F.col("_low")).alias("link"))
    names = L.alias_table(supplier.select(F.col("s_name").alias("alias"), F.col("id").alias("target"), F.lit(False).alias("direct")))
    return L.linked_to_self(rows, "id", "link", names)


# Merges under an authority table.


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return A.one_per_source(listings(spark, sf).select("model_ref", "source_id", "max_input_tokens", "context_length", "prompt", "observed_at", "listing_id"), ["model_ref"], "source_id", F.col("observed_at"))


_CLAIMS = f"{_LISTINGS}, claims as (select * exclude n from (select *, row_number() over (partition by model_ref, source_id order by observed_at desc nulls last, max_input_tokens desc nulls last, context_length desc nulls last, prompt desc nulls last, listing_id desc) n from listings) where n = 1)"
_PICK = "arg_min({c}, struct_pack(r := {r}, s := source_id)) filter ({f})"


def _sql_resolved(column: str, zero: str) -> str:
    listed = f"{_RANK} < 5"
    claim = f"{column} is not null and {column} <> {zero} and {listed}"
    return f"coalesce({_PICK.format(c=column, r=_RANK, f=claim)}, {_PICK.format(c=column, r='0', f=f'{column} is not null')})"


@query(f"with {_CLAIMS} select model_ref, {_sql_resolved('max_input_tokens', '0')} max_input_tokens, {_sql_resolved('context_length', '0')} context_length from claims group by 1")
def authority_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return A.resolve_fields(_claims(spark, sf), ["model_ref"], "source_id", {"max_input_tokens": FIRST, "context_length": FIRST})


@query(f"with {_CLAIMS}, w as (select model_ref, min(struct_pack(r := {_RANK}, s := source_id, v := max_input_tokens)) filter (max_input_tokens is not null and {_RANK} < 5) b, min(struct_pack(s := source_id, v := max_input_tokens)) filter (max_input_tokens is not null) o from claims group by 1) select model_ref, coalesce(b.v, o.v) \"value\", coalesce(b.s, o.s) source, coalesce((5.0 - b.r) / 4.0, 0.0)::double authority from w where o is not null")
def authority_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = A.resolve_fields(_claims(spark, sf), ["model_ref"], "source_id", {"max_input_tokens": CLAIMED}, evidence=True).where("max_input_tokens is not null")
    return found.select("model_ref", "max_input_tokens.value", "max_input_tokens.source", "max_input_tokens.authority")


@query(f"""with {_CLAIMS}, v as (select *, {_RANK} r, max_input_tokens between 1 and 100000000 ok from claims where max_input_tokens is not null),
b as (select model_ref, arg_min(max_input_tokens, struct_pack(r := r, s := source_id)) filter (ok) max_input_tokens, arg_min(source_id, struct_pack(r := r, s := source_id)) filter (ok) source, min(r) filter (ok) r0 from v group by 1)
select b.model_ref, b.max_input_tokens, b.source, coalesce(list(v.source_id order by v.r, v.source_id) filter (not v.ok and (b.r0 is null or v.r < b.r0)), []) rejected from b join v using (model_ref) group by all""")
def whole_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = _claims(spark, sf)
    return A.whole_value(rows, ["model_ref"], "source_id", FIRST, "max_input_tokens", F.col("max_input_tokens").between(1, 100_000_000))


@query("""with e as (select p_brand, p_type, unnest(string_split(p_name, ' ')) e, unnest(range(len(string_split(p_name, ' ')))) p from part),
f as (select p_brand, e, min(struct_pack(r := case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 else 2 end, s := p_type, p := p)) m from e where e <> '' group by all)
select p_brand, list(e order by m, e) tags from f group by 1""")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_brand", "p_type", F.split("p_name", " ").alias("tags"))
    return A.unioned(rows, ["p_brand"], "p_type", A.Policy("model", "tags", ("PROMO", "ECONOMY")), "tags")


@query("""with e as (select p_brand, p_type, p_size k, p_retailprice v from part), b as (select p_brand, k, arg_min(v, struct_pack(r := case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 else 2 end, s := p_type, v := v)) v from e group by all)
select p_brand, count(*) entries, round(sum(v), 2) total, min(k) low from b group by 1""")
def merged_maps(spark: SparkSession, sf: str) -> DataFrame:
    lowest = table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_retailprice").alias("v"))
    maps = lowest.groupBy("p_brand", "p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_size", "v"))).alias("modes"))
    merged = A.merged_maps(maps, ["p_brand"], "p_type", A.Policy("model", "modes", ("PROMO", "ECONOMY")), "modes")
    total = F.aggregate(F.map_values("modes"), F.lit(0.0), lambda a, x: a + x)
    return merged.select("p_brand", F.size("modes").cast("bigint").alias("entries"), F.round(total, 2).alias("total"), F.array_min(F.map_keys("modes")).alias("low"))


@query(f"with {_CLAIMS}, a as (select *, case when {_RANK} < 5 then (5.0 - {_RANK}) / 4.0 else 0 end::double s from claims) select model_ref, source_id, 'max_input_tokens' field, max_input_tokens::varchar \"value\", s authority from a where max_input_tokens <> 0 union all select model_ref, source_id, 'prompt', prompt, s from a where trim(prompt) <> ''")
def provenance_claims(spark: SparkSession, sf: str) -> DataFrame:
    return A.provenance(_claims(spark, sf), ["model_ref"], "source_id", {"max_input_tokens": FIRST, "prompt": FIRST})


@query("""with l as (select o_custkey, max(o_totalprice) price, max(o_orderpriority) priority from orders where o_orderstatus = 'F' group by 1), r as (select o_custkey, max(nullif(o_totalprice, 0)) filter (o_orderpriority <> '5-LOW') price, max(o_orderpriority) filter (o_totalprice > 200000) priority from orders where o_orderstatus = 'O' group by 1)
select o_custkey, coalesce(nullif(r.price, 0), l.price) price, coalesce(nullif(trim(r.priority), ''), l.priority) priority from l full join r using (o_custkey)""")
def overlaid_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    left = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"), F.max("o_orderpriority").alias("priority"))
    right = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderpriority") != "5-LOW", S.zero_as_null(F.col("o_totalprice")))).alias("price"), F.max(F.when(F.col("o_totalprice") > 200_000, F.col("o_orderpriority"))).alias("priority")
    )
    return A.overlaid(left, right, ["o_custkey"], ["price", "priority"])


# Ranking and evidence.


@query("with t as (select *, rank() over (partition by user_id order by date_trunc('day', ts) desc) r from events) select user_id, case when min(event_type) = max(event_type) then min(event_type) end event_type, min(event_type) = max(event_type) agreed from t where r = 1 group by 1")
def unknown_on_tie(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return R.unknown_on_tie(rows, ["user_id"], [F.date_trunc("day", F.col("ts")).desc()], "event_type")


@query("with t as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) n from events) select user_id, event_type, event_id, \"value\" from t where n = 1")
def latest_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_by(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("select user_id, event_type, event_id, (row_number() over w)::integer place, row_number() over w = 1 \"current\" from events window w as (partition by user_id, event_type order by ts desc nulls last, event_id)")
def field_history(spark: SparkSession, sf: str) -> DataFrame:
    return R.history(table(spark, sf, "events"), ["user_id"], "event_type", "ts", [F.col("event_id")]).select("user_id", "event_type", "event_id", "place", "current")


@query("""with h as (select event_type, date_trunc('hour', ts) s, "value", event_type || '-' || user_id v from events), g as (select event_type, s "second", count(*) entries, max("value") filter ("value" > 0) m from h group by all having count(*) > 1)
select g.event_type, g."second", g.entries, min(v) filter (h."value" = m) winner from g join h on h.event_type = g.event_type and h.s = g."second" group by all""")
def conflict_detect(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value", F.concat_ws("-", "event_type", "user_id").alias("v"))
    found = R.conflicts(rows, ["event_type"], "ts", "value", "v")
    return found.withColumn("second", F.col("second").cast("timestamp_ntz"))


@query("""with l as (select user_id, arg_max(event_type, struct_pack(t := ts, p := -event_id)) e from events group by 1), f as (select user_id, min(event_type) fact from events group by 1)
select user_id, fact, coalesce(e = fact, false) supported from f left join l using (user_id)""")
def current_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    facts = rows.groupBy("user_id").agg(F.min("event_type").alias("fact"))
    return R.current_evidence(rows, ["user_id"], "ts", "event_id", "event_type", facts, "fact")


# Differences and set writes.


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    changed = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return orders.where("o_orderkey % 10 <> 0"), orders.where("o_orderkey % 10 <> 1").withColumn("o_orderstatus", changed).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_totalprice")))


_VERSIONS = "old as (select * from orders where o_orderkey % 10 <> 0), new as (select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end o_orderstatus, case when o_orderkey % 11 = 0 then null else o_totalprice end o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 10 <> 1)"
_PRICE_TEXT = "case when {c} is not null then printf('%.2f', {c}) end"
_CHANGES = f"{_VERSIONS}, c as (select coalesce(o.o_orderkey, n.o_orderkey) o_orderkey, coalesce(o.o_orderpriority, n.o_orderpriority) p, case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' when o.o_orderstatus is distinct from n.o_orderstatus or o.o_totalprice is distinct from n.o_totalprice then 'updated' end change_type, o.o_orderstatus os, n.o_orderstatus ns, o.o_totalprice op, n.o_totalprice np from old o full join new n using (o_orderkey))"


@query(f"""with {_CHANGES} select o_orderkey, change_type, null path, null old, null \"new\" from c where change_type <> 'updated'
union all select o_orderkey, change_type, 'status', os, ns from c where change_type = 'updated' and os is distinct from ns
union all select o_orderkey, change_type, 'price', {_PRICE_TEXT.format(c="op")}, {_PRICE_TEXT.format(c="np")} from c where change_type = 'updated' and op is distinct from np""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """All changes: of the status and, as plain decimals, of the price."""
    old, new = (d.withColumn("o_totalprice", F.when(F.col("o_totalprice").isNotNull(), F.format_string("%.2f", "o_totalprice"))) for d in _versions(spark, sf))
    changes = D.field_changes(old, new, ["o_orderkey"], {"status": "o_orderstatus", "price": "o_totalprice"})
    return D.change_rows(changes, ["o_orderkey"])


@query(f"""with {_CHANGES} select o_orderkey, change_type, null path, null old, null \"new\" from c where change_type <> 'updated'
union all select o_orderkey, change_type, 'status', os, ns from c where change_type = 'updated' and os is distinct from ns
union all select o_orderkey, change_type, 'price', op::varchar, np::varchar from c where change_type = 'updated' and op is distinct from np""")
def snapshot_diff_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same with prices as the engine prints doubles."""
    changes = D.field_changes(*_versions(spark, sf), ["o_orderkey"], {"status": "o_orderstatus", "price": "o_totalprice"})
    return D.change_rows(changes, ["o_orderkey"])


@query(f"with {_CHANGES} select count(*) filter (change_type = 'added') added, count(*) filter (change_type = 'updated') updated, count(*) filter (change_type = 'removed') removed, count(*) total from c where change_type is not null")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.summary(D.field_changes(*_versions(spark, sf), ["o_orderkey"], ["o_orderstatus", "o_totalprice"]))


@query(f"with {_CHANGES} select p o_orderpriority, count(*) filter (change_type = 'added') added, count(*) filter (change_type = 'updated' and os is distinct from ns) updated, count(*) filter (change_type = 'removed') removed, count(*) filter (change_type <> 'updated' or os is distinct from ns) total from c where change_type is not null and (change_type <> 'updated' or os is distinct from ns) group by 1")
def diff_by_group(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    changes = D.field_changes(old, new, ["o_orderpriority", "o_orderkey"], {"status": "o_orderstatus", "price.total": "o_totalprice"}, ignored=["price.*"])
    return D.summary(changes, ["o_orderpriority"])


@query(f"with {_CHANGES} select o_orderkey from c where change_type = 'updated' and op is distinct from np")
def enrichment_updates(spark: SparkSession, sf: str) -> DataFrame:
    changes = D.field_changes(*_versions(spark, sf), ["o_orderkey"], {"status": "o_orderstatus", "price.total": "o_totalprice"})
    return D.touched(changes, ["price.*"]).select("o_orderkey")


@query(f"with {_VERSIONS} select o_orderkey, o_orderstatus from old union all select o_orderkey, o_orderstatus from new where o_orderkey not in (select o_orderkey from old)")
def append_only_union(spark: SparkSession, sf: str) -> DataFrame:
    return U.append_new(*(d.select("o_orderkey", "o_orderstatus") for d in _versions(spark, sf)), ["o_orderkey"])


@query(f"with {_VERSIONS} select o_orderkey, o_orderstatus from new union all select o_orderkey, o_orderstatus from old where o_orderkey not in (select o_orderkey from new)")
def upserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return U.upserted(*(d.select("o_orderkey", "o_orderstatus") for d in _versions(spark, sf)), ["o_orderkey"])


@query(f"with {_VERSIONS} select o_orderkey, 'kept' fate from old where o_orderkey not in (select o_orderkey from new) union all select o_orderkey, 'absent' from new where o_orderkey not in (select o_orderkey from old)")
def deleted_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept, absent = U.deleted(*(d.select("o_orderkey") for d in _versions(spark, sf)), ["o_orderkey"])
    return kept.withColumn("fate", F.lit("kept")).unionAll(absent.withColumn("fate", F.lit("absent")))


@query("""with e as (select c_custkey k, c_mktsegment v from customer where c_custkey % 3 = 0), b as (select o_custkey k, o_orderpriority v, row_number() over (partition by o_custkey order by o_orderkey desc) n from orders)
select k, v, 'stored' fate from e union all select k, v, 'stored' from b where n = 1 and k not in (select k from e) union all select k, v, 'conflict' from b where n = 1 and k in (select k from e)""")
def batch_insert(spark: SparkSession, sf: str) -> DataFrame:
    existing = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("place"))
    stored, conflict = U.inserted(existing, batch, ["k"], "place")
    return stored.withColumn("fate", F.lit("stored")).unionByName(conflict.drop("place").withColumn("fate", F.lit("conflict")))


_CORPUS = "b as (select p_partkey k, 'base' v from part where p_size <= 30), s as (select p_partkey k, 'boot' v from part where p_size between 20 and 40), l as (select p_partkey k, 'local' v from part where p_size % 5 = 0)"


def _corpus(spark: SparkSession, sf: str, complete: bool) -> DataFrame:
    pick = lambda where, v: table(spark, sf, "part").where(where).select(F.col("p_partkey").alias("k"), F.lit(v).alias("v"))
    return U.corpus(pick("p_size <= 30", "base"), pick("p_size between 20 and 40", "boot"), pick("p_size % 5 = 0", "local"), ["k"], complete=complete)


@query(f"with {_CORPUS} select * from l union all select * from b where k not in (select k from l) and k in (select k from s) union all select * from s where k not in (select k from b) and k not in (select k from l)")
def corpus_complete(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf, complete=True)


@query(f"with {_CORPUS} select * from l union all select * from b where k not in (select k from l) union all select * from s where k not in (select k from b) and k not in (select k from l)")
def corpus_partial(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf, complete=False)


@query("select n_nationkey from nation where n_nationkey in (select s_nationkey from supplier)")
def refused_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return U.refused_deletes(table(spark, sf, "nation"), "n_nationkey", table(spark, sf, "supplier"), "s_nationkey").select("n_nationkey")


# Derived views and statistics.


@query(f"""with {_MODELS}, b as (select id, count(*) offerings, bool_or(active) active, min(created) created, max(received_at) received_at, coalesce(max(context_window), 0) context_window, list_sort(list(distinct provider_id)) providers from models group by 1) select * from b""")
def definitions_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = models(spark, sf).withColumn("providers", F.array("provider_id"))
    return V.definitions(rows, "id", flags=["active"], lists=["providers"], created="created", updated="received_at", largest=["context_window"])


@query(f"with {_MODELS} select id, list(provider_id order by coalesce(context_window, 0) desc, provider_id) providers from models group by 1")
def offering_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = models(spark, sf).select("id", "provider_id", "context_window")
    return V.ordered_list(rows, "id", [-F.coalesce("context_window", F.lit(0)), F.col("provider_id")], ["provider_id"]).select("id", F.transform("items", lambda x: x["provider_id"]).alias("providers"))


@query(f"with {_MODELS} select count(distinct provider_id) providers, count(*) offerings, count(distinct id) definitions, count(*) filter (active) active from models")
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).agg(F.count_distinct("provider_id").alias("providers"), F.count(F.lit(1)).alias("offerings"), F.count_distinct("id").alias("definitions"), F.count_if("active").alias("active"))


@query("""with c as (select count(distinct o_custkey) g, count(distinct (o_custkey, o_orderkey)) k from orders where o_orderstatus <> 'P'), p as (select count(distinct o_custkey) g, count(distinct (o_custkey, o_orderkey)) k from orders)
select c.g \"groups\", c.k \"keys\", p.g old_groups, p.k old_keys, c.g >= 5 and c.k >= 100 and c.g >= p.g * 0.8 and c.k >= p.k * 0.5 promoted from c, p""")
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return V.gate(orders.where("o_orderstatus <> 'P'"), orders, "o_custkey", "o_orderkey", least_groups=5, least_keys=100, keep_groups=0.8, keep_keys=0.5)


@query("""with o as (select distinct id, provider_id, completeness, status, accepted, rejected from observation), h as (select provider_id, status, count(*) n from o group by all)
select provider_id, bool_and(completeness = 'complete') complete, bool_or(status = 'degraded') degraded, sum(accepted)::bigint accepted, sum(rejected)::bigint rejected,
(select string_agg(h.status || ':' || h.n, ', ' order by h.status) from h where h.provider_id = o.provider_id) reasons from o group by 1""")
def observation_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "observation").select("id", "provider_id", "completeness", "status", "accepted", "rejected").distinct()
    facts = rows.groupBy("provider_id").agg(F.bool_and(F.col("completeness") == "complete").alias("complete"), F.bool_or(F.col("status") == "degraded").alias("degraded"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    counts = rows.groupBy("provider_id", "status").agg(F.count(F.lit(1)).alias("n"))
    texts = counts.groupBy("provider_id").agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws(":", x["status"], x["n"].cast("string")))).alias("reasons"))
    return facts.join(texts, "provider_id")


# Scalars.


_DATE_LAYOUTS = """coalesce(
case when regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') then try_cast(t as date) end,
case when regexp_full_match(t, '\\d{4}-\\d{2}') then try_cast(t || '-01' as date) end,
case when regexp_full_match(t, '\\d{4}') then try_cast(t || '-01-01' as date) end,
case when regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}T\\d{1,2}:\\d{2}:\\d{2}([.,]\\d+)?(Z|[+-]\\d{2}:\\d{2})') then try_cast(substr(t, 1, 10) as date) end,
case when try_cast(regexp_extract(t, '^(\\d{4})', 1) as int) between 1901 and 2999 then make_date(try_cast(regexp_extract(t, '^(\\d{4})', 1) as int), 1, 1) end)"""


@query(f"select distinct t shutdown_date, cast({_DATE_LAYOUTS} as varchar) shutdown_day from (select shutdown_date t from model_snapshot)")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "model_snapshot").select("shutdown_date").distinct()
    return rows.select("shutdown_date", S.parse_date(F.col("shutdown_date")).cast("string").alias("shutdown_day"))


_ANY_LAYOUT = f"""coalesce(
case when regexp_full_match(trim(d), '\\d{{4}}-\\d{{2}}-\\d{{2}}(T.*)?') then try_cast(substr(trim(d), 1, 10) as date) end,
case when regexp_full_match(trim(d), '[A-Z][a-z]{{2}} \\d{{1,2}}, \\d{{4}}') then try_strptime(trim(d), '%b %d, %Y')::date end,
case when try_cast(regexp_extract(trim(d), '^(\\d{{4}})', 1) as int) between 1901 and 2999 then make_date(try_cast(regexp_extract(trim(d), '^(\\d{{4}})', 1) as int), 1, 1) end)"""


@query(f"select distinct d shutdown_date, cast({_ANY_LAYOUT} as varchar) shutdown_day from (select shutdown_date d from model_snapshot)")
def parse_dates_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole column with month names and RFC 3339 times."""
    rows = table(spark, sf, "model_snapshot").select("shutdown_date").distinct()
    return rows.select("shutdown_date", S.any_date(F.col("shutdown_date"), instants=True).cast("string").alias("shutdown_day"))


_STATUS_TEXTS = "t as (select event_id, case event_id % 9 when 0 then null when 1 then '' when 2 then 'active' when 3 then 'beta' when 4 then 'preview' when 5 then 'deprecated' when 6 then 'unknown' when 7 then ' Beta ' else event_type end s from events)"


def _status_texts(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array(*(F.lit(x) for x in (None, "", "active", "beta", "preview", "deprecated", "unknown", " Beta ")))
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 < 8, F.get(listed, (F.col("event_id") % 9).cast("int"))).otherwise(F.col("event_type")).alias("s"))


@query(f"with {_STATUS_TEXTS} select event_id, case when s is null or s in ('', 'unknown') then 'unknown' when s in ('beta', 'preview') then 'preview' else s end lifecycle from t where s is null or s in ('', 'active', 'beta', 'preview', 'deprecated', 'unknown')")
def lifecycle_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = _status_texts(spark, sf).where("s is null or s in ('', 'active', 'beta', 'preview', 'deprecated', 'unknown')")
    return rows.select("event_id", J.lifecycle(F.col("s")).alias("lifecycle"))


@query(f"with {_STATUS_TEXTS} select event_id, case when lower(trim(coalesce(s, ''))) in ('', 'active', 'beta', 'preview', 'deprecated') then lower(trim(coalesce(s, ''))) else 'unknown' end status from t")
def status_enums(spark: SparkSession, sf: str) -> DataFrame:
    return _status_texts(spark, sf).select("event_id", model_status(F.col("s")).alias("status"))


@query("select o_orderkey, epoch(case when o_orderstatus = 'F' then o_orderdate else null end)::bigint a, coalesce(epoch(case when o_orderstatus = 'F' then o_orderdate end)::bigint, 0) created from orders")
def epoch_created(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", F.nullif(S.epoch_seconds(known), F.lit(0)).alias("a"), S.epoch_seconds(known).alias("created"))


@query(f"with {_MODELS} select provider_id, id, string_split(id, '/')[1] owner, string_split(id, '/')[2] slug, provider_id || '/' || replace(id, '/', '%2F') resource, id round_trip from models")
def identity_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts, resource = S.definition_parts(F.col("id")), S.resource_id(F.col("provider_id"), F.col("id"))
    return models(spark, sf).select("provider_id", "id", parts["owner"].alias("owner"), parts["slug"].alias("slug"), resource.alias("resource"), S.resource_parts(resource)["identity"].alias("round_trip"))


_OWNERS = f"{_LISTINGS}, named as (select distinct owned_by from listings union select id from author union select unnest(['canopylabs', 'huggingfaceh4', 'llama', 'moonshot', 'moonshotai', 'togetherai', 'zhipuai', ' LLAMA ', ' ']))"


@query(f"""with {_OWNERS} select owned_by, case when coalesce(owned_by, '') = '' then 'unknown' else case owned_by when 'canopylabs' then 'canopy-labs' when 'huggingfaceh4' then 'huggingface' when 'llama' then 'meta'
when 'moonshot' then 'moonshot-ai' when 'moonshotai' then 'moonshot-ai' when 'togetherai' then 'together' when 'zhipuai' then 'zhipu-ai' else replace(lower(regexp_replace(owned_by, '^\\s+|\\s+$', '', 'g')), ' ', '-') end end owner from named""")
def owner_ids(spark: SparkSession, sf: str) -> DataFrame:
    earlier = spark.createDataFrame([(a,) for a in (*S.OWNER_ALIASES, " LLAMA ", " ")], "owned_by string")
    named = listings(spark, sf).select("owned_by").union(table(spark, sf, "author").select("id")).union(earlier).distinct()
    return named.select("owned_by", S.owner_id(F.col("owned_by")).alias("owner"))


@query("select p_partkey, list_sort(list_distinct(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: x <> ''))) tags from part")
def tag_union(spark: SparkSession, sf: str) -> DataFrame:
    tags = S.ordered_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))
    return table(spark, sf, "part").select("p_partkey", F.array_sort(tags).alias("tags"))


@query("select event_id, json_extract(props, '$.k')::bigint k, case when json_exists(props, '$.k') then case when json_type(props, '$.k') = 'NULL' then 1 else 2 end else 0 end::tinyint state, case when json_exists(props, '$.absent') then 2 else 0 end::tinyint absent from events")
def json_presence(spark: SparkSession, sf: str) -> DataFrame:
    record = F.try_parse_json("props")
    k = S.json_presence(record, "$.k", "bigint")
    return table(spark, sf, "events").select("event_id", k["value"].alias("k"), k["state"].alias("state"), S.json_presence(record, "$.absent", "string")["state"].alias("absent"))


@query("""select o_orderkey, case when coalesce(a, false) or coalesce(b, false) then true when a is not null and b is not null then false end any_true,
case when not coalesce(a, true) or not coalesce(b, true) then false when a is not null and b is not null then true end all_true
from (select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end a, case when o_totalprice > 200000 then true when o_totalprice > 100000 then false end b from orders)""")
def three_valued(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    b = F.when(F.col("o_totalprice") > 200_000, True).when(F.col("o_totalprice") > 100_000, False)
    return table(spark, sf, "orders").select("o_orderkey", S.any_known(a, b).alias("any_true"), S.all_known(a, b).alias("all_true"))


@query(f"with {_MODELS} select provider_id, id, case when context_window >= 1000000 then printf('%.1fM', context_window / 1000000) when context_window >= 1000 then printf('%.1fK', context_window / 1000) else context_window::varchar end short, case when length(id) <= 20 then id else substr(id, 1, 17) || '...' end cut from models")
def display_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return models(spark, sf).select("provider_id", "id", S.short_count(F.col("context_window")).alias("short"), S.truncated(F.col("id"), 20).alias("cut"))


@query("select distinct id, sha256(id || chr(0) || provider_id || chr(0) || coalesce(completeness, '') || chr(0) || '') digest from observation")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "observation")
    return rows.select("id", S.fingerprint(F.col("id"), F.col("provider_id"), F.col("completeness"), F.lit(None)).alias("digest")).distinct()


@query("select s_suppkey, string_split(v, ':')[1] base, coalesce(string_split(v, ':')[2], '') variant, regexp_replace(regexp_replace(printf('%.4f', s_acctbal), '0+$', ''), '\\.$', '') plain from (select *, s_name || case when s_suppkey % 2 = 0 then ':beta' else '' end v from supplier)")
def split_variants(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "supplier").withColumn("v", F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ":beta").otherwise("")))
    parts = S.split_variant(F.col("v"))
    return named.select("s_suppkey", parts["base"].alias("base"), parts["variant"].alias("variant"), S.plain_decimal(F.col("s_acctbal")).alias("plain"))


# Sources and exports.


@query(f"with {_MODELS} select provider_id || '/' || id id, 'model' object, created, coalesce(nullif(trim(owned_by), ''), 'system') owned_by from models")
def model_list_export(spark: SparkSession, sf: str) -> DataFrame:
    owners = F.array_compact(F.array(S.blank_as_null(F.col("owned_by"))))
    return model_list(models(spark, sf), F.concat_ws("/", "provider_id", "id"), F.timestamp_seconds("created"), owners)


@query(f"with {_MODELS} select id, coalesce(nullif(trim(owned_by), ''), '-') \"name\", coalesce(case when context_window >= 1000000 then printf('%.1fM', context_window / 1000000) when context_window >= 1000 then printf('%.1fK', context_window / 1000) when context_window > 0 then context_window::varchar end, '-') context, coalesce(nullif(trim(shutdown_date), ''), '-') description from models")
def display_export(spark: SparkSession, sf: str) -> DataFrame:
    return display_rows(models(spark, sf), F.col("id"), F.col("owned_by"), F.col("context_window"), F.col("shutdown_date"))


_ENVELOPES = """p as (select distinct payload_id, payload, case when json_valid(payload) then payload::json end j from endpoint_payload),
e as (select payload_id, payload, case json_type(j, '$.data.endpoints') when 'ARRAY' then cast(j->'$.data.endpoints' as json[]) when 'OBJECT' then list_transform(list_sort(json_keys(j, '$.data.endpoints')), lambda k: j->'$.data.endpoints'->k) end items from p),
sorted as (select payload_id, payload, items, list_transform(items, lambda x: coalesce(json_type(x), '') = 'OBJECT') fine from e)"""


@query(f"""with {_ENVELOPES} select payload_id, sum(coalesce(len(list_filter(list_slice(fine, 1, 3), lambda x: x)), 0))::bigint accepted, bool_or(coalesce(len(items) > 3, false)) truncated from sorted group by 1""")
def payload_records(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and objects of records, the first three of each."""
    rows = table(spark, sf, "endpoint_payload").select("payload_id", "payload").distinct()
    shape = T.StructType.fromDDL("model_id string, name string, tag string")
    return decode_records(rows, "payload_id", "payload", "data.endpoints", shape, limit=3).report.select("payload_id", "accepted", "truncated")


@query(f"""with {_ENVELOPES} select payload_id, sum(coalesce(len(list_filter(fine, lambda x: x)), 0))::bigint accepted, sum(coalesce(len(list_filter(fine, lambda x: not x)), 0))::bigint rejected, false truncated, bool_or(items is null) broken from sorted group by 1""")
def payload_records_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report of all envelopes, lists and objects, without a limit."""
    rows = table(spark, sf, "endpoint_payload").select("payload_id", "payload").distinct()
    shape = T.StructType.fromDDL("model_id string, name string, tag string")
    return decode_records(rows, "payload_id", "payload", "data.endpoints", shape).report


@query("""with p as (select distinct record_id, payload::json j from list_payload where json_valid(payload)), k as (select record_id, unnest(json_keys(j)) path from p)
select record_id, path from k where path not in ('id', 'object', 'created', 'owned_by')""")
def unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "list_payload").select("record_id", "payload").distinct()
    return unknown_members(rows, "record_id", "payload", ["id", "object", "created", "owned_by"]).select("record_id", "path")


@query(f"""with {_LISTINGS}, m as (select listing_id, owned_by, case when owned_by is null or trim(owned_by) = '' then 'blank' when owned_by <> trim(owned_by) then 'padded' end why from listings),
r as (select *, row_number() over (partition by owned_by, why is null order by listing_id) n from m) select listing_id, case when why is not null then 'id: ' || why when n > 1 then 'repeated' end reason from r""")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    fine, bad = quarantined(listings(spark, sf).select("listing_id", "owned_by"), ["owned_by"], F.col("owned_by"), F.lit(None).cast("string"), F.col("listing_id"))
    return fine.select("listing_id", F.lit(None).cast("string").alias("reason")).unionAll(bad.select("listing_id", "reason"))


# Publications.


def _publications(spark: SparkSession, sf: str) -> DataFrame:
    late = F.col("ts") - F.make_dt_interval(F.when(F.col("event_id") % 5 == 0, 3).otherwise(0))
    return table(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("sequence"), F.concat(F.lit("g"), (F.col("event_id") % 1000).cast("string")).alias("generation_id"), F.col("props").alias("digest"), late.alias("generated_at"))


_PUBLICATIONS = "p as (select event_type stream, event_id sequence, 'g' || (event_id % 1000) generation_id, props digest, ts - to_days(case when event_id % 5 = 0 then 3 else 0 end) generated_at from events)"


@query(f"""with {_PUBLICATIONS}, a as (select *, max(struct_pack(t := generated_at, s := -sequence, i := generation_id, d := digest)) over (partition by stream order by sequence rows between unbounded preceding and 1 preceding) a from p)
select stream, sequence, generation_id, case when a is null then 'activated' when generation_id = a.i then case when digest = a.d then 'duplicate' else 'conflict' end when generated_at < a.t then 'stale' when generated_at = a.t then case when digest = a.d then 'duplicate' else 'conflict' end else 'activated' end decision from a""")
def publication_activate(spark: SparkSession, sf: str) -> DataFrame:
    return decided(_publications(spark, sf)).select("stream", "sequence", "generation_id", "decision")


@query(f"with {_PUBLICATIONS} select stream, max(sequence) sequence, arg_max(generation_id, sequence) generation_id from p group by 1")
def publications_newest(spark: SparkSession, sf: str) -> DataFrame:
    return newest(_publications(spark, sf)).select("stream", "sequence", "generation_id")


@query(f"with {_PUBLICATIONS} select stream, sequence, 'id: ' || sequence || chr(10) || 'event: catalog' || chr(10) || 'data: {{\"generation_id\":\"' || generation_id || '\",\"sequence\":' || sequence || '}}' || chr(10) || chr(10) frame from p")
def publication_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames(_publications(spark, sf))


# Wire records and projections.


_RECORDS = "r as (select distinct record_id, provider_id, payload::json j from list_payload where json_valid(payload))"


@query(f"""with {_RECORDS} select record_id, provider_id, j->>'$.id' id, j->>'$.owned_by' owner, (j->>'$.created')::bigint created,
coalesce(try_cast(j->>'$.max_model_len' as double), try_cast(j->>'$.context_window' as double), try_cast(j->>'$.context_length' as double))::bigint context_window, try_cast(j->>'$.max_completion_tokens' as bigint) output_tokens from r""")
def wire_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "list_payload").select("record_id", "provider_id", "payload").distinct()
    return openai_models(rows.withColumnRenamed("payload", "record")).select("record_id", "provider_id", "id", "owner", "created", "context_window", "output_tokens")


@query("""with p as (select distinct payload_id, case when json_valid(payload) then payload::json end j from endpoint_payload), d as (select payload_id, case when json_type(j, '$.data') = 'VARCHAR' then case when json_valid(j->>'$.data') then (j->>'$.data')::json end else j->'$.data' end d from p),
m as (select payload_id, unnest(case json_type(d, '$.architecture.input_modalities') when 'ARRAY' then cast(d->>'$.architecture.input_modalities[*]' as varchar[]) when 'VARCHAR' then list_transform(string_split(d->>'$.architecture.input_modalities', ','), lambda x: trim(x)) end) v from d),
n as (select payload_id, case v when 'pdf' then 'file' when 'embedding' then 'embeddings' else v end v from m), o as (select payload_id, v, coalesce(list_position(['text', 'image', 'file', 'audio', 'video', 'embeddings'], v), 7) r from n where v <> '' group by all)
select payload_id, string_agg(v, '+' order by r, v) || '->' modality from o group by 1""")
def modality_strings(spark: SparkSession, sf: str) -> DataFrame:
    """The modalities of each envelope, delivered as a list or as one text, in an object or in JSON held as text."""
    rows = table(spark, sf, "endpoint_payload").select("payload_id", "payload").distinct()
    data = F.try_parse_json(F.try_variant_get(F.try_parse_json("payload"), "$.data", "string"))
    said = rows.select("payload_id", F.explode(F.array(F.try_variant_get(data, "$.architecture.input_modalities", "variant"))).alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<string>"), F.transform(F.split(F.try_variant_get("v", "$", "string"), ","), lambda x: F.trim(x)))
    found = said.select("payload_id", F.filter(listed, lambda x: x != "").alias("m")).where("size(m) > 0")
    shown = J.architecture(F.col("m"), F.array().cast("array<string>"), F.lit(None).cast("string"))
    return found.groupBy("payload_id").agg(F.flatten(F.collect_set("m")).alias("m")).select("payload_id", shown["modality"].alias("modality"))


@query(f"with {_MODELS}, b as (select *, row_number() over (partition by id order by context_window desc nulls last, provider_id) n from models) select id, coalesce(max(context_window), 0) max_context, count(*) offerings, max(provider_id) filter (n = 1) top_provider from b group by 1")
def model_details(spark: SparkSession, sf: str) -> DataFrame:
    rows = models(spark, sf).select("id", "provider_id", "context_window")
    best = R.first_by(rows, ["id"], [F.col("context_window").desc_nulls_last(), F.col("provider_id")])
    return J.detail(rows.select("id").distinct(), rows, "id", best, "context_window")


@query(f"with {_MODELS}, c as (select provider_id, id, min(owned_by) owner, case when bool_or(id like '%embed%') then ['embeddings'] else ['chat_completions'] end ops from models group by all), e as (select *, unnest(ops) operation from c) select e.provider_id, e.id, operation, case when e.id like '%embed%' then 'https://' || e.provider_id || '.example/embeddings/' || e.id else 'https://' || e.provider_id || '.example/chat/' || e.id end url from e join provider p on p.id = e.provider_id")
def endpoint_urls(spark: SparkSession, sf: str) -> DataFrame:
    embed = F.col("id").contains("embed")
    text, none = F.array(F.lit("text")), F.array().cast("array<string>")
    offers = models(spark, sf).select("provider_id", "id", F.col("owned_by").alias("owner"), J.operations(text, text, F.when(embed, F.array(F.lit("embedding"))).otherwise(none)).alias("ops"))
    base = lambda kind: F.concat(F.lit("https://"), "id", F.lit(f".example/{kind}/{{model}}"))
    providers = table(spark, sf, "provider").select(F.col("id").alias("provider_id"), F.explode(F.create_map(F.lit("chat_completions"), base("chat"), F.lit("embeddings"), base("embeddings"))).alias("operation", "base_url"))
    return J.offering_endpoints(offers, ["provider_id", "id"], "ops", providers.withColumn("by_owner", F.lit(None).cast("map<string,string>")), "owner", "id").select("provider_id", "id", "operation", "url")


@query(f"with {_CLAIMS} select model_ref, {_sql_resolved('max_input_tokens', '0')} input_tokens, {_sql_resolved('context_length', '0')} context_window from claims group by 1")
def filled_limits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _claims(spark, sf).select("model_ref", "source_id", F.struct(F.col("max_input_tokens").alias("input_tokens"), F.col("context_length").alias("context_window")).alias("limits"))
    return A.filled_struct(rows, ["model_ref"], "source_id", FIRST, "limits").select("model_ref", "limits.input_tokens", "limits.context_window")


@query(f"""with {_CLAIMS}, e as (select model_ref, arg_max(source_id, struct_pack(o := observed_at, s := source_id)) by_, arg_max(max_input_tokens, struct_pack(o := observed_at, s := source_id)) said from claims where source_id <> 'local_catalog' and observed_at is not null and max_input_tokens is not null group by 1)
select c.model_ref, case when c.source_id = 'local_catalog' and e.by_ is not null and c.max_input_tokens = e.said then e.by_ else c.source_id end source_id, c.max_input_tokens from claims c left join e using (model_ref) where c.max_input_tokens is not null""")
def reattributed_claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = _claims(spark, sf).where("max_input_tokens is not null").select("model_ref", "source_id", "max_input_tokens", "observed_at")
    others = rows.where("source_id <> 'local_catalog' and observed_at is not null")
    evidence = others.groupBy("model_ref").agg(F.max_by(F.struct("source_id", "max_input_tokens"), F.struct("observed_at", "source_id")).alias("e")).select("model_ref", "e.source_id", "e.max_input_tokens")
    return A.reattributed(rows.drop("observed_at"), ["model_ref"], "source_id", "max_input_tokens", "local_catalog", evidence)
