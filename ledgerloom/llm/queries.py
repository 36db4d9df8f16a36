"""Queries of the training-data operators: p2, p5, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import bounded_side, table
from .canonical import matched
from .mixing import mix_documents
from .packing import fill_report, pack_documents
from .residue import residue, validation
from .survivors import surviving_fields, surviving_records


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = surviving_fields(table(spark, sf, "model_listing"), table(spark, sf, "source_authority"))
    return found.select("model_ref", "field_name", "listing_id")


def p2_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return surviving_records(table(spark, sf, "model_listing"), table(spark, sf, "source_authority"), trusted=True, every_group=True)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return matched(table(spark, sf, "model_listing"), table(spark, sf, "author"))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), table(spark, sf, "pack_limit"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p7_pack(spark, sf), table(spark, sf, "pack_limit"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_target"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents"))


def p9_validation(spark: SparkSession, sf: str) -> DataFrame:
    return validation(table(spark, sf, "documents"))


def p5_exact(spark: SparkSession, sf: str) -> DataFrame:
    """What p5_found says of the values that are, but for case and blanks around them, an id, name or alias of just one author."""
    forms = table(spark, sf, "author").select("id", F.explode(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    forms = forms.select("id", F.lower(F.trim("form")).alias("form")).where("form <> ''").groupBy("form").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low = high")
    written = table(spark, sf, "model_listing").select("listing_id", F.lower(F.trim("owned_by")).alias("form"))
    exact = written.join(bounded_side(forms), "form").select("listing_id").distinct()
    return p5_found(spark, sf).join(exact, "listing_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_survivors, p5_found, p5_exact, p7_pack, p7_fill, p8_mix, p8_shares, p9_found, p9_validation)}

_USABLE = """
rows as (select distinct listing_id, model_ref, source_id, observed_at, max_input_tokens, openrouter from model_listing),
priced as (select *, regexp_replace(trim(openrouter.prompt), '^(USD ?|\\$)|( ?USD)$', '', 'g') price from rows),
long as (
  select listing_id, model_ref, source_id, observed_at, 'max_input_tokens' field_name, max_input_tokens::varchar v from rows where max_input_tokens between 1 and 100000000
  union all select listing_id, model_ref, source_id, observed_at, 'openrouter.context_length', openrouter.context_length::varchar from rows where openrouter.context_length between 1 and 100000000
  union all select listing_id, model_ref, source_id, observed_at, 'openrouter.prompt', openrouter.prompt from priced where regexp_full_match(price, '\\d+(\\.\\d+)?([eE][+-]?\\d+)?')),
several as (select model_ref from rows group by 1 having count(distinct listing_id) > 1),
ranked as (select l.*, row_number() over (partition by l.model_ref, l.field_name order by priority nulls last, observed_at desc nulls last, listing_id) n
  from long l join several using (model_ref) left join source_authority a on a.field_name = l.field_name and a.source_id = l.source_id)"""

_FIELDS = "('max_input_tokens', 'openrouter.context_length', 'openrouter.prompt')"

SQL = {
    "p2_survivors": f"""with {_USABLE},
trust as (select source_id, count(*) listed, sum(p) total from (select source_id, field_name, min(priority) p from source_authority where field_name in {_FIELDS} group by all) group by 1),
graded as (select p.listing_id, p.model_ref, p.source_id, p.observed_at, coalesce(max_input_tokens between 1 and 100000000, false)::int + coalesce(openrouter.context_length between 1 and 100000000, false)::int + coalesce(regexp_full_match(price, '\\d+(\\.\\d+)?([eE][+-]?\\d+)?'), false)::int usable
  from priced p where model_ref is not null),
best as (select g.*, row_number() over (partition by model_ref order by usable desc, coalesce(listed, 0) desc, coalesce(total, 0), observed_at desc nulls last, listing_id) n from graded g join several using (model_ref) left join trust using (source_id)),
won as (select model_ref, field_name, listing_id, v from ranked where n = 1)
select b.model_ref, b.listing_id, b.usable usable_fields, i.v max_input_tokens, i.listing_id max_input_tokens_from, c.v openrouter_context_length, c.listing_id openrouter_context_length_from, p.v openrouter_prompt, p.listing_id openrouter_prompt_from
from best b left join won i on i.model_ref = b.model_ref and i.field_name = 'max_input_tokens' left join won c on c.model_ref = b.model_ref and c.field_name = 'openrouter.context_length' left join won p on p.model_ref = b.model_ref and p.field_name = 'openrouter.prompt' where b.n = 1""",
    "p5_exact": """with forms as (select lower(trim(f)) form, min(id) low, max(id) high from (select id, unnest(list_concat([id, name], coalesce(aliases, []))) f from author) where f is not null and trim(f) <> '' group by 1)
select distinct listing_id, low author_id from model_listing join forms on form = lower(trim(owned_by)) where low = high""",
    "p2_found": f"with {_USABLE} select model_ref, field_name, listing_id from ranked where n = 1",
}
