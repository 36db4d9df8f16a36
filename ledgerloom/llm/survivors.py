"""Best representative of each duplicate group.

Records are ranked by trust, recency and completeness with a deterministic tie-break in a window
that keeps the top row, either for each field on its own or for whole records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded_side

#: A price in dollars as listings spell it; what it captures is the number.
_PRICE = r"(?i)^(?:us ?\$|\$|usd ?\$?)? ?\+?(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?) ?(?:us ?\$|\$|usd|dollars?)?$"


@dataclass(frozen=True)
class Field:
    """A field that survives on its own: its name in the authority table, its value, what makes it usable."""

    name: str
    value: Column
    usable: Column


def token_count(name: str, value: Column, most: int = 100_000_000) -> Field:
    return Field(name, value, value.between(1, most))


def dollar_price(text: Column) -> Column:
    """The number of a dollar price of zero or more, null for any other text."""
    t = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.nullif(F.regexp_extract(t, _PRICE, 1), F.lit("")).try_cast("double")


def listing_fields() -> list[Field]:
    prompt = F.col("openrouter.prompt")
    return [
        token_count("max_input_tokens", F.col("max_input_tokens")),
        token_count("openrouter.context_length", F.col("openrouter.context_length")),
        Field("openrouter.prompt", prompt, dollar_price(prompt) >= 0),
    ]


def _candidates(listings: DataFrame, fields: list[Field], group: str, key: str, source: str, seen: str) -> DataFrame:
    offered = F.array(*(F.struct(F.lit(f.name).alias("field_name"), F.when(f.usable, f.value.cast("string")).alias("value")) for f in fields))
    long = listings.select(
        F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(seen).alias("_seen"), offered.alias("_offered")
    ).select("_group", "_key", "_source", "_seen", F.inline_outer("_offered"))
    return long.where("_group is not null and _key is not null and value is not null")


def surviving_fields(listings: DataFrame, authority: DataFrame, fields: list[Field] | None = None, *, group: str = "model_ref", key: str = "listing_id", source: str = "source_id", seen: str = "observed_at") -> DataFrame:
    """(group, field_name, key, value): for each group of two or more keys and each field, the row whose value survives.

    Only usable values take part.  The lowest priority that `authority` (field_name, source_id,
    priority) gives the source wins, sources it doesn't list coming last; then the latest `seen`, null
    being oldest; then the smallest key; then the smallest value, should a key have several rows.

    Cases: a field without a usable value has no row; rows with a null group or key don't count; a
    null struct has null members; repeated rows count once; an authority listed twice counts with its
    best priority; an empty table gives no rows; other columns are never read.

    The row number is limited to 1, so each task drops all but its best row of a group before the
    shuffle, however large the group is.
    """
    fields = listing_fields() if fields is None else fields
    ranks = authority.groupBy(F.col("field_name").alias("_field"), F.col("source_id").alias("_of")).agg(F.min("priority").alias("_priority"))
    ranked = _candidates(listings, fields, group, key, source, seen).join(
        bounded_side(ranks), (F.col("field_name") == F.col("_field")) & (F.col("_source") == F.col("_of")), "left"
    )
    best = Window.partitionBy("_group", "field_name").orderBy(F.col("_priority").asc_nulls_last(), F.col("_seen").desc_nulls_last(), "_key", "value")
    first = ranked.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    several = (
        listings.select(F.col(group).alias("_several"), F.col(key).alias("_key")).dropna()
        .groupBy("_several").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high")).where("_low <> _high")
    )
    return first.join(several, F.col("_group") == F.col("_several"), "left_semi").select(
        F.col("_group").alias(group), "field_name", F.col("_key").alias(key), "value"
    )


def surviving_records(listings: DataFrame, authority: DataFrame, fields: list[Field] | None = None, *, group: str = "model_ref", key: str = "listing_id", source: str = "source_id", seen: str = "observed_at", trusted: bool = False, every_group: bool = False) -> DataFrame:
    """One row for each group of two or more keys: the most complete record and the value that survives for each field.

    `key` is the record with the most usable fields, then, with `trusted`, the one whose source is trusted
    most (listed for the most of the fields, then the lowest sum of priorities over them), then the latest,
    then the smallest key.  Each field has its value and the key of the record that
    it came from.  The cases are those of surviving_fields; a group without a usable value has no row, or
    with `every_group` its best record with null fields.
    """
    fields = listing_fields() if fields is None else fields
    usable = [F.when(f.usable, 1).otherwise(0) for f in fields]
    complete = sum(usable[1:], usable[0])
    records = listings.select(
        F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(seen).alias("_seen"), complete.alias("_complete")
    ).where("_group is not null and _key is not null")
    trust: list[Column] = []
    if trusted:
        ranks = authority.where(F.col("field_name").isin(*(f.name for f in fields))).groupBy("field_name", F.col("source_id").alias("_of")).agg(F.min("priority").alias("_priority"))
        sums = ranks.groupBy("_of").agg(F.count("_priority").alias("_listed"), F.sum("_priority").alias("_sum"))
        records = records.join(bounded_side(sums), F.col("_source") == F.col("_of"), "left")
        trust = [F.coalesce("_listed", F.lit(0)).desc(), F.coalesce("_sum", F.lit(0)).asc()]
    best = Window.partitionBy("_group").orderBy(F.col("_complete").desc(), *trust, F.col("_seen").desc_nulls_last(), "_key")
    whole = records.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("_group", "_key", "_complete")
    each = surviving_fields(listings, authority, fields, group=group, key=key, source=source, seen=seen)
    pick = lambda name: F.max(F.when(F.col("field_name") == name, F.struct("value", F.col(key).alias("from_key"))))
    wide = each.groupBy(F.col(group).alias("_g")).agg(*(pick(f.name).alias(f"_f{i}") for i, f in enumerate(fields)))
    named = [c for i, f in enumerate(fields) for c in (F.col(f"_f{i}.value").alias(f.name.replace(".", "_")), F.col(f"_f{i}.from_key").alias(f"{f.name.replace('.', '_')}_from"))]
    if every_group:
        keys = records.groupBy("_group").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high")).where("_low <> _high")
        whole = whole.join(keys.select(F.col("_group").alias("_several")), F.col("_group") == F.col("_several"), "left_semi")
    return whole.join(wide, F.col("_group") == F.col("_g"), "left" if every_group else "inner").select(F.col("_group").alias(group), F.col("_key").alias(key), F.col("_complete").alias("usable_fields"), *named)
