"""Records out of JSON payloads, each accepted or quarantined on its own."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import bounded_side

#: The greatest size and nesting of a payload.
MOST_BYTES = 16 * 1024 * 1024
MOST_DEPTH = 64
_OUTSIDE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[^\[\]{}"]+', re.S)


@dataclass
class Decoded:
    """`accepted` rows with their fields, `rejected` ones with their text and reason, `report` with counts by payload."""

    accepted: DataFrame
    rejected: DataFrame
    report: DataFrame


def decode_records(payloads: DataFrame, key: str, payload: str, collection: str, schema: T.StructType, *, limit: int | None = None) -> Decoded:
    """The records of an array, or of the values of an object, at the member `collection` of each payload.

    Records are decoded one by one: one that isn't an object of the schema is rejected and the others
    stay.  Those of an object come in the order of their names; those beyond `limit` are rejected as
    truncated.  A payload without a readable collection has the error "envelope" and no records.
    """
    wire = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = payloads.select(F.col(key).alias("_key"), F.try_variant_get(F.try_parse_json(payload), f"$.{collection}", "variant").alias("_c"))
    as_array = F.try_variant_get("_c", "$", "array<variant>")
    as_map = F.try_variant_get("_c", "$", "map<string,variant>")
    named = F.transform(F.array_sort(F.map_keys(as_map)), lambda k: F.struct(k.alias("name"), F.element_at(as_map, k).alias("v")))
    items = F.coalesce(F.transform(as_array, lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("v"))), named)
    listed = parsed.select("_key", items.alias("_items"))
    each = listed.select("_key", F.col("_items").isNull().alias("_broken"), F.posexplode_outer("_items").alias("place", "_item"))
    text = F.to_json("_item.v")
    each = each.select("_key", "_broken", "place", F.col("_item.name").alias("name"), text.alias("text"))
    row = F.from_json("text", wire, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    tried = each.withColumn("_row", row)
    over = F.lit(False) if limit is None else F.col("place") >= limit
    reason = (
        F.when(F.col("_broken"), "envelope").when(F.col("place").isNull(), None).when(over, "truncated")
        .when(~F.col("text").startswith("{"), "not an object").when(F.col("_row._corrupt").isNotNull(), "schema")
    )
    tried = tried.withColumn("reason", reason)
    accepted = tried.where("reason is null and place is not null").select(F.col("_key").alias(key), "place", "name", *(F.col(f"_row.`{f.name}`").alias(f.name) for f in schema.fields))
    rejected = tried.where("reason is not null").select(F.col("_key").alias(key), "place", "name", "text", "reason")
    report = tried.groupBy(F.col("_key").alias(key)).agg(
        F.count_if(F.col("reason").isNull() & F.col("place").isNotNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "envelope")).alias("rejected"),
        F.bool_or(F.coalesce(F.col("reason") == "truncated", F.lit(False))).alias("truncated"),
        F.bool_or(F.coalesce(F.col("reason") == "envelope", F.lit(False))).alias("broken"),
    )
    return Decoded(accepted, rejected, report)


def strict_problems(payloads: DataFrame, key: str, payload: str, known: Sequence[str], *, version: int | None = None) -> DataFrame:
    """(key, problem) of the envelopes that a strict reader refuses: no JSON, text behind the value, no object, another version, or an unknown member (the first by name)."""
    whole = F.try_parse_json(payload)
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]")))
    first = F.try_variant_get(listed, "$[0]", "variant")
    parsed = payloads.select(F.col(key), F.explode_outer(F.array(F.struct(whole.alias("w"), first.alias("f"), F.try_variant_get(listed, "$[1]", "variant").alias("more")))).alias("_x"), F.col(payload).alias("_t"))
    members = F.try_variant_get("_x.f", "$", "map<string,variant>")
    other = F.array_sort(F.filter(F.map_keys(members), lambda k: ~k.isin(*known)))
    said = F.try_variant_get("_x.f", "$.version", "bigint")
    problem = (
        F.when(F.col("_t").isNull() | (F.trim("_t") == ""), "missing").when(F.col("_x.f").isNull(), "syntax").when(F.col("_x.more").isNotNull() | F.col("_x.w").isNull(), "trailing")
        .when(members.isNull(), "no object").when(F.lit(version is not None) & ~said.eqNullSafe(F.lit(version).cast("bigint")), "version")
        .when(F.size(other) > 0, F.concat(F.lit("unknown: "), F.get(other, F.lit(0))))
    )
    return parsed.select(key, problem.alias("problem")).where("problem is not null")


def unknown_members(payloads: DataFrame, key: str, payload: str, known: Sequence[str], prefix: str = "") -> DataFrame:
    """(key, path, digest) of the top-level members that the schema doesn't know; the digest is SHA-256 of the value's canonical JSON."""
    members = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    extra = F.map_filter(members, lambda k, _: ~k.isin(*known))
    long = payloads.select(F.col(key), F.explode(F.map_entries(extra)).alias("_e"))
    return long.select(key, F.concat(F.lit(prefix), F.col("_e.key")).alias("path"), F.sha2(F.to_json("_e.value"), 256).alias("digest"))


def oversized(payloads: DataFrame, key: str, payload: str, *, most_bytes: int = MOST_BYTES, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(key, problem) of payloads that are too large, nested too deep or no JSON."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_problem(t, most_bytes, most_depth) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [key, "problem"])

    picked = payloads.select(F.col(key), F.col(payload))
    return picked.mapInArrow(look, f"`{key}` {dict(picked.dtypes)[key]}, problem string").where("problem is not null")


def _problem(text: str | None, most_bytes: int, most_depth: int) -> str | None:
    if text is None:
        return "missing"
    if len(text.encode()) > most_bytes:
        return "size"
    brackets = np.frombuffer(_OUTSIDE.sub("", text).encode(), np.uint8)  # what stands in strings doesn't nest
    steps = np.isin(brackets, (91, 123)).astype(np.int32) - np.isin(brackets, (93, 125))
    if len(steps) and np.cumsum(steps).max() > most_depth:
        return "depth"
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return "syntax"
    return None


def quarantined(df: DataFrame, keys: Sequence[str], identity: Column, name: Column, place: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a sound identity and name, rejected rows with their reason): blank, padded or control characters, and later repeats of a key.

    The first place of each key is a small aggregate, so that neither a key that most rows have nor the
    rows without any meets in one window.
    """
    from pyspark.sql import Window

    sound = lambda c: F.when(c.isNull() | (F.trim(c) == ""), "blank").when(c != F.trim(c), "padded").when(c.rlike(r"\p{Cntrl}"), "control characters")
    reason = F.coalesce(F.concat(F.lit("id: "), sound(identity)), F.concat(F.lit("name: "), F.when(name.isNotNull(), sound(name))))
    columns = df.columns
    told = df.select("*", reason.alias("reason"), place.alias("_place"))
    sound_rows, bad = told.where("reason is null"), told.where("reason is not null")
    first = sound_rows.groupBy(*keys).agg(F.min("_place").alias("_first"))
    same = None
    for i, k in enumerate(keys):
        first = first.withColumnRenamed(k, f"_k{i}")
        same = F.col(k).eqNullSafe(F.col(f"_k{i}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = sound_rows.join(bounded_side(first), same)
    again = (F.col("_place") > F.col("_first")) | (F.row_number().over(Window.partitionBy(*keys, "_place").orderBy(F.lit(0))) > 1)
    joined = joined.withColumn("reason", F.when(again, F.lit("repeated")))
    repeated = joined.where("reason is not null").select(*columns, "reason")
    return joined.where("reason is null").select(*columns), bad.select(*columns, "reason").unionAll(repeated)
