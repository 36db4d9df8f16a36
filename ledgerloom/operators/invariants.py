"""Invariants of catalog rows as named rules; violations() lists those that a row breaks.

A rule is a condition that holds; null counts as holding, so a rule says for itself what a missing value
means.  Relations between rows are checked by joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import violations

#: What states may be.
AVAILABILITY = ("unknown", "available", "restricted", "unavailable")
LIFECYCLES = ("unknown", "active", "preview", "deprecated", "retired")
OPERATIONS = ("chat-completions", "embeddings")
COMPLETENESS, STATUSES = ("complete", "partial"), ("succeeded", "degraded", "failed")
#: Tags with the input and output that a model so tagged must declare.
TAGGED = {
    "embedding output": (("embed", "embedding"), "", "embedding"),
    "speech to text": (("stt", "speech_to_text"), "audio", "text"),
    "text to speech": (("tts", "text_to_speech"), "text", "audio"),
    "image output": (("image-gen", "text_to_image"), "", "image"),
    "video output": (("video-gen", "text_to_video"), "", "video"),
}


def required(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def distinct_and_filled(values: Column) -> Column:
    """Whether no element is blank and none occurs twice; a null list is fine."""
    return ~F.exists(values, lambda x: ~required(x)) & (F.size(F.array_distinct(values)) == F.size(values))


def in_order(first: Column, last: Column) -> Column:
    return first <= last


def reasoning_rule(reasons: Column, controls: Sequence[Column]) -> Column:
    """Whether what depends on reasoning comes with reasoning."""
    any_ = F.lit(False)
    for c in controls:
        any_ = any_ | F.coalesce(c, F.lit(False))
    return ~any_ | F.coalesce(reasons, F.lit(False))


def fact_rules(*, created: Column, updated: Column, reasons: Column, controls: Sequence[Column], tags: Column, inputs: Column, outputs: Column) -> dict[str, Column]:
    """Consistency of a model's facts: its times, its reasoning, and its tags with its modalities where both are stated."""
    rules = {"timestamps": in_order(created, updated), "reasoning": reasoning_rule(reasons, controls)}
    lower = F.transform(tags, F.lower)
    stated = inputs.isNotNull() | outputs.isNotNull()
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)) if v else F.lit(True)
    for name, (words, takes, gives) in TAGGED.items():
        tagged = F.coalesce(F.arrays_overlap(lower, F.array(*map(F.lit, words))), F.lit(False)) & stated
        rules[name] = ~tagged | (has(inputs, takes) & has(outputs, gives))
    return rules


def definition_rules(*, identity: Column, name: Column, authors: Column, root: Column, parent: Column) -> dict[str, Column]:
    return {"id": required(identity), "name": required(name), "authors": distinct_and_filled(authors), "lineage.root": root != identity, "lineage.parent": parent != identity}


def offering_rules(*, provider: Column, model: Column, definition: Column, availability: Column, lifecycle: Column, regions: Column, operations: Column, endpoints: Column) -> dict[str, Column]:
    """`endpoints` holds the operation of each endpoint."""
    known = ~F.exists(operations, lambda o: ~F.coalesce(o.isin(*OPERATIONS), F.lit(False))) & (F.size(F.array_distinct(operations)) == F.size(operations))
    named = (F.size(F.array_except(endpoints, F.coalesce(operations, F.array().cast("array<string>")))) == 0) & (F.size(F.array_distinct(endpoints)) == F.size(endpoints))
    return {
        "provider_id": required(provider), "provider_model_id": required(model), "definition_id": required(definition), "availability": F.coalesce(availability.isin(*AVAILABILITY), F.lit(False)),
        "lifecycle": F.coalesce(lifecycle.isin(*LIFECYCLES), F.lit(False)), "regions": distinct_and_filled(regions), "operations": known, "endpoints": named,
    }


def observation_rules(*, identity: Column, source: Column, observed_at: Column, completeness: Column, status: Column, accepted: Column, rejected: Column) -> dict[str, Column]:
    """A whole observation has rejected nothing, a failed one accepted nothing, and counts aren't negative."""
    return {
        "id": required(identity), "source": required(source), "observed_at": observed_at.isNotNull(), "completeness": F.coalesce(completeness.isin(*COMPLETENESS), F.lit(False)),
        "counts": (F.coalesce(accepted, F.lit(0)) >= 0) & (F.coalesce(rejected, F.lit(0)) >= 0), "complete": (completeness != "complete") | (F.coalesce(rejected, F.lit(0)) == 0),
        "failed": (status != "failed") | (F.coalesce(accepted, F.lit(0)) == 0),
    }


def checked(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, violations) of the rows that break a rule, which are listed in the order of the rules."""
    return df.select(*keys, violations(rules).alias("violations")).where("size(violations) > 0")


def dangling(df: DataFrame, keys: Sequence[str], reference: str, targets: DataFrame, target: str) -> DataFrame:
    """(keys, reference) of the rows whose reference is stated but is no target."""
    known = targets.select(F.col(target).alias("_target")).where("_target is not null").distinct()
    return df.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("_target"), "left_anti").select(*keys, reference)


def out_of_order(df: DataFrame, group: Sequence[str], place: str, order: Sequence[str]) -> DataFrame:
    """(group, place) of the rows that stand behind one that should come after them."""
    from pyspark.sql import Window

    key = F.struct(*order)
    return df.withColumn("_before", F.lag(key).over(Window.partitionBy(*group).orderBy(place))).where(F.col("_before") > key).select(*group, place)
