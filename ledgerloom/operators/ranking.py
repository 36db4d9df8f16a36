"""Ranking of facts and histories of evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; each task keeps one row of a key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def unknown_on_tie(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """(keys, value, agreed): the value of the top rank, null where rows that tie for it differ."""
    window = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("_r", F.rank().over(window)).where("_r = 1")
    both = top.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.bool_or(F.col(value).isNull()).alias("_null"))
    agreed = (F.col("_low") == F.col("_high")) & ~F.col("_null")
    return both.select(*keys, F.when(agreed, F.col("_low")).alias(value), F.coalesce(agreed, F.lit(False)).alias("agreed"))


#: The evidence behind a fact, what counts most first; more is better in each.
EVIDENCE = ("has_evidence", "authority", "observed_at", "stated_at", "confidence", "recorded_at")


def evidence_order(columns: Mapping[str, Column]) -> list[Column]:
    """Sort keys of facts by the evidence behind them; a missing one counts least."""
    return [columns[name].desc_nulls_last() for name in EVIDENCE if name in columns]


def fact_by_evidence(facts: DataFrame, keys: Sequence[str], evidence: Mapping[str, Column], value: str, provider: str) -> DataFrame:
    """(keys, value, provider, agreed, held): the fact of the best evidence.

    Where facts tie for it and differ, `value` is null and `agreed` false; `held` is then the one that
    comes first by value and provider, which decides where a value must be had.  Facts without a value
    don't take part.
    """
    known = facts.where(F.col(value).isNotNull())
    window = Window.partitionBy(*keys).orderBy(*evidence_order(evidence))
    top = known.withColumn("_r", F.rank().over(window)).where("_r = 1")
    first = F.min_by(F.struct(F.col(value).alias("v"), F.col(provider).alias("p")), F.struct(F.col(value).alias("v"), F.col(provider).alias("p"))).alias("_first")
    both = top.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), first)
    agreed = F.col("_low") == F.col("_high")
    return both.select(*keys, F.when(agreed, F.col("_low")).alias(value), F.col("_first.p").alias(provider), agreed.alias("agreed"), F.col("_first.v").alias("held"))


def history(df: DataFrame, keys: Sequence[str], field: str, time: str, ties: Sequence[Column] = ()) -> DataFrame:
    """`df` with `place` within each field's history, newest first, and `current` for the newest."""
    window = Window.partitionBy(*keys, field).orderBy(F.col(time).desc_nulls_last(), *ties)
    return df.withColumn("place", F.row_number().over(window)).withColumn("current", F.col("place") == 1)


def conflicts(df: DataFrame, keys: Sequence[str], time: str, score: str, value: str) -> DataFrame:
    """(keys, second, entries, winner): times at which more than one entry was made, and the value of the highest positive score, then the smallest."""
    second = F.date_trunc("second", F.col(time)).alias("second")
    order = F.when((F.col(score) > 0) & F.col(value).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(value).alias("v")))
    grouped = df.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("entries"), F.min_by(F.col(value), order).alias("winner"))
    return grouped.where("entries > 1").select(*keys, "second", F.col("entries").cast("bigint").alias("entries"), "winner")


def current_evidence(evidence: DataFrame, keys: Sequence[str], time: str, position: str, value: str, facts: DataFrame, fact: str) -> DataFrame:
    """`facts` with `supported`: whether the latest evidence of the key states the same value."""
    latest = first_by(evidence, keys, [F.col(time).desc_nulls_last(), F.col(position).asc()]).select(*keys, F.col(value).alias("_value"))
    return facts.join(latest, list(keys), "left").withColumn("supported", F.col("_value").eqNullSafe(F.col(fact)) & F.col("_value").isNotNull()).drop("_value")
