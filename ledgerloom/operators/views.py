"""Derived views: definitions, offerings and memberships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded_side, durable
from .lookup import duplicate_keys


def offering_index(providers: DataFrame, models: DataFrame, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(offerings of known providers, keys that occur more than once)."""
    offers = models.join(providers.select(provider).distinct(), provider, "left_semi")
    return offers, duplicate_keys(offers, [provider, model])


def definitions(offers: DataFrame, key: str, *, flags: Sequence[str] = (), lists: Sequence[str] = (), created: str | None = None, updated: str | None = None, largest: Sequence[str] = ()) -> DataFrame:
    """One row for each definition: flags true if any offering claims them, sorted distinct list values, first and last times, largest numbers.

    Lists are reduced to distinct elements before they are collected, so they are as long as the result.
    """
    times = ([F.min(created).alias(created)] if created else []) + ([F.max(updated).alias(updated)] if updated else [])
    base = offers.groupBy(key).agg(F.count(F.lit(1)).alias("offerings"), *(F.bool_or(f).alias(f) for f in flags), *times, *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in largest))
    for name in lists:
        flat = offers.select(key, F.explode(name).alias("_e")).where("_e is not null").distinct()
        base = base.join(flat.groupBy(key).agg(F.sort_array(F.collect_list("_e")).alias(name)), key, "left")
        base = base.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
    return base


def membership(pairs: DataFrame, owner: str, member: str, aliases: DataFrame | None = None) -> DataFrame:
    """(owner, members): sorted distinct members of each owner, under its aliases too."""
    flat = pairs.select(owner, member).dropna().distinct()
    if aliases is not None:
        named = aliases.select(F.col("target").alias(owner), F.col("alias").alias("_alias")).where("_alias is not null").distinct()
        flat = flat.unionAll(flat.join(named, owner).select(F.col("_alias").alias(owner), member)).distinct()
    return flat.groupBy(owner).agg(F.sort_array(F.collect_list(member)).alias("members"))


def ordered_list(rows: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str], *, page_rows: int = 100_000) -> DataFrame:
    """(key, page, items): the rows of a key as ordered arrays of structs, of at most `page_rows` each; page 0 has the first.

    Where no key has more rows than a page, one aggregation makes the lists.  Else the rows are sorted by
    range, which deals a large key out to many tasks, and counts of each key and range tell where a
    row stands.
    """
    keyed = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*fields).alias("row"))
    flat = rows.select(F.col(key).alias("_k"), keyed.alias("_i"))
    if flat.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > page_rows).isEmpty():
        lists = flat.groupBy("_k").agg(F.collect_list("_i").alias("_all")).withColumn("page", F.lit(0).cast("bigint"))
    else:
        ranged = durable(flat.repartitionByRange("_k", "_i").sortWithinPartitions("_k", "_i").select("_k", "_i", F.spark_partition_id().alias("_p")))
        before = F.sum("n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
        counts = ranged.groupBy("_k", "_p").agg(F.count(F.lit(1)).alias("n")).select("_k", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
        inside = F.row_number().over(Window.partitionBy("_k", "_p").orderBy("_i")) - 1
        placed = ranged.withColumn("_at", inside).join(bounded_side(counts), ["_k", "_p"])
        lists = placed.groupBy("_k", F.floor((F.col("_at") + F.col("_before")) / page_rows).alias("page")).agg(F.collect_list("_i").alias("_all"))
    return lists.select(F.col("_k").alias(key), "page", F.transform(F.sort_array("_all"), lambda x: x["row"]).alias("items"))


def gate(candidate: DataFrame, current: DataFrame, group: str, key: str, *, least_groups: int, least_keys: int, keep_groups: float, keep_keys: float) -> DataFrame:
    """One row: sizes of a candidate and what it replaces, and whether it may be promoted."""
    size = lambda df, g, k: df.agg(F.count_distinct(group).alias(g), F.count_distinct(group, key).alias(k))
    both = size(candidate, "groups", "keys").join(size(current, "old_groups", "old_keys"))  # two single rows
    fine = (F.col("groups") >= least_groups) & (F.col("keys") >= least_keys) & (F.col("groups") >= F.col("old_groups") * keep_groups) & (F.col("keys") >= F.col("old_keys") * keep_keys)
    return both.withColumn("promoted", fine)
