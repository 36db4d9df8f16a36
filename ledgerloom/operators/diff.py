"""Differences between two versions of a relation, by key and by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import glob_regex


def _text(value: Column, kind: str) -> Column:
    return F.to_json(value) if kind.startswith(("struct", "array", "map")) else value.cast("string")


def field_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Mapping[str, str] | Sequence[str], *, ignored: Sequence[str] = (), deep: bool = True) -> DataFrame:
    """(keys, change_type, changes): added, removed and updated rows; `changes` lists (path, old, new) of an update.

    `fields` maps a path to the column that holds it.  Paths that fit a glob in `ignored` aren't
    compared, nor are dotted ones unless `deep`.  Keys that occur twice on a side give a row for each
    pair; null keys never meet.
    """
    import re

    paths = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    paths = {p: c for p, c in paths.items() if not any(re.match(glob_regex(g, across=True), p) for g in ignored) and (deep or "." not in p)}
    kinds = dict(old.dtypes)
    side = lambda df, mark: df.select(*keys, F.struct(*(_text(F.col(c), kinds[c]).alias(f"f{i}") for i, c in enumerate(paths.values())), F.lit(1).alias("here")).alias(mark))
    joined = side(old, "_old").join(side(new, "_new"), list(keys), "full")
    each = [F.when(~F.col(f"_old.f{i}").eqNullSafe(F.col(f"_new.f{i}")), F.struct(F.lit(p).alias("path"), F.col(f"_old.f{i}").alias("old"), F.col(f"_new.f{i}").alias("new"))) for i, p in enumerate(paths)]
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    changes = F.when(both, F.array_compact(F.array(*each))).otherwise(F.array().cast("array<struct<path:string,old:string,new:string>>"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size("changes") > 0, "updated")
    return joined.select(*keys, "_old", "_new", changes.alias("changes")).select(*keys, kind.alias("change_type"), "changes").where("change_type is not null")


def change_rows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change_type, path, old, new): one row for each changed field, one with a null path for each added or removed row."""
    return changes.select(*keys, "change_type", F.explode_outer("changes").alias("_c")).select(*keys, "change_type", "_c.path", "_c.old", "_c.new")


def summary(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, added, updated, removed, total)."""
    count = lambda k: F.count_if(F.col("change_type") == k).alias(k)
    return changes.groupBy(*by).agg(count("added"), count("updated"), count("removed"), F.count(F.lit(1)).alias("total"))


def touched(changes: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Updates with at least one changed path that fits one of the globs."""
    fits = lambda c: _any([c["path"].rlike(glob_regex(p, across=True)) for p in paths])
    return changes.where(F.exists("changes", fits))


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def should_publish(changes: DataFrame, *, forced: bool = False, review: DataFrame | None = None) -> bool:
    """Whether there is anything to publish: a change, a candidate for review, or force. Stops at the first row."""
    return forced or not changes.limit(1).isEmpty() or review is not None and not review.limit(1).isEmpty()
