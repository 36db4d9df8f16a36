"""Writes to relations as set operations: every one returns a new relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_by


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All existing rows, and incoming ones whose key is new."""
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti"))


def appended(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of both, repeats too: entries are added to those of the same key."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def first_filled(*corpora: DataFrame) -> DataFrame:
    """The first of the relations that has any row, else the last; each but the last is read up to its first row."""
    for corpus_ in corpora[:-1]:
        if not corpus_.limit(1).isEmpty():
            return corpus_
    return corpora[-1]


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows, and existing ones whose key they don't have."""
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def deleted(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key isn't gone, keys that were to go but aren't there)."""
    return existing.join(gone.select(*keys), list(keys), "left_anti"), gone.select(*keys).distinct().join(existing.select(*keys), list(keys), "left_anti")


def inserted(existing: DataFrame, batch: DataFrame, keys: Sequence[str], place: str) -> tuple[DataFrame, DataFrame]:
    """(existing and new rows, rows in conflict): of several rows of a batch with one key the last by `place` holds."""
    last = first_by(batch, keys, [F.col(place).desc()])
    fresh = last.join(existing.select(*keys), list(keys), "left_anti").drop(place)
    return existing.unionByName(fresh), last.join(existing.select(*keys), list(keys), "left_semi")


def refused_deletes(owners: DataFrame, key: str, used: DataFrame, by: str) -> DataFrame:
    """Owners that can't be deleted because a row still refers to them."""
    return owners.join(used.select(F.col(by).alias("_by")).where("_by is not null").distinct(), F.col(key) == F.col("_by"), "left_semi")


def corpus(baseline: DataFrame, bootstrap: DataFrame, local: DataFrame, keys: Sequence[str], *, complete: bool) -> DataFrame:
    """Local rows over the baseline over new bootstrap rows.

    A baseline row that neither local nor bootstrap has is dropped only if the local observation is
    complete: absence is no deletion otherwise.
    """
    lacks = lambda df, other: df.join(other.select(*keys), list(keys), "left_anti")
    old = lacks(baseline, local)
    if complete:
        old = old.join(bootstrap.select(*keys).distinct(), list(keys), "left_semi")
    return local.unionByName(old).unionByName(lacks(lacks(bootstrap, baseline), local))


def restricted(rows: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Rows whose key names a target of an alias table, renamed to it."""
    named = aliases.select(F.col("alias").alias("_alias"), F.col("target").alias("_target")).where("_target is not null")
    return rows.join(named, F.col(key) == F.col("_alias")).withColumn(key, F.col("_target")).drop("_alias", "_target")
