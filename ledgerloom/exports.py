"""Catalog relations as documents for clients."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows
from .functions.scalars import epoch_seconds, short_count, truncated


def model_list(df: DataFrame, identity: Column, created: Column, owners: Column) -> DataFrame:
    """(id, object, created, owned_by): the list form of models; several owners are joined by commas, none is "system"."""
    joined = F.nullif(F.concat_ws(",", owners), F.lit(""))
    return df.select(identity.alias("id"), F.lit("model").alias("object"), epoch_seconds(created).alias("created"), F.coalesce(joined, F.lit("system")).alias("owned_by"))


def display_rows(df: DataFrame, identity: Column, name: Column, context: Column, description: Column) -> DataFrame:
    """Rows for a text table: short token counts, cut descriptions, a dash for nothing."""
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    return df.select(identity.alias("id"), dash(name).alias("name"), F.coalesce(F.when(context > 0, short_count(context)), F.lit("-")).alias("context"), truncated(dash(description), 80).alias("description"))


def as_json(df: DataFrame, order: Sequence[Column], *, most: int = 100_000) -> str:
    """The rows as one deterministic JSON array; for relations of bounded size."""
    rows = bounded_rows(df.select(F.to_json(F.struct("*")).alias("j"), *(o.alias(f"_o{i}") for i, o in enumerate(order))).orderBy(*(f"_o{i}" for i in range(len(order)))).select("j"), most)
    return json.dumps([json.loads(r[0]) for r in rows], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def as_yaml(df: DataFrame, order: Sequence[Column], **options) -> str:
    import yaml

    return yaml.safe_dump(json.loads(as_json(df, order, **options)), sort_keys=True, allow_unicode=True)


def as_table(df: DataFrame, *, most: int = 1000) -> str:
    """The rows as aligned text."""
    rows = [df.columns, *([("" if v is None else str(v)) for v in r] for r in bounded_rows(df, most))]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)
