"""Differences between two versions of models, providers or authors by the paths that a change report names.

What a path is compared by and how its values are shown is data; a comparison is one full join whose
changed paths are a filtered array of expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import MISSING, UNKNOWN, short_count, truncated


@dataclass(frozen=True)
class Tracked:
    """A path of a report: how its values are shown, the section it belongs to, whether it is only compared in depth.

    A section that one side lacks is a change by itself, of which the members tell nothing more.
    """

    path: str
    shown: str = "text"
    section: str = ""
    deep: bool = False


def _section(name: str, *members: tuple[str, str]) -> tuple[Tracked, ...]:
    return tuple(Tracked(f"{name}.{path}", shown, name, True) for path, shown in members)


# The paths of change reports in their order.
MODEL_PATHS = (
    Tracked("name"),
    Tracked("description", "presence"),
    Tracked("status"),
    *_section("features", ("tools", "presence"), ("reasoning", "presence"), ("streaming", "presence"), ("modalities.input", "joined"), ("modalities.output", "joined")),
    *(Tracked(p, "present", deep=True) for p in ("attachments", "lineage", "generation", "reasoning", "reasoning_tokens", "verbosity", "tools", "response")),
    Tracked("modes", "modes", deep=True),
    *_section("pricing", ("currency", "text"), ("tokens", "present"), ("operations", "present"), ("tiers", "tiers")),
    *_section("limits", ("context_window", "tokens"), ("input_tokens", "tokens"), ("output_tokens", "tokens")),
    *_section("metadata", ("knowledge_cutoff", "day"), ("release_date", "day"), ("open_weights", "presence"), ("tags", "tags"), ("architecture", "present")),
    Tracked("extensions", "sources", deep=True),
)
PROVIDER_PATHS = (
    Tracked("name"),
    Tracked("aliases", "aliases"),
    Tracked("headquarters"),
    Tracked("icon_url"),
    Tracked("credentials", "config changed"),
    Tracked("catalog", "settings changed"),
    Tracked("status_page_url"),
    Tracked("inference", "present"),
    Tracked("privacy_policy", "present"),
    Tracked("retention_policy", "present"),
    Tracked("governance_policy", "present"),
    Tracked("extensions", "sources"),
)
AUTHOR_PATHS = (Tracked("name"), Tracked("website", "blank"), Tracked("description", "cut"))

_CHANGE = "array<struct<path:string,old:string,new:string>>"


def _kind(schema: T.StructType, path: str) -> T.DataType | None:
    """The type of a dotted path, null where the schema lacks it."""
    kind: T.DataType = schema
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.fieldNames():
            return None
        kind = kind[step].dataType
    return kind


def _at(side: str, path: str) -> Column:
    return reduce(lambda c, step: c.getField(step), path.split("."), F.col(side))


def _comparable(value: Column, kind: T.DataType) -> Column:
    """A value as something that can be compared: maps, which can't, as their entries in the order of their keys."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("k"), _comparable(F.element_at(value, k), kind.valueType).alias("v")))
        return entries
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_comparable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.MapType, T.StructType)):
        return F.transform(value, lambda x: _comparable(x, kind.elementType))
    return value


def _shown(value: Column, kind: T.DataType, how: str, new: bool) -> Column:
    """A value as a report shows it."""
    if how in ("presence", "tokens"):
        inner = value.getField("value")
        known = short_count(inner) if how == "tokens" else inner.cast("string")
        state = F.coalesce(value.getField("state"), F.lit(MISSING))
        return F.when(state == MISSING, "missing").when(state == UNKNOWN, "unknown").otherwise(known)
    if how == "present":
        return F.when(value.isNull(), "absent").otherwise("present")
    if how in ("config changed", "settings changed"):
        return F.lit("updated" if new else how)
    if how == "joined":
        return F.coalesce(F.array_join(value, ","), F.lit(""))
    if how == "day":
        return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))
    if how == "cut":
        return truncated(F.coalesce(value, F.lit("")), 50)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.concat_ws(" ", F.coalesce(F.nullif(F.size(value), F.lit(-1)), F.lit(0)).cast("string"), F.lit(how))
    return F.coalesce(value.cast("string"), F.lit(""))


def typed_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], paths: Iterable[Tracked], *, ignored: Sequence[str] = (), deep: bool = True) -> DataFrame:
    """(keys, change_type, changes): added, removed and updated rows; `changes` lists (path, old, new) of an update in the order of `paths`.

    A path is compared if both versions have it; members that say whether they are stated are structs
    (value, state).  Paths in `ignored`, or below one of them, aren't compared, nor are those of depth
    unless `deep`.

    Cases: null is a value of its own, but blank and null are alike where a report shows them alike
    (website, description of authors) and an empty list counts as none; keys that occur twice on a side
    give a row for each pair; null keys never meet; an empty version makes all rows added or removed;
    other columns are never read.
    """
    schema = T.StructType([f for f in new.schema.fields if f.name in old.columns and f.name not in keys])
    wanted = [p for p in paths if (deep or not p.deep) and not any(p.path == i or p.path.startswith(f"{i}.") for i in ignored)]
    each = []
    for section in dict.fromkeys(p.section for p in wanted if p.section and p.section in schema.fieldNames()):
        a, b = F.col(f"_old.{section}").isNotNull(), F.col(f"_new.{section}").isNotNull()
        each.append((next(i for i, p in enumerate(wanted) if p.section == section), F.when(a != b, _change(section, a.cast("string"), b.cast("string")))))
    for i, p in enumerate(wanted):
        kind = _kind(schema, p.path)
        if kind is None:
            continue
        a, b = _at("_old", p.path), _at("_new", p.path)
        left, right = (_comparable(_plain(v, p, kind), kind) for v in (a, b))
        differs = ~left.eqNullSafe(right)
        if p.section:
            differs = differs & F.col(f"_old.{p.section}").isNotNull() & F.col(f"_new.{p.section}").isNotNull()
        each.append((i, F.when(differs, _change(p.path, _shown(a, kind, p.shown, False), _shown(b, kind, p.shown, True)))))
    names = schema.fieldNames()
    side = lambda df, mark: df.select(*keys, F.struct(F.lit(True).alias("__here"), *(F.col(f"`{n}`") for n in names)).alias(mark))
    joined = side(old, "_old").join(side(new, "_new"), list(keys), "full")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    none = F.array().cast(_CHANGE)
    changes = F.when(both, F.array_compact(F.array(*(c for _, c in sorted(each, key=lambda x: x[0])))) if each else none).otherwise(none)
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size("changes") > 0, "updated")
    return joined.select(*keys, "_old", "_new", changes.alias("changes")).select(*keys, kind.alias("change_type"), "changes").where("change_type is not null")


def _change(path: str, old: Column, new: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), old.alias("old"), new.alias("new"))


def _plain(value: Column, tracked: Tracked, kind: T.DataType) -> Column:
    """A value as it is compared: blanks and empty lists count as none where they are shown as such."""
    if tracked.shown in ("blank", "cut"):
        return F.coalesce(value, F.lit(""))
    if tracked.shown == "joined":
        return F.coalesce(value, F.array().cast(kind))
    if tracked.shown in ("presence", "tokens"):
        return F.when(F.coalesce(value.getField("state"), F.lit(MISSING)) > MISSING, value)
    return value
