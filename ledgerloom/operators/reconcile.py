"""Reconciliation of observations from several sources into one catalog relation.

Each key's latest row of each source becomes a column of its own in one aggregation; every policy is
then an expression over these columns in the policy's order of sources.  So a relation with any number
of policies is reconciled in a single exchange, and no list of rows is ever collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .authority import POLICIES, Policy, change_aware_times, find_policy, is_zero
from .diff import field_changes

#: Paths that say when a row was made and last changed; they follow the facts.
CREATED, UPDATED = "created_at", "updated_at"


@dataclass
class Reconciled:
    """`rows` of the merged relation, `provenance` (keys, field, source, value, authority, reason) of each decided field, `changes` against the baseline."""

    rows: DataFrame
    provenance: DataFrame
    changes: DataFrame | None


@dataclass(frozen=True)
class _Said:
    """What a field came to: its value, and the source that leads it."""

    value: Column
    source: Column
    reason: str


def reconcile(
    observations: DataFrame,
    resource: str,
    keys: Sequence[str],
    source: str,
    *,
    seen: Sequence[Column] = (),
    baseline: DataFrame | None = None,
    policies: Sequence[Policy] = POLICIES,
    primary: DataFrame | None = None,
    aliases: str | None = None,
    now: Column | None = None,
) -> Reconciled:
    """Merge the rows of `observations` that share `keys` under the policies of a resource.

    A column of `observations` or `baseline` is a path of the resource; one without a policy of its own
    falls under the most specific that covers it, else it is dropped.  Of several rows of a key and
    source the last by `seen` holds, then the greatest.

    How a field merges follows its policy and its type: *replace* takes the first claim in the order of
    sources whole; *fill_missing* takes each member of a struct from the first source that knows it;
    *set_union* lists the distinct elements of arrays in the order of sources; *deep* merges maps entry
    by entry, maps of maps leaf by leaf and structs member by member, the higher source first.  Under an
    *absent* policy zero values are no claims; under an *authoritative* one only null is none.

    With `baseline`, a key that no source observes stays as it was, and so does a field without a claim;
    absence retires nothing.  `primary` (its keys) restricts the result to keys that the primary source
    has, itself or under one of `aliases`, a column of arrays.  A new row takes its times from the
    sources (swapped if reversed, `now` where unknown), a changed one keeps when it was made and was
    changed `now`.

    Cases: rows with a null key or source don't count, nor do sources that a field's policy doesn't
    list; repeated rows change nothing; an empty table gives the baseline; other columns are dropped.
    """
    now = F.current_timestamp() if now is None else now
    shape = observations.schema
    own = {f.name: f.dataType for f in shape.fields if f.name not in (*keys, source)}
    covered = {c: p for c in own if (p := find_policy(policies, resource, c)) is not None}
    sources = list(dict.fromkeys(s for p in covered.values() for s in p.sources))
    place = {s: f"_s{i}" for i, s in enumerate(sources)}
    order = F.struct(*(c.alias(f"_at{i}") for i, c in enumerate(seen)), *(_orderable(c, own[c]).alias(f"o{i}") for i, c in enumerate(covered)))
    picked = observations.where(" and ".join(f"`{k}` is not null" for k in (*keys, source)))
    wide = picked.groupBy(*keys).agg(*(F.max_by(F.struct(*covered), F.when(F.col(source) == s, order)).alias(place[s]) for s in sources))
    if primary is not None:
        wide = _in_primary(wide, keys, primary, aliases, covered, place)
    before = None
    if baseline is not None:
        held = baseline.select(*keys, F.struct(*(F.col(c) for c in baseline.columns if c not in keys)).alias("_base"))
        wide = wide.join(held, list(keys), "full")
        before = {f.name: F.col(f"_base.`{f.name}`") for f in held.schema["_base"].dataType.fields}
    said = {c: _decide(p, c, own[c], place) for c, p in covered.items() if c not in (CREATED, UPDATED)}
    base = lambda c: before[c] if before and c in before else F.lit(None)
    decided = wide.select("*", *(s.value.alias(f"_v_{c}") for c, s in said.items()))
    merged = {c: F.coalesce(F.col(f"_v_{c}"), base(c)) for c in said}
    times = {}
    if CREATED in covered and UPDATED in covered:
        claim = {c: _decide(covered[c], c, own[c], place).value for c in (CREATED, UPDATED)}
        created = F.coalesce(claim[CREATED], now)
        fresh = F.col("_base").isNull() if before else F.lit(True)
        changed = reduce(lambda a, b: a | b, (~F.to_json(F.struct(v.alias("x"))).eqNullSafe(F.to_json(F.struct(base(c).alias("x")))) if _is_map(own[c]) else ~v.eqNullSafe(base(c)) for c, v in merged.items()))
        old_created, old_updated = F.coalesce(base(CREATED), created), F.coalesce(base(UPDATED), F.coalesce(claim[UPDATED], created))
        start, end = change_aware_times(F.when(fresh, created).otherwise(old_created), F.when(fresh, F.coalesce(claim[UPDATED], created)).otherwise(old_updated), changed, fresh, now)
        times = {CREATED: start, UPDATED: end}
    rows = decided.select(*keys, *(v.alias(c) for c, v in merged.items()), *(v.alias(c) for c, v in times.items()))
    told = F.array(*(_entry(covered[c], c, F.col(f"_v_{c}"), s) for c, s in said.items()))
    told = decided.select(*keys, F.explode(F.filter(told, lambda e: e["value"].isNotNull())).alias("_e"))
    provenance = told.select(*keys, "_e.field", "_e.source", "_e.value", "_e.authority", "_e.reason")
    changes = None
    if baseline is not None:
        both = [c for c in said if c in before]
        changes = field_changes(baseline.select(*keys, *both), rows.select(*keys, *both), list(keys), both)
    return Reconciled(rows, provenance, changes)


def _is_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_is_map(f.dataType) for f in kind.fields)


def _orderable(name: str, kind: T.DataType) -> Column:
    """A value that rows can be told apart by, for those that were seen at once."""
    return F.to_json(name) if _is_map(kind) else F.col(name)


def _in_primary(wide: DataFrame, keys: Sequence[str], primary: DataFrame, aliases: str | None, covered: Mapping[str, Policy], place: Mapping[str, str]) -> DataFrame:
    known = primary.select(*keys).distinct()
    if aliases is None or aliases not in covered:
        return wide.join(known, list(keys), "left_semi")
    # Only a single key can have aliases: the row stays if any of its names is one of the primary's.
    key = keys[0]
    names = F.array_distinct(F.concat(F.array(F.col(key)), *(F.coalesce(F.col(f"{p}.`{aliases}`"), F.array().cast("array<string>")) for p in place.values())))
    named = wide.select(key, F.explode(names).alias("_name")).join(known.select(F.col(key).alias("_name")), "_name", "left_semi").select(key).distinct()
    return wide.join(named, key, "left_semi")


def _simple(kind: T.DataType) -> str:
    return kind.simpleString()


def _claims(policy: Policy, value: Column, kind: T.DataType) -> Column:
    return value.isNotNull() if policy.empty == "authoritative" else ~is_zero(value, _simple(kind))


def _decide(policy: Policy, name: str, kind: T.DataType, place: Mapping[str, str]) -> _Said:
    """The value that a policy makes of a field's values by source, and the first source that claims any."""
    values = [(s, F.col(f"{place[s]}.`{name}`")) for s in policy.sources if s in place]
    claims = [(s, F.when(_claims(policy, v, kind), v)) for s, v in values]
    lead = F.coalesce(*(F.when(c.isNotNull(), F.lit(s)) for s, c in claims))
    only = [c for _, c in claims]
    if policy.merge == "set_union" and isinstance(kind, T.ArrayType):
        empty = F.array().cast(kind)
        every = F.array_distinct(F.filter(F.concat(*(F.coalesce(c, empty) for c in only)), lambda x: x.isNotNull()))
        return _Said(F.when(lead.isNotNull(), every), lead, "united in the order of sources")
    if policy.merge in ("fill_missing", "deep") and isinstance(kind, (T.StructType, T.MapType)):
        return _Said(_filled(only, kind), lead, "gaps filled by lower sources")
    return _Said(F.coalesce(*only), lead, "first claim in the order of sources")


def _filled(values: Sequence[Column], kind: T.DataType) -> Column:
    """Values from the highest source to the lowest, merged member by member, entry by entry, down to the leaves."""
    anyone = reduce(lambda a, b: a | b, (v.isNotNull() for v in values))
    if isinstance(kind, T.StructType):
        members = [_filled([v.getField(f.name) for v in values], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(anyone, F.struct(*members))
    if isinstance(kind, T.MapType):
        known = [F.map_filter(v, lambda _, x: x.isNotNull()) for v in values]
        empty = F.map_from_arrays(F.array().cast(T.ArrayType(kind.keyType)), F.array().cast(T.ArrayType(kind.valueType)))
        whole = reduce(lambda high, low: _under(high, low, kind), (F.coalesce(k, empty) for k in known))
        return F.when(anyone, whole)
    return F.coalesce(*values)


def _under(high: Column, low: Column, kind: T.MapType) -> Column:
    """Two maps as one: an entry of `high` stands, but where both hold maps or structs these are merged in turn."""
    if isinstance(kind.valueType, (T.MapType, T.StructType)):
        return F.map_zip_with(high, low, lambda _, a, b: _filled([a, b], kind.valueType))
    return F.map_zip_with(high, low, lambda _, a, b: F.coalesce(a, b))


def _entry(policy: Policy, name: str, value: Column, said: _Said) -> Column:
    score = F.create_map(*(x for s in policy.sources for x in (F.lit(s), F.lit(policy.authority(s)))))[said.source]
    text = F.when(value.isNotNull() & said.source.isNotNull(), F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$.v"))
    return F.struct(F.lit(name).alias("field"), said.source.alias("source"), text.alias("value"), score.alias("authority"), F.lit(said.reason).alias("reason"))
