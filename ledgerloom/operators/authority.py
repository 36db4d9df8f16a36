"""Merging conflicting observations field by field under an explicit authority table.

The policies are plain data.  Whatever they say, a merge is one grouped aggregation: each field's
value is the one of least rank among those that count, so that each task reduces a key to one row
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import glob_regex

# Orders of sources, the most trusted first.
PROVIDER_FIRST = ("providers", "models_dev_http", "models_dev_git", "local_catalog", "release_artifact", "embedded_catalog")
UPSTREAM_FIRST = ("models_dev_http", "models_dev_git", "providers", "local_catalog", "release_artifact", "embedded_catalog")
LOCAL_FIRST = ("local_catalog", "providers", "models_dev_http", "models_dev_git", "release_artifact", "embedded_catalog")
LOCAL_THEN_UPSTREAM = ("local_catalog", "models_dev_http", "models_dev_git", "providers", "release_artifact", "embedded_catalog")


@dataclass(frozen=True)
class Policy:
    """Who decides a field. merge: replace, fill_missing, set_union or deep. empty: whether zero values are claims (authoritative) or none (absent)."""

    resource: str
    path: str
    sources: tuple[str, ...]
    merge: str = "replace"
    empty: str = "absent"

    def authority(self, source: str) -> float:
        """Share of the order that a source outranks or equals; 0 for one that isn't in it."""
        return (len(self.sources) - self.sources.index(source)) / len(self.sources) if source in self.sources else 0.0

    def rank(self, source: Column) -> Column:
        """Place of a source in the order from 0, the length of the order for others."""
        place = F.array_position(F.array(*map(F.lit, self.sources)), source)
        return F.when(place > 0, place - 1).otherwise(len(self.sources)).cast("int")

    def claims(self, value: Column, kind: str) -> Column:
        """Whether a value counts as a claim."""
        return value.isNotNull() if self.empty == "authoritative" else ~is_zero(value, kind)


def is_zero(value: Column, kind: str) -> Column:
    """Whether a value says nothing: null, blank, zero, false or empty."""
    if kind == "string":
        empty = F.trim(value) == ""
    elif kind.startswith(("array", "map")):
        empty = F.size(value) == 0
    elif kind == "boolean":
        empty = ~value
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        empty = value == 0
    else:
        empty = F.lit(False)
    return value.isNull() | F.coalesce(empty, F.lit(False))


def _policies(resource: str, text: str) -> list[Policy]:
    orders = {"providerFirst": PROVIDER_FIRST, "upstreamFirst": UPSTREAM_FIRST, "localFirst": LOCAL_FIRST, "localThenUpstream": LOCAL_THEN_UPSTREAM}
    lines = [line.split() for line in text.strip().splitlines()]
    return [Policy(resource, path, orders[order], merge, empty) for path, order, merge, empty in lines]


# Path, order of sources, how values merge, what an empty value means.
POLICIES = [
    *_policies("model", """
        model              providerFirst      replace       absent
        name               providerFirst      replace       absent
        description        upstreamFirst      replace       authoritative
        status             upstreamFirst      replace       absent
        deprecated_at      providerFirst      replace       absent
        retires_at         providerFirst      replace       absent
        authors            upstreamFirst      set_union     absent
        lineage.family     upstreamFirst      replace       absent
        lineage.root       providerFirst      replace       absent
        lineage.parent     providerFirst      replace       absent
        limits             providerFirst      fill_missing  absent
        metadata           upstreamFirst      fill_missing  absent
        features           providerFirst      deep          authoritative
        attachments        providerFirst      replace       absent
        generation         providerFirst      replace       absent
        reasoning          providerFirst      replace       absent
        reasoning_tokens   providerFirst      replace       absent
        verbosity          providerFirst      replace       absent
        tools              providerFirst      replace       absent
        delivery           providerFirst      replace       absent
        modes              providerFirst      deep          absent
        pricing            providerFirst      replace       absent
        extensions         localThenUpstream  deep          absent
        created_at         providerFirst      replace       absent
        updated_at         upstreamFirst      replace       absent
    """),
    *_policies("provider", """
        name               providerFirst      replace       absent
        description        localFirst         replace       absent
        docs_url           localFirst         replace       absent
        logo               localFirst         replace       absent
        headquarters       providerFirst      replace       absent
        icon_url           providerFirst      replace       absent
        status_page_url    providerFirst      replace       absent
        aliases            localThenUpstream  set_union     absent
        credentials        localFirst         replace       absent
        catalog            localFirst         replace       absent
        inference          localFirst         replace       absent
        privacy_policy     upstreamFirst      fill_missing  absent
        retention_policy   upstreamFirst      fill_missing  absent
        governance_policy  upstreamFirst      fill_missing  absent
        models             providerFirst      replace       absent
        extensions         localThenUpstream  deep          absent
    """),
    *_policies("author", """
        name               upstreamFirst      replace       absent
        aliases            localThenUpstream  set_union     absent
        description        upstreamFirst      replace       absent
        headquarters       upstreamFirst      replace       absent
        icon_url           upstreamFirst      replace       absent
        logo               localFirst         replace       absent
        website            upstreamFirst      replace       absent
        hugging_face       upstreamFirst      replace       absent
        github             upstreamFirst      replace       absent
        twitter            upstreamFirst      replace       absent
        catalog            localFirst         replace       absent
    """),
]


def find_policy(policies: Sequence[Policy], resource: str, path: str) -> Policy | None:
    """The most specific policy for a path: exact, a prefix that ends in ``*``, or a glob; the longest pattern wins."""
    import re

    fits = [
        p for p in policies
        if p.resource == resource and (p.path == path or p.path.endswith("*") and path.startswith(p.path[:-1]) or re.match(glob_regex(p.path), path) or path.startswith(f"{p.path}."))
    ]
    return max(fits, key=lambda p: len(p.path), default=None)


def one_per_source(observations: DataFrame, keys: Sequence[str], source: str, seen: Column | None = None) -> DataFrame:
    """The latest row of each key and source; of rows seen at once the greatest."""
    rest = [c for c in observations.columns if c not in (*keys, source)]
    row = F.struct(*([seen.alias("_seen")] if seen is not None else []), *(F.col(c) for c in rest))
    best = observations.groupBy(*keys, source).agg(F.max(row).alias("_row"))
    return best.select(*keys, source, *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def resolve_fields(observations: DataFrame, keys: Sequence[str], source: str, policies: Mapping[str, Policy], *, evidence: bool = False) -> DataFrame:
    """One row for each key with the value of each field in `policies` from the source that decides it.

    The first claim in the order of sources wins; without any, the first non-null value by source
    name.  With `evidence`, each field is a struct (value, source, authority).
    """
    kinds = dict(observations.dtypes)
    columns = []
    for name, policy in policies.items():
        value = F.col(name)
        claim = policy.claims(value, kinds[name]) & F.array_contains(F.array(*map(F.lit, policy.sources)), F.col(source))
        order = F.struct((~claim).alias("a"), policy.rank(F.col(source)).alias("r"), F.col(source).alias("s"))
        order = F.when(value.isNotNull(), F.when(claim, order).otherwise(F.struct(F.lit(True).alias("a"), F.lit(len(policy.sources)).alias("r"), F.col(source).alias("s"))))
        columns.append(F.min_by(F.struct(value.alias("value"), F.col(source).alias("source")), order).alias(name))
    merged = observations.groupBy(*keys).agg(*columns)
    if not evidence:
        return merged.select(*keys, *(F.col(f"{n}.value").alias(n) for n in policies))
    score = lambda n, p: F.coalesce(F.create_map(*(x for s in p.sources for x in (F.lit(s), F.lit(p.authority(s)))))[F.col(f"{n}.source")], F.lit(0.0))
    return merged.select(*keys, *(F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.value"), F.col(f"{n}.source"), score(n, p).alias("authority"))).alias(n) for n, p in policies.items()))


def whole_value(observations: DataFrame, keys: Sequence[str], source: str, policy: Policy, value: str, valid: Column) -> DataFrame:
    """(keys, value, source, rejected): the first valid value taken whole; sources ahead of it with an invalid one are listed."""
    rank = policy.rank(F.col(source))
    kept = observations.where(F.col(value).isNotNull()).withColumn("_r", rank).withColumn("_ok", F.coalesce(valid, F.lit(False)))
    order = F.struct("_r", source)
    grouped = kept.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value).alias("value"), F.col(source).alias("source"), F.col("_r").alias("rank")), F.when(F.col("_ok"), order)).alias("_best"),
        F.sort_array(F.collect_set(F.when(~F.col("_ok"), order))).alias("_bad"),  # at most one entry a source
    )
    ahead = F.filter("_bad", lambda b: F.col("_best").isNull() | (b["_r"] < F.col("_best.rank")))
    return grouped.select(*keys, F.col("_best.value").alias(value), F.col("_best.source").alias("source"), F.transform(ahead, lambda b: b[source]).alias("rejected"))


def unioned(observations: DataFrame, keys: Sequence[str], source: str, policy: Policy, value: str) -> DataFrame:
    """(keys, value): the distinct elements of an array field, ordered by the rank of their source, then by place.

    Each element is reduced to its first place before the lists are built, so a list is as long as the
    result.
    """
    long = observations.select(*keys, policy.rank(F.col(source)).alias("_r"), F.col(source).alias("_s"), F.posexplode(value).alias("_p", "_e"))
    first = long.where("_e is not null and _e <> ''").groupBy(*keys, "_e").agg(F.min(F.struct("_r", "_s", "_p")).alias("_at"))
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_e"))).alias("_all"))
    return lists.select(*keys, F.transform("_all", lambda x: x["_e"]).alias(value))


def merged_maps(observations: DataFrame, keys: Sequence[str], source: str, policy: Policy, value: str) -> DataFrame:
    """(keys, value): a map field merged key by key; a higher rank protects its entries, lower ranks fill the gaps."""
    long = observations.select(*keys, policy.rank(F.col(source)).alias("_r"), F.col(source).alias("_s"), F.explode(value).alias("_k", "_v"))
    best = long.where("_v is not null").groupBy(*keys, "_k").agg(F.min_by("_v", F.struct("_r", "_s")).alias("_v"))
    return best.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(value))


def provenance(observations: DataFrame, keys: Sequence[str], source: str, policies: Mapping[str, Policy]) -> DataFrame:
    """(keys, field, source, value, authority): every claim, as text, in long form."""
    kinds = dict(observations.dtypes)
    entries = []
    for name, policy in policies.items():
        score = F.coalesce(F.create_map(*(x for s in policy.sources for x in (F.lit(s), F.lit(policy.authority(s)))))[F.col(source)], F.lit(0.0))
        text = F.col(name).cast("string") if not kinds[name].startswith(("struct", "array", "map")) else F.to_json(name)
        entries.append(F.struct(F.lit(name).alias("field"), F.when(policy.claims(F.col(name), kinds[name]), text).alias("value"), score.alias("authority")))
    long = observations.select(*keys, source, F.explode(F.array(*entries)).alias("_e"))
    return long.select(*keys, source, "_e.field", "_e.value", "_e.authority").where("value is not null")


def overlaid(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Two-way merge: the right side's values win where they say something, else the left side's hold."""
    kinds = dict(right.dtypes)
    renamed = right.select(*keys, *(F.col(f).alias(f"_r_{f}") for f in fields))
    wins = lambda f: F.when(~is_zero(F.col(f"_r_{f}"), kinds[f]), F.col(f"_r_{f}")).otherwise(F.col(f)).alias(f)
    return left.select(*keys, *fields).join(renamed, list(keys), "full").select(*keys, *(wins(f) for f in fields))


def change_aware_times(created: Column, updated: Column, changed: Column, fresh: Column, now: Column) -> tuple[Column, Column]:
    """(created, updated) of a merged row: those of the source if it is new (swapped if reversed), now for changed ones, else as they were."""
    return F.when(fresh, F.least(created, updated)).otherwise(created), F.when(fresh, F.greatest(created, updated)).when(changed, now).otherwise(updated)


def filled_struct(observations: DataFrame, keys: Sequence[str], source: str, policy: Policy, value: str, *, lists: Sequence[str] = ()) -> DataFrame:
    """(keys, value): a struct field merged member by member, lower ranks filling what higher ones leave open.

    Members named in `lists` are ordered unions instead.
    """
    members = observations.schema[value].dataType.fieldNames()
    flat = observations.select(*keys, source, *(F.col(f"{value}.`{m}`").alias(m) for m in members))
    own = {m: Policy(policy.resource, f"{policy.path}.{m}", policy.sources, "replace", policy.empty) for m in members if m not in lists}
    merged = resolve_fields(flat, keys, source, own)
    for m in lists:
        merged = merged.join(unioned(flat, keys, source, policy, m), list(keys), "left")
    return merged.select(*keys, F.struct(*members).alias(value))


def flags_merged(observations: DataFrame, keys: Sequence[str], source: str, policy: Policy, flags: str) -> DataFrame:
    """(keys, flags): a map of flags merged flag by flag; a known false of a higher rank outranks a true below it."""
    return merged_maps(observations, keys, source, policy, flags)


def without_blank_projections(observations: DataFrame, source: str, local: str, flags: str, had_before: Column) -> DataFrame:
    """Observations in which a local block of flags that are all false, where there was none before, makes no claim."""
    any_true = F.exists(F.map_values(flags), lambda v: F.coalesce(v, F.lit(False)))
    blank = (F.col(source) == local) & ~F.coalesce(any_true, F.lit(False)) & ~F.coalesce(had_before, F.lit(False))
    return observations.withColumn(flags, F.when(~blank, F.col(flags)))


def without_stale(observations: DataFrame, value: str, stale: Column, known_before: Column) -> DataFrame:
    """Observations in which a stale fallback makes no claim where the baseline knows the value."""
    return observations.withColumn(value, F.when(~(F.coalesce(stale, F.lit(False)) & F.coalesce(known_before, F.lit(False))), F.col(value)))


def reattributed(observations: DataFrame, keys: Sequence[str], source: str, value: str, local: str, evidence: DataFrame) -> DataFrame:
    """Observations in which an unedited local value counts for the source that supplied it.

    `evidence` has (keys, source, value) of the latest evidence of each key; where it states the same
    value as the local row, that row takes its source.
    """
    told = evidence.select(*keys, F.col(source).alias("_by"), F.col(value).alias("_said"))
    joined = observations.join(told, list(keys), "left")
    own = (F.col(source) == local) & F.col("_by").isNotNull() & F.col(value).eqNullSafe(F.col("_said"))
    return joined.withColumn(source, F.when(own, F.col("_by")).otherwise(F.col(source))).drop("_by", "_said")
