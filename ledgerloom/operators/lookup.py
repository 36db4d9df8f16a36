"""Lookups by id and alias, references between relations, and glob attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded_side
from .filters import glob_regex


def alias_rows(df: DataFrame, identity: str, aliases: Column | None = None, *, fold_case: bool = False) -> DataFrame:
    """(alias, target, direct): each id under itself and under its aliases; null and empty ones left out."""
    own = df.select(F.col(identity).alias("alias"), F.col(identity).alias("target"), F.lit(True).alias("direct"))
    if aliases is not None:
        own = own.unionAll(df.select(F.explode(aliases).alias("alias"), F.col(identity).alias("target"), F.lit(False).alias("direct")))
    key = F.lower(F.trim("alias")) if fold_case else F.col("alias")
    return own.select(key.alias("alias"), "target", "direct").where("alias is not null and alias <> '' and target is not null")


def alias_table(rows: DataFrame) -> DataFrame:
    """(alias, target, candidates): the target an alias names; an id outranks aliases, several targets are ambiguous and null."""
    best = rows.groupBy("alias").agg(
        F.min(F.when(F.col("direct"), F.col("target"))).alias("_own"), F.min("target").alias("_low"), F.max("target").alias("_high"), F.count_distinct("target").alias("candidates")
    )
    target = F.coalesce("_own", F.when(F.col("_low") == F.col("_high"), F.col("_low")))
    return best.select("alias", target.alias("target"), F.col("candidates").cast("bigint").alias("candidates"))


def resolve(df: DataFrame, key: str, table: DataFrame, result: str = "target") -> DataFrame:
    """`df` with the target its key names and `found`: exact, ambiguous or missing."""
    named = table.select(F.col("alias").alias("_alias"), F.col("target").alias(result), F.col("candidates").alias("_n"))
    state = F.when(F.col(result).isNotNull(), "found").when(F.col("_n").isNotNull(), "ambiguous").otherwise("missing")
    return df.join(bounded_side(named), F.col(key) == F.col("_alias"), "left").withColumn("found", state).drop("_alias", "_n")


def alias_conflicts(rows: DataFrame) -> DataFrame:
    """(alias, targets) of ids and aliases that name more than one target, whatever their case."""
    folded = rows.select(F.lower(F.trim("alias")).alias("alias"), "target")
    several = folded.groupBy("alias").agg(F.min("target").alias("_low"), F.max("target").alias("_high")).where("_low <> _high")
    targets = folded.join(several.select("alias"), "alias", "left_semi").distinct().groupBy("alias").agg(F.sort_array(F.collect_list("target")).alias("targets"))
    return targets


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def split_by_reference(df: DataFrame, key: str, targets: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is a target, rows whose key is none); a null key is none."""
    known = targets.select(F.col(target).alias("_target")).where("_target is not null").distinct()
    on = F.col(key) == F.col("_target")
    return df.join(known, on, "left_semi"), df.join(known, on, "left_anti")


def carried_reference(df: DataFrame, keys: Sequence[str], key: str, targets: DataFrame, target: str, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a valid reference, candidates for review).

    A row's own reference holds if it is a target, else that of the same row in `baseline`; a row
    without either is a candidate with its reason.
    """
    known = targets.select(F.col(target).alias("_target")).where("_target is not null").distinct()
    before = baseline.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col(key).alias("_before"))
    valid = before.join(known, F.col("_before") == F.col("_target"), "left_semi").dropDuplicates([f"_b_{k}" for k in keys])
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_b_{k}")) if same is None else same & (F.col(k) == F.col(f"_b_{k}"))
    joined = df.join(known, F.col(key) == F.col("_target"), "left").join(valid, same, "left")
    final = F.coalesce("_target", "_before")
    columns = [final.alias(c) if c == key else F.col(c) for c in df.columns]
    kept = joined.where(final.isNotNull()).select(*columns)
    reason = F.when(F.col(key).isNull(), "no reference").otherwise("unknown reference")
    return kept, joined.where(final.isNull()).select(*df.columns, reason.alias("reason"))


def enriched_by_primary(rows: DataFrame, primary: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of other sources whose key the primary has, the first of each key by `order`."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(primary.select(*keys).distinct(), list(keys), "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def missing_from(baseline: DataFrame, observed: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """(by, missing, known, degraded): for each group, how many baseline keys an observation lacks."""
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    joined = baseline.select(*keys).distinct().join(seen, list(keys), "left")
    lost = F.count(F.when(F.col("_seen").isNull(), 1))
    return joined.groupBy(by).agg(lost.alias("missing"), F.count(F.lit(1)).alias("known"), (lost > 0).alias("degraded"))


def routed(targets: DataFrame, offers: DataFrame, keys: Sequence[str], eligible: Column) -> DataFrame:
    """`targets`, an ordered list, with a `reason` for each that can't be used: missing or unavailable; null means usable."""
    offered = offers.select(*keys, eligible.alias("_ok")).groupBy(*keys).agg(F.bool_or("_ok").alias("_ok"))
    reason = F.when(F.col("_ok").isNull(), "missing").when(~F.col("_ok"), "unavailable")
    return targets.join(offered, list(keys), "left").withColumn("reason", reason).drop("_ok")


#: Globs up to this many become one CASE of anchored expressions.
CASES = 100


def attributed(df: DataFrame, text: str, patterns: DataFrame, *, cases: int = CASES) -> DataFrame:
    """`df` with `owner`: of the (pattern, owner) rows that fit, an exact one, else one that differs in case, else the longest glob, then by name.

    A few globs become one CASE, so nothing is joined.  More of them are joined to the distinct values
    by what they hold before their first wildcard, or behind their last where they start with one; so a
    value meets only globs whose literal end it has.  Those with a wildcard at either end remain for the CASE.
    """
    rows = patterns.select("pattern", "owner").where("pattern is not null and owner is not null").distinct()
    wild = F.col("pattern").rlike(r"[*?]")
    value = F.col(text)
    exact = rows.where(~wild).groupBy(F.col("pattern").alias("_pattern")).agg(F.min("owner").alias("_exact"))
    low = rows.where(~wild).groupBy(F.lower("pattern").alias("_folded")).agg(F.min_by("owner", F.struct("pattern", "owner")).alias("_same"))
    found = df.join(bounded_side(exact), value == F.col("_pattern"), "left").drop("_pattern")
    found = found.join(bounded_side(low), F.lower(value) == F.col("_folded"), "left").drop("_folded")
    globs = rows.where(wild).select(F.lower("pattern").alias("_p"), "pattern", "owner")
    few = globs.limit(cases + 1).count() <= cases
    loose = globs if few else globs.where(F.col("_p").rlike(r"^[*?]") & F.col("_p").rlike(r"[*?]$"))
    choice = None
    for r in sorted(loose.collect(), key=lambda r: (-len(r.pattern), r.pattern, r.owner)):
        said = F.struct(F.lit(-len(r.pattern)).alias("n"), F.lit(r.pattern).alias("p"), F.lit(r.owner).alias("o"))
        fits = F.lower(value).rlike(glob_regex(r._p))
        choice = F.when(fits, said) if choice is None else choice.when(fits, said)
    found = found.withColumn("_choice", F.lit(None).cast("struct<n:int,p:string,o:string>") if choice is None else choice)
    if not few:
        found = found.join(_fitting(df.select(F.lower(value).alias("_v")).where("_v is not null").distinct(), globs), F.lower(value) == F.col("_v"), "left").drop("_v")
        found = found.withColumn("_choice", F.least("_choice", "_best"))
    return found.select(*df.columns, F.coalesce("_exact", "_same", "_choice.o").alias("owner"))


def _fitting(values: DataFrame, globs: DataFrame) -> DataFrame:
    """(_v, _best): the best of the globs with a literal start or end that fit each value, as struct(n, p, o)."""
    one = F.regexp_replace("_p", r"([^*?\p{L}\p{N}_])", r"\\$1")
    one = F.regexp_replace(F.regexp_replace(one, r"\*", "[^/]*"), r"\?", "[^/]")
    head, tail = F.regexp_extract("_p", r"^[^*?]*", 0), F.regexp_extract("_p", r"[^*?]*$", 0)
    order = F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("p"), F.col("owner").alias("o"))
    keyed = globs.select((head != "").alias("_start"), F.when(head != "", head).otherwise(tail).alias("_lit"), F.concat(F.lit("^"), one, F.lit("$")).alias("_re"), order.alias("_o")).where("_lit <> ''")
    sizes = keyed.select("_start", F.length("_lit").alias("_n")).distinct()  # at most two for each length of a pattern
    asked = values.join(F.broadcast(sizes), F.length("_v") >= F.col("_n")).select("_v", "_start", F.when(F.col("_start"), F.expr("left(_v, _n)")).otherwise(F.expr("right(_v, _n)")).alias("_lit"))
    met = asked.join(keyed, ["_start", "_lit"]).where(F.rlike("_v", F.col("_re")))
    return met.groupBy("_v").agg(F.min("_o").alias("_best"))


def attributed_owners(df: DataFrame, provider: str, model: str, patterns: DataFrame) -> DataFrame:
    """`df` with `owners`: the sorted distinct owners whose patterns fit the model, whatever the case.

    `patterns` has (owner, provider, pattern).  An entry with a provider counts for its models only, one
    without for all; a null pattern takes every model of the provider.  Entries are joined to the
    distinct models by the literal start of their pattern, as in attributed().
    """
    asked = df.select(F.col(provider).alias("_p"), F.lower(model).alias("_v")).where("_v is not null").distinct()
    rules = patterns.select("owner", F.nullif(F.col("provider"), F.lit("")).alias("_of"), F.lower("pattern").alias("_glob")).where("owner is not null and (_of is not null or _glob is not null)").distinct()
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace("_glob", r"([^*?\p{L}\p{N}_])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]")
    rules = rules.select("owner", "_of", F.coalesce(F.regexp_extract("_glob", r"^[^*?]*", 0), F.lit("")).alias("_lit"), F.coalesce(F.concat(F.lit("^"), one, F.lit("$")), F.lit("")).alias("_re"))
    sizes = rules.select(F.length("_lit").alias("_n")).distinct()  # at most one for each length of a pattern
    starts = asked.join(F.broadcast(sizes), F.length("_v") >= F.col("_n")).select("_p", "_v", F.expr("left(_v, _n)").alias("_lit"))
    met = starts.join(bounded_side(rules), "_lit").where((F.col("_of").isNull() | (F.col("_of") == F.col("_p"))) & F.rlike("_v", F.col("_re")))
    found = met.select("_p", "_v", "owner").distinct().groupBy("_p", "_v").agg(F.sort_array(F.collect_list("owner")).alias("owners"))
    joined = df.join(found, F.col(provider).eqNullSafe(F.col("_p")) & (F.lower(model) == F.col("_v")), "left")
    return joined.select(*df.columns, F.coalesce("owners", F.array().cast("array<string>")).alias("owners"))


def unique_owner(df: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, candidates): the owner of a key that has just one, else null with the sorted candidates."""
    pairs = df.select(key, owner).dropna().distinct()
    sides = pairs.groupBy(key).agg(F.min(owner).alias("_low"), F.max(owner).alias("_high"), F.sort_array(F.collect_list(owner)).alias("candidates"))
    return sides.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(owner), "candidates")


def linked_to_self(df: DataFrame, identity: str, link: str, table: DataFrame) -> DataFrame:
    """`df` with `link` resolved through aliases; a link to the row itself becomes null; `link_state` tells what it was."""
    named = resolve(df.withColumn("_link", F.col(link)), "_link", table, "_resolved")
    state = F.when(F.col("_link").isNull(), "none").when(F.col("_resolved") == F.col(identity), "self").otherwise(F.col("found"))
    return named.withColumn("link_state", state).withColumn(link, F.when(F.col("_resolved") != F.col(identity), F.col("_resolved"))).drop("_link", "_resolved", "found")
