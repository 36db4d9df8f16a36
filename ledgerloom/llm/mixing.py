"""Mixing sources to target weights.

Capped water-filling: a source that can't reach its share even at its greatest number of repetitions
is clamped there, and what it lacks is spread over the others in proportion to their weights, until
all fit.  Whole repetitions take every record, a fraction takes a seeded sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded_rows, bounded_side, durable
from .tokens import TOKENIZER, with_tokens

#: The driver holds a few numbers for each source; joins with them are broadcast only where they are proven small.
MOST_SOURCES = 1_000_000
#: Hash buckets of a source; only the bucket in which a sample ends is sorted.
BUCKETS = 65_536


def water_fill(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """The size each source contributes: `targets` has (share, greatest number of repetitions)."""
    caps = {s: available.get(s, 0) * max(0, most) for s, (_, most) in targets.items()}
    open_ = {s for s, (share, _) in targets.items() if share > 0 and caps[s] > 0}
    given = dict.fromkeys(targets, 0.0)
    left = float(total)
    while open_ and left > 0:
        weight = sum(targets[s][0] for s in open_)
        over = {s for s in open_ if left * targets[s][0] / weight >= caps[s]}
        if not over:
            for s in open_:
                given[s] = left * targets[s][0] / weight
            break
        for s in over:
            given[s] = float(caps[s])
            left -= caps[s]
        open_ -= over
    return given


def _sampled(sized: DataFrame, wanted: dict[str, float], seed: int) -> DataFrame:
    """Records (key, source) of a seeded sample of about the wanted size of each source."""
    spark = sized.sparkSession
    need = bounded_side(spark.createDataFrame(sorted(wanted.items()), "_s string, _need double"))
    hashed = sized.join(need, F.col("source") == F.col("_s")).withColumn("_h", F.xxhash64(F.lit(seed), "_key"))
    hashed = hashed.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    filled = hashed.groupBy("source", "_need", "_bucket").agg(F.sum("tokens").alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy("source").orderBy("_bucket"))
    filled = filled.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_t"))
    edge = filled.where("_before < _need and _upto >= _need").select(F.col("source").alias("_e"), F.col("_bucket").alias("_edge"), "_before")
    marked = hashed.join(bounded_side(edge), F.col("source") == F.col("_e"), "left")
    whole = marked.where("_edge is null or _bucket < _edge").select("_row")
    order = Window.partitionBy("source").orderBy("_h", "_key", "_row")
    part = marked.where("_bucket = _edge").withColumn("_to", F.col("_before") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The record at the end is in if that comes closer to the wanted size.
    return whole.unionAll(part.where("_to - tokens / 2 <= _need").select("_row"))


def mixed(sizes: DataFrame, targets: DataFrame, *, key: str = "doc_id", total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(records, report) of a mixture of about `total` tokens, by default the size of all listed sources.

    `sizes` has (key, source, tokens), `targets` (source, target_share, max_repeats).

    records: (key, source, tokens, copies), each record with the number of times it is used, at least
    1 and at most its source's `max_repeats`.  report: (source, target_share, max_repeats,
    available_tokens, wanted_tokens, used_tokens, actual_share, repeats) of each listed source.

    Cases: records with a null key, or of a null or unlisted source, are not used; a record without
    tokens is used as often as all of its source are at least; a listed source without records
    contributes nothing and its weight goes to the others; a null share or number of repetitions is 0;
    a source listed twice counts with its first target in order; repeated rows count
    once; where all sources are clamped the mixture is smaller than `total`; without records or targets
    nothing is used.  The sample depends on the seed and the keys only.
    """
    spark = sizes.sparkSession
    listed = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0)))).alias("t"))
    wished = {r["source"]: (float(r["t"][0]), int(r["t"][1])) for r in bounded_rows(listed, MOST_SOURCES)}
    used = sizes.select(F.col(key).alias("_key"), F.col("source"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).where("_key is not null")
    used = used.join(bounded_side(listed.select("source")), "source", "left_semi").select("_key", "source", "tokens")
    used = used.distinct()
    rows = used.withColumn("_row", F.struct("_key", "source", "tokens"))
    available = {r[0]: int(r[1]) for r in bounded_rows(used.groupBy("source").agg(F.sum("tokens")), MOST_SOURCES)}
    given = water_fill(available, wished, sum(available.values()) if total is None else total)
    rate = {s: given[s] / available[s] if available.get(s) else 0.0 for s in wished}
    whole = {s: min(int(r + 1e-9), wished[s][1]) for s, r in rate.items()}
    part = {s: (r - whole[s]) * available.get(s, 0) for s, r in rate.items() if r - whole[s] > 1e-9 and whole[s] < wished[s][1]}
    base = bounded_side(spark.createDataFrame([(s, whole[s]) for s in wished] or [("", 0)], "_b string, _whole int"))
    copies = rows.join(base, F.col("source") == F.col("_b")).select("_row", F.col("_whole").alias("_n")).where("_n > 0")
    if part:
        copies = copies.unionAll(_sampled(rows, part, seed).select("_row", F.lit(1).alias("_n")))
    records = copies.groupBy("_row").agg(F.sum("_n").cast("int").alias("copies"))
    records = records.select(F.col("_row._key").alias(key), F.col("_row.source").alias("source"), F.col("_row.tokens").alias("tokens"), "copies")
    sums = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    facts = [(s, wished[s][0], wished[s][1], available.get(s, 0), given[s], rate[s]) for s in sorted(wished)]
    table = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens double, repeats double")
    all_used = F.sum("used_tokens").over(Window.partitionBy())
    report = table.join(sums, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)).cast("bigint"))
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", "used_tokens", (F.col("used_tokens") / F.nullif(all_used, F.lit(0))).alias("actual_share"), "repeats")
    return records, report


def mix_documents(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, **options) -> tuple[DataFrame, DataFrame]:
    """mixed() of whole document texts, each tokenized once."""
    return mixed(durable(with_tokens(documents, keep=("source",), tokenizer=tokenizer)), targets, **options)
