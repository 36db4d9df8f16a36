"""What changed between full snapshots.

Content-defined chunks of key-sorted snapshots: each snapshot is sorted by key and cut where the
hash of a key says so, so that an insertion moves only the chunk it falls into.  Chunks whose
digests are equal in two consecutive snapshots are discarded; only rows of the others are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import slices_for
from ..functions.days import calendar_day


#: A list of snapshots, five numbers each, is broadcast up to this many.
PLAN_ROWS = 500_000


def snapshot_changes(
    rows: DataFrame,
    snapshots: DataFrame,
    *,
    feed: str = "feed_id",
    number: str = "snapshot_no",
    key: str = "id",
    received: str = "received_at",
    compared: dict[str, Column],
    chunk_rows: int = 16,
    slice_rows: int = 200_000,
) -> DataFrame:
    """Rows (feed, number, key, change_kind) of every snapshot against the one before it.

    `rows` holds the records, `snapshots` one or more rows (feed, number) for each snapshot that
    takes part; `compared` names the expressions whose difference counts as a change.

    Cases:
    - null in a compared expression is a value of its own;
    - of several rows of one snapshot and key the one received last holds (null is earliest); rows
      received at the same time are told apart by the compared values, greatest last;
    - rows with a null feed, number or key, and rows of snapshots that `snapshots` doesn't list,
      don't count; repeated rows count once;
    - the first snapshot of a feed gives no rows; a listed snapshot without rows is empty, so all
      of the one before it is removed; empty tables give no rows;
    - keys are compared exactly; other columns are never read, so their names don't matter.

    A feed is split by the hash of its keys into slices of about `slice_rows` rows, the same number for
    all of its snapshots, so no task has to sort a huge feed and a growing snapshot is still cut where
    the one before it was.  All snapshots of a slice meet in one exchange, behind which everything else
    happens in place: rows are sorted and cut, a chunk keeps its rows beside its digest, chunks whose
    digest the neighbouring snapshot holds as well are discarded for that pair, and the keys of the
    others are compared with their next and last occurrence.  Any cut gives the right result: a chunk is
    discarded only if both snapshots have a chunk of the same content, and a key occurs once in a snapshot.
    """
    listed = snapshots.select(F.col(feed).alias("_feed"), F.col(number).alias("_no")).dropna().distinct()
    order = Window.partitionBy("_feed").orderBy("_no")
    listed = listed.select(
        "_feed", "_no",
        F.lag("_no").over(order).alias("_before"),
        F.lead("_no").over(order).alias("_after"),
    )
    values = [f"_v{i}" for i in range(len(compared))]
    base = rows.select(
        F.col(feed).alias("_feed"), F.col(number).alias("_no"), F.col(key).alias("_key"),
        F.struct(F.col(received).alias("_at"), *(c.alias(v) for v, c in zip(values, compared.values()))).alias("_row"),
    ).where("_feed is not null and _no is not null and _key is not null")
    sizes = base.groupBy("_feed").agg(F.count(F.lit(1)).alias("_rows"))
    plan = listed.join(sizes, "_feed").select("_feed", "_no", "_before", "_after", slices_for(F.col("_rows"), slice_rows).alias("_slices"))
    # The plan has at most as many rows as `listed`; where that is proven small, the records needn't move to meet it.
    if listed.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS:
        plan = F.broadcast(plan)
    held = (
        base.join(plan, ["_feed", "_no"])
        .withColumn("_slice", F.pmod(F.xxhash64("_key"), F.col("_slices")).cast("int"))
        .repartition("_feed", "_slice")
        .groupBy("_feed", "_slice", "_no", "_key")
        .agg(F.max("_row").alias("_row"), F.first("_before").alias("_before"), F.first("_after").alias("_after"))
    )
    in_snapshot = Window.partitionBy("_feed", "_slice", "_no").orderBy("_key")
    cut = F.pmod(F.xxhash64(F.lit("cut"), "_key"), F.lit(chunk_rows)) == 0
    record = F.struct("_key", *(F.col(f"_row.{v}").alias(v) for v in values))
    chunks = (
        held.select("_feed", "_slice", "_no", "_before", "_after", record.alias("_record"), F.count(F.when(cut, True)).over(in_snapshot).alias("_chunk"))
        .groupBy("_feed", "_slice", "_no", "_chunk")
        .agg(F.first("_before").alias("_before"), F.first("_after").alias("_after"), F.sort_array(F.collect_list("_record")).alias("_records"))
    )
    # Nulls are hashed as such: xxhash64 skips null, so the values go with their null flags.
    flags = F.transform("_records", lambda r: F.array(*(r[v].isNull() for v in values)))
    digest = F.struct(F.xxhash64("_records", flags).alias("a"), F.xxhash64(F.lit("second"), flags, "_records").alias("b"), F.size("_records").alias("n"))
    same = Window.partitionBy("_feed", "_slice", "_digest").orderBy("_no")
    kept = (
        chunks.withColumn("_digest", digest)
        .select(
            "_feed", "_slice", "_no", "_before", "_after", "_records",
            (F.col("_before").isNotNull() & ~F.lag("_no").over(same).eqNullSafe(F.col("_before"))).alias("_newer"),
            (F.col("_after").isNotNull() & ~F.lead("_no").over(same).eqNullSafe(F.col("_after"))).alias("_older"),
        )
        .where("_newer or _older")
    )
    rest = kept.select("_feed", "_slice", "_no", "_before", "_after", "_newer", "_older", F.explode("_records").alias("_r")).select(
        "_feed", "_slice", "_no", "_before", "_after", "_newer", "_older", F.col("_r._key").alias("_key"), F.struct(*(F.col(f"_r.{v}") for v in values)).alias("_state")
    )
    times = Window.partitionBy("_feed", "_slice", "_key").orderBy("_no")
    rest = rest.select(
        "_feed", "_no", "_key", "_after",
        F.when(F.col("_newer") & ~F.lag("_no").over(times).eqNullSafe(F.col("_before")), "added")
        .when(F.col("_newer") & ~F.lag("_state").over(times).eqNullSafe(F.col("_state")), "changed").alias("_now"),
        (F.col("_older") & ~F.lead("_no").over(times).eqNullSafe(F.col("_after"))).alias("_gone"),
    ).where("_now is not null or _gone")
    both = F.array(F.struct(F.col("_no").alias("no"), F.col("_now").alias("kind")), F.struct(F.col("_after").alias("no"), F.when(F.col("_gone"), "removed").alias("kind")))
    found = rest.select("_feed", "_key", F.explode(both).alias("_c")).where("_c.kind is not null")
    return found.select(F.col("_feed").alias(feed), F.col("_c.no").alias(number), F.col("_key").alias(key), F.col("_c.kind").alias("change_kind"))


def listing_changes(rows: DataFrame, observations: DataFrame, **options) -> DataFrame:
    """Changes of `active` and of the calendar day in `shutdown_date` between complete snapshots.

    A snapshot takes part if its latest observation is `complete`.  A `shutdown_date` that is no
    readable day is compared as trimmed text; null and blank are no day.
    """
    latest = observations.groupBy("feed_id", "snapshot_no").agg(
        F.max(F.struct("observed_at", "completeness")).alias("_last")
    )
    text = F.nullif(F.trim("shutdown_date"), F.lit(""))
    return snapshot_changes(
        rows,
        latest.where("_last.completeness = 'complete'"),
        compared={"active": F.col("active"), "day": F.coalesce(calendar_day(text).cast("string"), text)},
        **options,
    )
