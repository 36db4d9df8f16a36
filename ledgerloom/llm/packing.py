"""Filling fixed-capacity containers with items, never splitting an item unless it exceeds the capacity.

Bulk-synchronous best fit.  Items and gaps are range-sorted by size; in each step the largest class
of items is matched at once to its successors among the gaps, conflicts within the class are
resolved by the items' ranks, the gaps are updated, and the next class follows.  Sizes are whole
numbers up to the capacity and items of one size are interchangeable, so the sweep runs over run
lengths: (size, number of items) and (gap, range of containers).  Its work is bounded by the
number of different sizes, whatever the number of items.  The items themselves are ranked and placed where they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded_rows, durable
from .tokens import TOKENIZER, with_tokens

#: The driver holds a run length for each different size of a piece in a pack; capacities themselves have no bound.
MOST_SIZES = 1 << 21


class Plan:
    """Where the items of each size go: item `rank` of a size lies in a run of (first rank, first container, items per container)."""

    def __init__(self, sizes: dict[int, int], capacity: int):
        self.capacity = capacity
        self.containers = 0
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        gaps: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def leave(gap: int, low: int, high: int) -> None:
            if gap and high > low:
                if gap not in gaps:
                    gaps[gap] = []
                    insort(order, gap)
                gaps[gap].append((low, high))

        for size in sorted(sizes, reverse=True):
            runs: list[tuple[int, int, int]] = []
            rank, left = 0, sizes[size]
            while left:
                place = bisect_left(order, size)
                if place == len(order):
                    gap, low, high = capacity, self.containers, self.containers + -(-left // (capacity // size))
                    self.containers = high
                else:
                    gap = order[place]
                    low, high = gaps[gap].pop()
                each = gap // size
                full = min(high - low, left // each)
                if full:
                    runs.append((rank, low, each))
                    rank, left = rank + full * each, left - full * each
                    leave(gap - each * size, low, low + full)
                low += full
                if left and low < high:  # fewer items than a container takes
                    runs.append((rank, low, each))
                    leave(gap - left * size, low, low + 1)
                    rank, left, low = rank + left, 0, low + 1
                if low < high:
                    gaps[gap].append((low, high)) if gap in gaps else leave(gap, low, high)
                if gap in gaps and not gaps[gap]:
                    del gaps[gap]
                    order.pop(bisect_left(order, gap))
            self.runs[size] = tuple(np.array(c, dtype=np.int64) for c in zip(*runs))

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        result = np.zeros(len(sizes), dtype=np.int64)  # what has no size lies in the first container
        for size in np.unique(sizes):
            if size > 0:
                rows = np.flatnonzero(sizes == size)
                first, container, each = self.runs[int(size)]
                run = np.searchsorted(first, ranks[rows], side="right") - 1
                result[rows] = container[run] + (ranks[rows] - first[run]) // each[run]
        return result


def packed(sizes: DataFrame, packs: DataFrame, *, key: str = "doc_id", slice_rows: int = 2_000_000) -> DataFrame:
    """(pack_name, container_id, key, piece_no, from_token, tokens) of every item in every pack.

    `sizes` has (key, tokens), `packs` (pack_name, capacity_tokens).  An item above the capacity is
    cut into pieces of exactly the capacity and a rest; every other item is one piece.  The pieces of
    a container never exceed the capacity.

    Cases: an item without tokens, or with null for them, takes no space and lies in container 0; a
    repeated key is a further item; rows with a null key don't count; packs with a null name or a
    capacity below 1 are ignored, a name listed twice counts with its largest capacity; without items
    or packs there are no rows; other columns are never read.

    Items are ranked within their size in hash slices of about `slice_rows` rows, so that a size that
    most items have is no single task; the offsets of the slices come from their counts.
    """
    spark = sizes.sparkSession
    valid = packs.where("pack_name is not null and capacity_tokens >= 1").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    capacities = {r[0]: int(r[1]) for r in bounded_rows(valid, MOST_SIZES)}
    items = sizes.select(F.col(key).alias("_key"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("_tokens")).where("_key is not null")
    kind = dict(items.dtypes)["_key"]
    schema = f"pack_name string, container_id bigint, `{key}` {kind}, piece_no int, from_token bigint, tokens bigint"
    if not capacities:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities.items())))
    wide = items.select("_key", "_tokens", each.alias("_p")).select("_key", "_tokens", "_p.pack", "_p.capacity")
    last = F.greatest(F.ceil(F.col("_tokens") / F.col("capacity")).cast("int") - 1, F.lit(0))
    pieces = wide.select("pack", "capacity", "_key", "_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    pieces = pieces.select("pack", "_key", "piece", start.alias("start"), F.least(F.col("_tokens") - start, F.col("capacity")).alias("size"))
    total = pieces.count()
    slices = max(1, -(-total // slice_rows))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("_key", "piece"), F.lit(slices)).cast("int"))
    counts = pieces.groupBy("pack", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    plans = {}
    histogram = bounded_rows(counts.groupBy("pack", "size").agg(F.sum("n").alias("n")), MOST_SIZES)
    for name, capacity in capacities.items():
        plans[name] = Plan({r["size"]: r["n"] for r in histogram if r["pack"] == name and r["size"] > 0}, capacity)
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("pack", "size", "slice").orderBy("_key", "piece")) - 1)
    if slices > 1:
        before = F.sum("n").over(Window.partitionBy("pack", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select("pack", "size", "slice", F.coalesce(before, F.lit(0)).alias("offset"))
        ranked = ranked.join(offsets, ["pack", "size", "slice"]).withColumn("rank", F.col("rank") + F.col("offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs_, keys, piece, begin, size, rank = batch.columns
            names = np.array(packs_.to_pylist(), dtype=object)
            size_, rank_ = size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.zeros(len(names), dtype=np.int64)
            for name in set(names):
                rows = names == name
                found[rows] = plans[name].place(size_[rows], rank_[rows])
            yield pa.RecordBatch.from_arrays([packs_, pa.array(found), keys, piece, begin, size], ["pack_name", "container_id", key, "piece_no", "from_token", "tokens"])

    return ranked.select("pack", "_key", "piece", "start", "size", "rank").mapInArrow(place, schema)


def pack_documents(documents: DataFrame, packs: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """packed() of whole document texts, each tokenized once."""
    return packed(durable(with_tokens(documents, tokenizer=tokenizer)), packs)


def fill_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, items, tokens, fill): the share of all space that is used."""
    used = placed.groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    by_pack = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"))
    sized = packs.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return by_pack.join(sized, "pack_name").select("pack_name", "capacity_tokens", "containers", "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
