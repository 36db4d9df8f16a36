"""The stream of published generations: newest only, never backwards, each identity one content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..common import bounded_side

DECISIONS = ("activated", "duplicate", "stale", "conflict")
_STATE = "generation_id string, digest string, generated_at timestamp"


def decided(publications: DataFrame, stream: str = "stream", sequence: str = "sequence", *, block_rows: int = 500_000) -> DataFrame:
    """`publications` (stream, sequence, generation_id, digest, generated_at) with the `decision` on each, for a bounded relation.

    In order of the sequence: a generation newer than all before it is activated; the active one again
    is a duplicate, or a conflict with another digest; an older one is stale; an equally old one with
    another digest is a conflict.  Rows that were turned down never lie ahead of the active one, so the
    running maximum of the times is the active generation's.

    Where a stream has more than `block_rows` rows, streams are cut by their sequence numbers into blocks of
    about so many.  The running maximum then goes over the blocks' maxima first and then inside each
    block, so that no stream is one task.
    """
    row = F.struct(F.col("generated_at").alias("at"), (-F.col(sequence)).alias("s"), F.col("generation_id").alias("id"), F.col("digest").alias("d"))
    sizes = publications.groupBy(F.col(stream).alias("_stream")).agg(F.min(sequence).alias("_low"), F.max(sequence).alias("_high"), F.count(F.lit(1)).alias("_rows"))
    if sizes.where(F.col("_rows") > block_rows).isEmpty():
        whole = Window.partitionBy(stream).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
        return _told(publications.withColumn("_active", F.max(row).over(whole)))
    blocks = F.ceil(F.col("_rows") / F.lit(float(block_rows)))
    block = F.floor((F.col(sequence) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * blocks).cast("int")
    cut = publications.join(bounded_side(sizes), F.col(stream).eqNullSafe(F.col("_stream"))).withColumn("_block", block).drop("_stream", "_low", "_high", "_rows")
    so_far = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(stream, "_block").agg(F.max(row).alias("_top")).select(F.col(stream).alias("_s"), F.col("_block").alias("_b"), F.max("_top").over(so_far).alias("_ahead"))
    cut = cut.join(bounded_side(tops), F.col(stream).eqNullSafe(F.col("_s")) & F.col("_block").eqNullSafe(F.col("_b"))).drop("_s", "_b")
    before = Window.partitionBy(stream, "_block").orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return _told(cut.withColumn("_active", F.greatest(F.max(row).over(before), "_ahead"))).drop("_ahead", "_block")


def _told(publications: DataFrame) -> DataFrame:
    """The decision on each publication by the `_active` one before it."""
    a = F.col("_active")
    decision = (
        F.when(a.isNull(), "activated")
        .when(F.col("generation_id") == a["id"], F.when(F.col("digest") == a["d"], "duplicate").otherwise("conflict"))
        .when(F.col("generated_at") < a["at"], "stale")
        .when(F.col("generated_at") == a["at"], F.when(F.col("digest") == a["d"], "duplicate").otherwise("conflict"))
        .otherwise("activated")
    )
    return publications.withColumn("decision", decision).drop("_active")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The decisions on the new rows of a stream, all at once: the newest time so far is a running maximum that starts from the state."""
    rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
    if state.exists:
        ids, digests, times = ([v] for v in state.get)
    else:
        ids, digests, times = [], [], []
    ids, digests = np.array([*ids, *rows.generation_id], dtype=object), np.array([*digests, *rows.digest], dtype=object)
    times = pd.to_datetime([*times, *rows.generated_at]).to_numpy().astype("datetime64[ns]").astype(np.int64)
    highest = np.maximum.accumulate(times)
    newer = np.append(True, times[1:] > highest[:-1])  # the first of those equally new stays active
    active = np.maximum.accumulate(np.where(newer, np.arange(len(times)), 0))
    mine = np.arange(1 if state.exists else 0, len(times))
    before = np.maximum(active[mine - 1], 0)
    same = digests[mine] == digests[before]
    met = (ids[mine] == ids[before]) | (times[mine] == times[before])
    said = np.where(met, np.where(same, "duplicate", "conflict"), np.where(times[mine] < times[before], "stale", "activated"))
    if not state.exists and len(said):
        said[0] = "activated"
    last = active[-1]
    state.update((ids[last], digests[last], pd.Timestamp(times[last]).to_pydatetime()))
    yield pd.DataFrame({"stream": key[0], "sequence": rows.sequence.to_numpy(), "generation_id": rows.generation_id.to_numpy(), "decision": said.astype(object)})


def decisions(publications: DataFrame) -> DataFrame:
    """The same for a stream: the active generation of each stream of publications is kept as state, so replays and restarts change nothing."""
    schema = "stream string, sequence bigint, generation_id string, decision string"
    return publications.groupBy("stream").applyInPandasWithState(_advance, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def newest(publications: DataFrame) -> DataFrame:
    """Of a micro-batch, the last publication of each stream."""
    rest = [c for c in publications.columns if c != "stream"]
    return publications.groupBy("stream").agg(F.max_by(F.struct(*rest), F.col("sequence")).alias("_p")).select("stream", "_p.*")


def subscribe(publications: DataFrame, checkpoint: str, activate: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """Run `activate` on the newest publication of each stream in every micro-batch."""
    return publications.writeStream.foreachBatch(lambda batch, number: activate(newest(batch), number)).option("checkpointLocation", checkpoint).outputMode("append").start()


def frames(publications: DataFrame) -> DataFrame:
    """Publications as server-sent event frames, one text each."""
    data = F.to_json(F.struct("generation_id", "sequence"))
    return publications.select("stream", "sequence", F.format_string("id: %d\nevent: catalog\ndata: %s\n\n", F.col("sequence").cast("bigint"), data).alias("frame"))


def parse_frames(frames: DataFrame, *, most_bytes: int = 256 * 1024) -> DataFrame:
    """(stream, sequence, generation_id, problem) of event frames; too large or malformed ones have a problem."""
    body = F.from_json(F.regexp_extract("frame", r"(?m)^data: ?(.*)$", 1), "generation_id string, sequence bigint")
    number = F.regexp_extract("frame", r"(?m)^id: ?(\d+)$", 1).try_cast("bigint")
    problem = F.when(F.octet_length("frame") > most_bytes, "size").when(body["generation_id"].isNull() | number.isNull(), "malformed").when(body["sequence"] != number, "sequence")
    return frames.select("stream", number.alias("sequence"), body["generation_id"].alias("generation_id"), problem.alias("problem"))


def poll_if_due(failures: int, due: float | None, now: float, *, after: int = 3, every: float = 300.0) -> tuple[bool, float | None]:
    """(whether to ask for the current generation now, when to ask next): after some failures of the stream in a row it is asked for now and then."""
    if failures < after:
        return False, None
    return (True, now + every) if due is None or now >= due else (False, due)


def backoff(attempt: int, least: float = 1.0, most: float = 60.0, jitter: float = 0.5) -> tuple[float, float]:
    """(shortest, longest) wait before a reconnect: doubled each time up to `most`, of which half may be random."""
    full = min(most, least * 2**attempt)
    return full * (1 - jitter), full
