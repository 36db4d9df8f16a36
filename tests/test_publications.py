import datetime as dt

from ledgerloom.streaming.publications import backoff, poll_if_due, decided, decisions, frames, newest, parse_frames, subscribe

T = dt.datetime(2026, 1, 1)
DAY = dt.timedelta(days=1)
SCHEMA = "stream string, sequence bigint, generation_id string, digest string, generated_at timestamp"
ROWS = [
    ("s", 1, "g1", "d1", T), ("s", 2, "g1", "d1", T), ("s", 3, "g1", "other", T), ("s", 4, "g0", "d0", T - DAY), ("s", 5, "g2", "d2", T), ("s", 6, "g3", "d3", T + DAY), ("t", 1, "h1", "e1", T - DAY),
]
EXPECTED = ["activated", "duplicate", "conflict", "stale", "conflict", "activated", "activated"]


def test_batch(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.decision for r in decided(df).orderBy("stream", "sequence").collect()] == EXPECTED
    assert sorted((r.stream, r.sequence, r.generation_id) for r in newest(df).collect()) == [("s", 6, "g3"), ("t", 1, "h1")]
    assert decided(df.limit(0)).count() == 0


def test_stream_agrees_with_batch_and_survives_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for start, end in ((0, 3), (3, 7)):  # two runs of one query
        spark.createDataFrame(ROWS[start:end], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = decisions(spark.readStream.schema(SCHEMA).parquet(source))
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = sorted((r.stream, r.sequence, r.decision) for r in spark.read.parquet(out).collect())
    assert [d for _, _, d in got] == EXPECTED


def test_only_the_newest_of_a_batch_is_activated(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    run = subscribe(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "check"), lambda df, n: seen.extend((r.stream, r.generation_id) for r in df.collect()))
    run.processAllAvailable()
    run.stop()
    assert sorted(seen) == [("s", "g3"), ("t", "h1")]


def test_frames(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert parse_frames(frames(df)).first()[1:] == (1, "g1", None)
    bad = spark.createDataFrame([("s", "id: 1\ndata: {}\n\n"), ("s", "x" * 300_000), ("s", 'id: 2\ndata: {"generation_id":"g","sequence":3}\n\n'), ("s", None)], "stream string, frame string")
    assert sorted(str(r.problem) for r in parse_frames(bad).collect()) == ["malformed", "malformed", "sequence", "size"]
    assert backoff(0) == (0.5, 1.0) and backoff(10) == (30.0, 60.0)


def test_polls_after_failures():
    assert poll_if_due(2, None, 0.0) == (False, None) and poll_if_due(3, None, 0.0) == (True, 300.0)
    assert poll_if_due(4, 300.0, 299.0) == (False, 300.0) and poll_if_due(4, 300.0, 301.0) == (True, 601.0) and poll_if_due(0, 300.0, 400.0) == (False, None)
