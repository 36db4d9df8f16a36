import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators.diff import change_rows, field_changes, should_publish, summary, touched
from ledgerloom.operators.ranking import conflicts, current_evidence, first_by, history, unknown_on_tie
from ledgerloom.operators.setops import append_new, corpus, deleted, inserted, refused_deletes, restricted, upserted
from ledgerloom.operators.views import definitions, gate, membership, offering_index, ordered_list

T = dt.datetime(2026, 1, 1)


def test_ranking(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("b", 3, "x"), ("b", 3, "y"), ("b", 1, "z"), ("c", 1, None), ("c", 1, "q")], "k string, score int, v string")
    assert rows(unknown_on_tie(df, ["k"], [F.col("score").desc()], "v")) == [("a", "x", True), ("b", None, False), ("c", None, False)]
    assert rows(first_by(df, ["k"], [F.col("score"), F.col("v").asc_nulls_last()])) == [("a", 2, "x"), ("b", 1, "z"), ("c", 1, "q")]
    told = spark.createDataFrame([("k", "f", T, 1), ("k", "f", None, 2), ("k", "f", T + dt.timedelta(1), 3)], "k string, field string, at timestamp_ntz, n int")
    assert rows(history(told, ["k"], "field", "at").select("n", "place", "current")) == [(1, 2, False), (2, 3, False), (3, 1, True)]


def test_conflicts_and_support(spark, rows):
    half = dt.timedelta(milliseconds=400)
    df = spark.createDataFrame([("k", T, 0.5, "b"), ("k", T + half, 0.5, "a"), ("k", T, 0.1, "c"), ("j", T, 0.0, "x"), ("j", T, -1.0, "y"), ("i", T, 1.0, "z")], "k string, at timestamp_ntz, score double, v string")
    assert [(r.k, r.entries, r.winner) for r in sorted(conflicts(df, ["k"], "at", "score", "v").collect())] == [("j", 2, None), ("k", 3, "a")]
    evidence = spark.createDataFrame([("k", 2, 0, "new"), ("k", 1, 1, "old"), ("k", 2, 1, "later")], "k string, at int, pos int, v string")
    facts = spark.createDataFrame([("k", "new"), ("q", "x")], "k string, fact string")
    assert rows(current_evidence(evidence, ["k"], "at", "pos", "v", facts, "fact")) == [("k", "new", True), ("q", "x", False)]


def test_field_changes(spark, rows):
    old = spark.createDataFrame([(1, "a", [1], None), (2, "b", [2], 5), (3, "c", None, 1)], "id int, name string, tags array<int>, n int")
    new = spark.createDataFrame([(1, "a", [1, 2], None), (2, "b", [2], 5), (4, "d", None, 1)], "id int, name string, tags array<int>, n int")
    paths = {"name": "name", "meta.tags": "tags", "n": "n"}
    changes = field_changes(old, new, ["id"], paths)
    assert rows(change_rows(changes, ["id"])) == [(1, "updated", "meta.tags", "[1]", "[1,2]"), (3, "removed", None, None, None), (4, "added", None, None, None)]
    assert [tuple(r) for r in summary(changes).collect()] == [(1, 1, 1, 3)]
    assert field_changes(old, new, ["id"], paths, ignored=["meta.*"]).where("change_type = 'updated'").isEmpty()
    assert field_changes(old, new, ["id"], paths, deep=False).where("change_type = 'updated'").isEmpty()
    assert touched(changes, ["meta.*"]).count() == 1 and touched(changes, ["n"]).isEmpty()
    nothing = field_changes(old, old, ["id"], paths)
    assert should_publish(changes) and not should_publish(nothing) and should_publish(nothing, forced=True) and should_publish(nothing, review=old)


def test_set_writes(spark, rows):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert rows(append_new(a, b, ["k"])) == [(1, "a"), (2, "a"), (3, "b")]
    assert rows(upserted(a, b, ["k"])) == [(1, "a"), (2, "b"), (3, "b")]
    kept, absent = deleted(a, b, ["k"])
    assert rows(kept) == [(1, "a")] and rows(absent) == [(3,)]
    batch = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (1, "z", 3)], "k int, v string, place int")
    stored, conflict = inserted(a, batch, ["k"], "place")
    assert rows(stored) == [(1, "a"), (2, "a"), (3, "y")] and rows(conflict) == [(1, "z", 3)]
    local, boot = spark.createDataFrame([(9, "l")], "k int, v string"), spark.createDataFrame([(2, "s"), (5, "s")], "k int, v string")
    assert rows(corpus(a, boot, local, ["k"], complete=True)) == [(2, "a"), (5, "s"), (9, "l")]
    assert rows(corpus(a, boot, local, ["k"], complete=False)) == [(1, "a"), (2, "a"), (5, "s"), (9, "l")]
    assert rows(refused_deletes(a, "k", b, "k")) == [(2, "a")]
    aliases = spark.createDataFrame([("a", "base"), ("q", None)], "alias string, target string")
    assert rows(restricted(a, "v", aliases)) == [(1, "base"), (2, "base")]


def test_views(spark, rows):
    offers = spark.createDataFrame([("d", "p", True, ["x"], 3), ("d", "q", None, ["y", "x", None], None), ("e", "p", None, None, None)], "d string, p string, flag boolean, tags array<string>, n int")
    assert rows(definitions(offers, "d", flags=["flag"], lists=["tags"], largest=["n"])) == [("d", 2, True, 3, ["x", "y"]), ("e", 1, None, 0, [])]
    known, twice = offering_index(spark.createDataFrame([("p",)], "p string"), offers.select("p", "d"), "p", "d")
    assert rows(known) == [("p", "d"), ("p", "e")] and twice.isEmpty()
    pairs = offers.select(F.col("p").alias("owner"), F.col("d").alias("member"))
    aliases = spark.createDataFrame([("pp", "p")], "alias string, target string")
    assert rows(membership(pairs, "owner", "member", aliases)) == [("p", ["d", "e"]), ("pp", ["d", "e"]), ("q", ["d"])]
    assert rows(ordered_list(offers, "d", [F.col("p").desc() if False else F.col("p")], ["p"]).select("d", F.transform("items", lambda x: x["p"]))) == [("d", ["p", "q"]), ("e", ["p"])]
    assert gate(offers, offers, "d", "p", least_groups=2, least_keys=3, keep_groups=0.8, keep_keys=0.5).first().promoted
    assert not gate(offers.limit(0), offers, "d", "p", least_groups=0, least_keys=0, keep_groups=0.8, keep_keys=0.5).first().promoted


def test_lists_of_a_key_with_nearly_all_rows(spark):
    rows_ = spark.createDataFrame([("hot", i * 7919 % 1000) for i in range(1000)] + [("cold", 3), ("cold", 1)], "k string, n int")
    paged = ordered_list(rows_, "k", [F.col("n")], ["n"], page_rows=64).collect()
    assert all(len(r["items"]) <= 64 for r in paged)
    hot = [x["n"] for r in sorted((r for r in paged if r.k == "hot"), key=lambda r: r.page) for x in r["items"]]
    assert hot == list(range(1000)) and [(r.page, [x["n"] for x in r["items"]]) for r in paged if r.k == "cold"] == [(0, [1, 3])]
    whole = {r.k: [x["n"] for x in r["items"]] for r in ordered_list(rows_, "k", [F.col("n")], ["n"]).collect()}
    assert whole["hot"] == hot and whole["cold"] == [1, 3]


def test_a_stream_that_has_nearly_all_rows(spark):
    """Blocks of a stream give the decisions of one window over it."""
    import random

    from ledgerloom.streaming.publications import decided

    rng = random.Random(4)
    data = [("s" if i % 9 else "t", i, f"g{rng.randrange(40)}", f"d{rng.randrange(3)}", T + dt.timedelta(hours=rng.randrange(200))) for i in range(600)]
    df = spark.createDataFrame(data, "stream string, sequence bigint, generation_id string, digest string, generated_at timestamp")
    told = lambda **options: sorted(tuple(r) for r in decided(df, **options).select("stream", "sequence", "decision").collect())
    assert told(block_rows=25) == told() and len(told()) == 600


def test_quarantine_of_a_key_with_nearly_all_rows(spark, rows):
    from ledgerloom.sources.payloads import quarantined

    df = spark.createDataFrame([(i, "hot" if i % 10 else None) for i in range(1, 200)] + [(1, "hot"), (200, " padded")], "place int, owner string")
    fine, bad = quarantined(df, ["owner"], F.col("owner"), F.lit(None).cast("string"), F.col("place"))
    assert rows(fine) == [(1, "hot")] and bad.count() == 200 and {r.reason for r in bad.collect()} == {"repeated", "id: blank", "id: padded"}
