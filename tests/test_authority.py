import itertools

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.authority import POLICIES, Policy, change_aware_times, find_policy, merged_maps, one_per_source, overlaid, provenance, resolve_fields, unioned, whole_value

ORDER = ("first", "second", "third")
P = Policy("model", "x", ORDER)
CLAIM = Policy("model", "x", ORDER, empty="authoritative")


def test_policies():
    assert len(POLICIES) == 52 and len({(p.resource, p.path) for p in POLICIES}) == 52
    assert find_policy(POLICIES, "model", "limits.context_window").path == "limits" and find_policy(POLICIES, "model", "nothing") is None
    assert find_policy([*POLICIES, Policy("model", "limits.*", ORDER)], "model", "limits.output").path == "limits.*"
    assert [P.authority(s) for s in (*ORDER, "other")] == [1.0, 2 / 3, 1 / 3, 0.0]


DATA = [("k", "second", "b", 0, True), ("k", "first", " ", 5, None), ("k", "other", "z", 9, False), ("j", "other", "y", None, None), ("j", "another", None, 0, None)]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[:4])
def test_first_claim_wins_in_any_order_of_rows(spark, order):
    data = [DATA[i] for i in order] + DATA[3:]
    df = spark.createDataFrame(data, "k string, source string, name string, n int, flag boolean")
    got = {r.k: tuple(r)[1:] for r in resolve_fields(df, ["k"], "source", {"name": P, "n": P, "flag": CLAIM}).collect()}
    assert got == {"k": ("b", 5, True), "j": ("y", 0, None)}
    told = {r.k: r for r in resolve_fields(df, ["k"], "source", {"n": CLAIM}, evidence=True).collect()}
    assert (told["k"].n.source, told["k"].n.authority) == ("first", 1.0) and told["j"].n.authority == 0.0


def test_latest_of_each_source(spark, rows):
    df = spark.createDataFrame([("k", "s", 1, 10), ("k", "s", 2, 20), ("k", "s", None, 30), ("k", "t", None, 40)], "k string, source string, at int, v int")
    assert rows(one_per_source(df, ["k"], "source", F.col("at"))) == [("k", "s", 2, 20), ("k", "t", None, 40)]


def test_whole_values(spark, rows):
    df = spark.createDataFrame([("k", "first", -1), ("k", "second", 5), ("k", "third", 7), ("j", "second", -2), ("i", "first", None)], "k string, source string, v int")
    assert rows(whole_value(df, ["k"], "source", P, "v", F.col("v") > 0)) == [("j", None, None, ["second"]), ("k", 5, "second", ["first"])]


def test_lists_and_maps(spark, rows):
    df = spark.createDataFrame([("k", "second", ["b", "c", None]), ("k", "first", ["c", "", "a"]), ("k", "zz", ["d", "b"]), ("e", "first", [])], "k string, source string, tags array<string>")
    assert rows(unioned(df, ["k"], "source", P, "tags")) == [("k", ["c", "a", "b", "d"])]
    maps = spark.createDataFrame([("k", "second", {"x": 2, "y": 2}), ("k", "first", {"x": 1, "z": None})], "k string, source string, m map<string,int>")
    assert merged_maps(maps, ["k"], "source", P, "m").first().m == {"x": 1, "y": 2}


def test_provenance_and_overlay(spark, rows):
    df = spark.createDataFrame(DATA, "k string, source string, name string, n int, flag boolean")
    assert rows(provenance(df.where("k = 'k'"), ["k"], "source", {"name": P, "flag": CLAIM})) == [
        ("k", "other", "flag", "false", 0.0), ("k", "other", "name", "z", 0.0), ("k", "second", "flag", "true", 2 / 3), ("k", "second", "name", "b", 2 / 3),
    ]
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    right = spark.createDataFrame([(1, " ", 7), (3, "c", 0)], "k int, name string, n int")
    assert rows(overlaid(left, right, ["k"], ["name", "n"])) == [(1, "a", 7), (2, "b", 6), (3, "c", None)]


def test_times(spark):
    df = spark.createDataFrame([(5, 3, False, True), (1, 2, True, False), (1, 2, False, False)], "c int, u int, changed boolean, fresh boolean")
    created, updated = change_aware_times(F.col("c"), F.col("u"), F.col("changed"), F.col("fresh"), F.lit(9))
    assert [tuple(r) for r in df.select(created, updated).collect()] == [(3, 5), (1, 9), (1, 2)]
