import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.snapshot_changes import listing_changes, snapshot_changes

ROWS = "feed_id bigint, snapshot_no int, id string, active boolean, shutdown_date string, received_at timestamp_ntz, _key string, change_kind int"
SEEN = "feed_id bigint, snapshot_no int, completeness string, observed_at timestamp_ntz, _no int"
T = dt.datetime(2026, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def changes(spark, records, seen, **options):
    listed = spark.createDataFrame([(*r, "x", 1) for r in records], ROWS)
    observed = spark.createDataFrame([(f, n, c, at(n), 0) for f, n, c in seen], SEEN)
    return sorted(tuple(r) for r in listing_changes(listed, observed, **options).collect())


def test_kinds_partial_and_missing_numbers(spark):
    records = [
        (1, 1, "a", True, "2026-08-12", at(0)), (1, 1, "b", None, None, at(0)), (1, 1, "gone", True, "", at(0)),
        (1, 2, "partial", True, None, at(1)),
        (1, 4, "a", True, "Aug 12, 2026", at(2)), (1, 4, "b", False, None, at(2)), (1, 4, "new", None, None, at(2)),
        (2, 7, "first", True, None, at(0)),
    ]
    seen = [(1, 1, "complete"), (1, 2, "partial"), (1, 4, "complete"), (2, 7, "complete")]
    assert changes(spark, records, seen) == [(1, 4, "b", "changed"), (1, 4, "gone", "removed"), (1, 4, "new", "added")]


def test_latest_delivery_holds_and_repeats_count_once(spark):
    records = [(1, 1, "a", True, None, at(0))] * 3 + [(1, 2, "a", False, None, at(1)), (1, 2, "a", True, None, at(5)), (1, 2, "a", False, None, None)]
    assert changes(spark, records, [(1, 1, "complete"), (1, 2, "complete")] * 2) == []


def test_null_active_is_a_value_and_days_are_compared(spark):
    records = [
        (1, 1, "a", None, "20260812", at(0)), (1, 1, "b", True, "2026/08/12", at(0)), (1, 1, "c", True, " ", at(0)), (1, 1, "d", True, "soon", at(0)),
        (1, 2, "a", True, "2026-08-12T00:00:00Z", at(1)), (1, 2, "b", True, "2026-08-13", at(1)), (1, 2, "c", True, None, at(1)), (1, 2, "d", True, "soon ", at(1)),
    ]
    assert changes(spark, records, [(1, 1, "complete"), (1, 2, "complete")]) == [(1, 2, "a", "changed"), (1, 2, "b", "changed")]


def test_empty_snapshot_null_keys_and_empty_tables(spark):
    records = [(1, 1, "a", True, None, at(0)), (1, 1, None, True, None, at(0)), (None, 1, "x", True, None, at(0)), (1, None, "x", True, None, at(0))]
    assert changes(spark, records, [(1, 1, "complete"), (1, 2, "complete"), (None, 3, "complete")]) == [(1, 2, "a", "removed")]
    assert changes(spark, [], []) == []
    assert changes(spark, records, []) == []


@pytest.mark.parametrize("slice_rows", [10, 10_000])
def test_any_cut_gives_the_result_of_a_plain_comparison(spark, slice_rows):
    rng = random.Random(slice_rows)
    tables = {}
    held = {f"k{i}": rng.choice([True, False, None]) for i in range(400)}
    for number in range(1, 5):
        for _ in range(15):
            held.pop(rng.choice(list(held)))
            held[f"n{number}-{rng.random()}"] = True
            held[rng.choice(list(held))] = rng.choice([True, False, None])
        tables[number] = dict(held)
    expected = set()
    for n in (2, 3, 4):
        old, new = tables[n - 1], tables[n]
        expected |= {(9, n, k, "added") for k in new.keys() - old.keys()} | {(9, n, k, "removed") for k in old.keys() - new.keys()}
        expected |= {(9, n, k, "changed") for k in new.keys() & old.keys() if new[k] is not old[k]}
    records = [(9, n, k, v, None, at(n)) for n, t in tables.items() for k, v in t.items()]
    got = changes(spark, records, [(9, n, "complete") for n in tables], slice_rows=slice_rows, chunk_rows=8)
    assert set(got) == expected and len(got) == len(expected)


def test_other_compared_columns(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1.5, at(0)), (1, 2, "a", 2.5, at(1))], "f int, n int, k string, price double, r timestamp_ntz")
    got = snapshot_changes(rows, rows.select("f", "n"), feed="f", number="n", key="k", received="r", compared={"price": F.col("price")})
    assert [tuple(r) for r in got.collect()] == [(1, 2, "a", "changed")]


def test_a_feed_that_grows_past_a_slice(spark):
    """One number of slices holds for all snapshots of a feed, so one that grows is still cut where the one before it was."""
    sizes = {1: 40, 2: 60, 3: 260, 4: 30}
    records = [(7, n, f"k{i:03}", i % 3 == 0, None, at(n)) for n, size in sizes.items() for i in range(size)]
    records += [(8, n, "k", n == 2, None, at(n)) for n in (1, 2)]
    got = changes(spark, records, [(f, n, "complete") for f in (7, 8) for n in sizes if f == 7 or n < 3], slice_rows=50, chunk_rows=4)
    expected = [(7, 2, f"k{i:03}", "added") for i in range(40, 60)] + [(7, 3, f"k{i:03}", "added") for i in range(60, 260)] + [(7, 4, f"k{i:03}", "removed") for i in range(30, 260)]
    assert got == sorted([*expected, (8, 2, "k", "changed")])
