import pytest

from ledgerloom.llm.mixing import mixed, water_fill

TARGETS = "source string, target_share double, max_repeats int, copies int"
SIZES = "doc_id bigint, source string, tokens bigint, copies int"


def test_water_fill():
    assert water_fill({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 1)}, 100) == {"a": 50, "b": 50}
    assert water_fill({"a": 10, "b": 100, "c": 100}, {"a": (0.5, 2), "b": (0.25, 1), "c": (0.25, 1)}, 100) == {"a": 20, "b": 40, "c": 40}
    assert water_fill({"a": 10, "b": 10}, {"a": (0.5, 1), "b": (0.5, 1)}, 100) == {"a": 10, "b": 10}
    assert water_fill({"b": 10}, {"a": (0.9, 3), "b": (0.1, 1)}, 8) == {"a": 0, "b": 8}
    assert water_fill({}, {}, 8) == {}


@pytest.mark.parametrize("hot", [1, 20])
def test_shares_and_caps(spark, hot):
    data = [(i, "big", 10 + i % 7, 1) for i in range(300 * hot)] + [(10_000 + i, "small", 5, 1) for i in range(20)] + [(20_000 + i, "mid", 9, 1) for i in range(200)]
    data += [(1, "big", 11, 1), (30_000, None, 50, 1), (30_001, "unlisted", 50, 1), (30_002, "small", None, 1), (None, "big", 3, 1)]
    targets = spark.createDataFrame([("big", 0.4, 1, 0), ("small", 0.2, 3, 0), ("mid", 0.4, 2, 0), ("absent", 0.0, 1, 0), ("never", None, None, 0), (None, 0.5, 1, 0)], TARGETS)
    records, report = mixed(spark.createDataFrame(data, SIZES), targets, total=3000)
    rows = records.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    most = {"big": 1, "small": 3, "mid": 2}
    assert all(1 <= r.copies <= most[r.source] for r in rows)
    shares = {r.source: r for r in report.collect()}
    assert shares["small"].used_tokens == 300 and set(shares) == {"big", "small", "mid", "absent", "never"}
    assert abs(shares["big"].used_tokens - 1350) <= 10 and abs(shares["mid"].used_tokens - 1350) <= 10
    assert shares["absent"].used_tokens == shares["never"].used_tokens == 0
    again, _ = mixed(spark.createDataFrame(data[::-1], SIZES), targets, total=3000)
    assert sorted(again.collect()) == sorted(rows)
    other, _ = mixed(spark.createDataFrame(data, SIZES), targets, total=3000, seed=5)
    assert sorted(other.collect()) != sorted(rows)


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 1.0, 2, 0)], TARGETS)
    records, report = mixed(spark.createDataFrame([], SIZES), targets)
    assert records.count() == 0 and report.first().used_tokens == 0
    records, report = mixed(spark.createDataFrame([(1, "a", 5, 1)], SIZES), targets.limit(0))
    assert records.count() == 0 and report.count() == 0


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    from ledgerloom.llm import mixing

    sizes = spark.createDataFrame([(i, f"s{i % 60}", 10) for i in range(600)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(f"s{i}", 1 / 40, 3) for i in range(40)], "source string, target_share double, max_repeats int")
    expected = sorted(tuple(r) for r in mixing.mixed(sizes, targets)[0].collect())
    monkeypatch.setattr(mixing, "bounded_side", lambda df: df)
    assert sorted(tuple(r) for r in mixing.mixed(sizes, targets)[0].collect()) == expected and len(expected) == 400
