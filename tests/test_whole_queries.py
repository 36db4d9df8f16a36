"""Queries that run an operator over all of its input, on fixtures."""

import json

from ledgerloom.plans.catalog_queries import QUERIES


def test_payload_records_all(spark, rows, tmp_path):
    envelope = lambda e: json.dumps({"data": {"endpoints": e}})
    one = {"model_id": "m", "name": "n", "tag": "t"}
    data = [
        (1, envelope([one] * 5)), (1, envelope([one] * 5)), (2, envelope([one, 7, None, one, "x"])), (3, envelope({"b": one, "a": one, "c": 1, "d": one, "e": one})),
        (4, envelope({})), (5, envelope([])), (6, envelope(None)), (7, '{"data"'), (8, None),
    ]
    spark.createDataFrame(data, "payload_id bigint, payload string").write.parquet(str(tmp_path / "endpoint_payload.parquet"))
    found = QUERIES["payload_records_all"](spark, str(tmp_path)).select("payload_id", "accepted", "rejected", "truncated", "broken")
    assert rows(found) == [
        (1, 5, 0, False, False), (2, 2, 3, False, False), (3, 4, 1, False, False), (4, 0, 0, False, False), (5, 0, 0, False, False),
        (6, 0, 0, False, True), (7, 0, 0, False, True), (8, 0, 0, False, True),
    ]


def test_snapshot_diff_all(spark, rows, tmp_path):
    # Keys ending in 0 are new, those ending in 1 removed; multiples of 7 change their status, those of 11 lose their price.
    data = [(k, 1, "O", float(k) + 0.5, None, "1-URGENT") for k in (10, 21, 3, 7, 11, 22, 77, 154)] + [(33, 1, None, None, None, "5-LOW")]
    shape = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    spark.createDataFrame(data, shape).write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["snapshot_diff_all"](spark, str(tmp_path)).select("o_orderkey", "change_type", "path", "old", "new")
    assert rows(found) == sorted([
        (10, "added", None, None, None), (11, "removed", None, None, None), (21, "removed", None, None, None), (7, "updated", "status", "O", "X"), (22, "updated", "price", "22.5", None),
        (77, "updated", "status", "O", "X"), (77, "updated", "price", "77.5", None), (154, "updated", "status", "O", "X"), (154, "updated", "price", "154.5", None),
    ], key=repr)


def test_split_variants(spark, rows, tmp_path):
    spark.createDataFrame([(1, "a", 5.0), (2, "b", 0.0), (3, "c", -1.25), (4, "d:x", 100.0)], "s_suppkey bigint, s_name string, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    found = QUERIES["split_variants"](spark, str(tmp_path)).select("s_suppkey", "base", "variant", "plain")
    assert rows(found) == [(1, "a", "", "5"), (2, "b", "beta", "0"), (3, "c", "", "-1.25"), (4, None, None, "100")]
