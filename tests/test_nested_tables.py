import json

from ledgerloom.operators.nested_tables import endpoint_members, flatten, infer, whole_number
from pyspark.sql import functions as F

SCHEMA = "payload_id bigint, payload string, row_key string, ordinal int"


def frame(spark, payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), "x", 1) for i, p in payloads], SCHEMA)


ENDPOINT = {"provider_name": " Acme ", "context_length": 4096, "pricing": {"tiers": [{"provider_name": "tier", "context_length": 1}]}}


def test_endpoint_members_in_every_shape(spark, rows):
    data = [
        (1, {"data": {"architecture": {"input_modalities": ["text", None, "image", "image"]}, "endpoints": [ENDPOINT, None, {"provider_name": " ", "context_length": " 8192 "}]}}),
        (2, {"data": json.dumps({"architecture": {"input_modalities": "text, audio"}, "endpoints": {"provider_name": "One", "context_length": 131072.0}})}),
        (3, {"data": {"architecture": None, "endpoints": None}}), (4, {"error": {"code": 404}}), (5, {"data": None}), (6, {}),
        (7, '{"data": {"endpoints": [{"provider_name": "cut'), (8, None), (9, ""), (10, '{"data": {"endpoints": [{"provider_name": "x"}]}} trailing'),
        (11, {"data": {"endpoints": [{"provider_name": None, "context_length": None, "regions": [{"context_length": 5}]}, {"context_length": "many"}, {"context_length": 1.5}]}}),
        (12, [1, 2]), (None, {"data": {"endpoints": [ENDPOINT]}}),
    ]
    expected = [
        (1, "context_length", 0, "4096"), (1, "context_length", 2, "8192"), (1, "input_modality", 0, "text"), (1, "input_modality", 2, "image"), (1, "input_modality", 3, "image"),
        (1, "provider_name", 0, "Acme"), (2, "context_length", 0, "131072"), (2, "input_modality", 0, "text"), (2, "input_modality", 1, "audio"), (2, "provider_name", 0, "One"),
    ]
    assert rows(endpoint_members(frame(spark, data + data[:2]))) == sorted(expected, key=repr)


def test_a_list_of_envelopes_in_data(spark, rows):
    data = [(1, {"data": [{"endpoints": [ENDPOINT]}]}), (2, {"data": {"endpoints": [{"provider_name": "B"}]}})]
    assert rows(endpoint_members(frame(spark, data))) == [(1, "context_length", 0, "4096"), (1, "provider_name", 0, "Acme"), (2, "provider_name", 0, "B")]


def test_empty_and_hopeless_tables(spark):
    assert endpoint_members(frame(spark, [])).count() == 0
    assert endpoint_members(frame(spark, [(1, "{"), (2, None), (3, "[]")])).count() == 0


def test_tables_link_parents_and_children(spark):
    record = {"id": "m", "tags": ["a", None, "b"], "runs": [{"n": 1, "steps": [{"s": "x"}, {"s": "y"}]}, {"n": "two", "steps": {"s": "z"}}], "odd": {"a.b": 1, "it's": True}}
    tables = flatten(frame(spark, [(1, record), (1, record), (2, {"id": None, "runs": None})]), "payload_id", "payload")
    assert tables.paths() == ["runs", "tags", "runs.steps"]
    root = {r.row_key: r for r in tables.table().collect()}
    assert root["1"]["id"] == "m" and root["1"]["odd.a.b"] == "1" and root["1"]["odd.it's"] == "true" and root["2"]["id"] is None and len(root) == 2
    assert sorted((r.row_key, r.ordinal, r.n) for r in tables.table("runs").collect()) == [("1/runs[0]", 0, "1"), ("1/runs[1]", 1, "two")]
    assert sorted((r.parent_key, r.ordinal, r.s) for r in tables.table("runs.steps").collect()) == [("1/runs[0]", 0, "x"), ("1/runs[0]", 1, "y"), ("1/runs[1]", 0, "z")]
    assert sorted((r.ordinal, r.value) for r in tables.table("tags").collect()) == [(0, "a"), (2, "b")]


def test_very_long_and_wide(spark):
    record = {"data": {"endpoints": [{"provider_name": "p" * 50_000, "context_length": i} for i in range(300)]}}
    assert endpoint_members(frame(spark, [(1, record)])).count() == 600


def test_whole_numbers(spark):
    cases = {"131072": "131072", "131072.0": "131072", "1.31072e5": "131072", "131,072": "131072", " 7 ": "7", "1.5": None, "x": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", whole_number(F.col("t")).alias("n")).collect()} == cases


def test_forty_levels(spark, rows):
    record = {"n": 40, "leaf": "bottom"}
    for level in range(39, 0, -1):
        record = {"n": level, "kids": [{"skip": level}, record]}
    tables = flatten(frame(spark, [(1, record)]), "payload_id", "payload")
    deepest = ".".join(["kids"] * 39)
    assert deepest in tables.paths() and len(tables.paths()) == 39
    flat = {"n": 0, "deep": {}}
    inner = flat["deep"]
    for level in range(60):
        inner["d"] = inner = {"level": level}
    table = flatten(frame(spark, [(1, flat)]), "payload_id", "payload").table()
    assert [r[f"deep{'.d' * 60}.level"] for r in table.collect()] == ["59"]
    fifth = tables.table(".".join(["kids"] * 5))
    assert rows(fifth.select("ordinal", "n", "skip")) == sorted([(0, None, "5"), (1, "6", None)], key=repr)


def test_members_that_are_data(spark):
    data = [(i, {"kind": "m", "by_name": {f"n{i}-{j}": {"size": j, "tags": ["a", "b"]} for j in range(50)}}) for i in range(100)]
    schema = infer(frame(spark, data), "payload")
    assert schema.members["by_name"].is_map and not schema.members["by_name"].members and len(schema.lines()) < 10
    tables = flatten(frame(spark, data), "payload_id", "payload", schema=schema)
    assert tables.paths() == ["by_name", "by_name.tags"]
    found = tables.table("by_name").collect()
    assert len(found) == 5000 and {(r.parent_key, r.member_name, r.size) for r in found} == {(str(i), f"n{i}-{j}", str(j)) for i in range(100) for j in range(50)}
    assert tables.table("by_name.tags").count() == 10_000


def test_roots_of_both_shapes(spark, rows):
    tables = flatten(frame(spark, [(1, {"id": "a", "xs": [1]}), (2, [{"id": "b"}, None, {"id": "c", "xs": [2, 3]}]), (3, "7")]), "payload_id", "payload")
    assert tables.paths() == ["[]", "xs", "[].xs"]
    assert rows(tables.table("[]").select("parent_key", "ordinal", "id")) == [("2", 0, "b"), ("2", 2, "c")]
    assert rows(tables.table("[].xs").select("parent_key", "value")) == [("2/[][2]", "2"), ("2/[][2]", "3")]
    assert rows(tables.table("xs").select("parent_key", "value")) == [("1", "1")]
    assert rows(tables.table().select("row_key", "id")) == [("1", "a"), ("2", None), ("3", None)]
