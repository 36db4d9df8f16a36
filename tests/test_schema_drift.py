import json

import pytest

from ledgerloom.operators.schema_drift import canonical, leaves_of, schema_changes, unified

SCHEMA = "record_id bigint, feed_id bigint, file_no int, payload string, path string, change_kind int"


def frame(spark, records):
    return spark.createDataFrame([(i, f, n, p if p is None or isinstance(p, str) else json.dumps(p), "x", 1) for i, (f, n, p) in enumerate(records)], SCHEMA)


def test_added_removed_retyped_renamed(spark, rows):
    old = [{"id": f"m{i}", "max_len": 1000 + i, "flag": True, "gone": 1, "deep": {"a": [1], "b": None}} for i in range(10)]
    new = [{"id": f"m{i}", "maxLen": str(1000 + i), "flag": "true", "deep": {"a": {"c": 2}}, "fresh": []} for i in range(10)]
    records = [(1, 1, r) for r in old] + [(1, 4, r) for r in new] + [(2, 1, {"id": "only"})]
    assert rows(schema_changes(frame(spark, records + records))) == sorted([
        (1, 4, "deep.a", "removed"), (1, 4, "deep.a.c", "added"), (1, 4, "flag", "retyped"), (1, 4, "fresh", "added"), (1, 4, "gone", "removed"),
        (1, 4, "maxLen", "renamed"), (1, 4, "maxLen", "retyped"),
    ], key=repr)


@pytest.mark.parametrize(("equal", "renamed"), [(10, True), (9, True), (8, False)])
def test_nine_in_ten(spark, rows, equal, renamed):
    old = [(1, 1, {"id": f"m{i}", "a": i}) for i in range(10)] + [(1, 1, {"id": "left", "a": 99})]
    new = [(1, 2, {"id": f"m{i}", "b": i if i < equal else -1}) for i in range(10)] + [(1, 2, {"id": "came", "b": 7})]
    expected = [(1, 2, "b", "renamed")] if renamed else [(1, 2, "a", "removed"), (1, 2, "b", "added")]
    assert rows(schema_changes(frame(spark, old + new))) == expected


def test_gone_fields_choose_in_order_and_once(spark, rows):
    old = [(1, 1, {"id": "m", "b": 1, "a": True, "c": 5})]
    new = [(1, 2, {"id": "m", "y": 1, "x": "TRUE", "z": 1})]
    assert rows(schema_changes(frame(spark, old + new))) == [
        (1, 2, "c", "removed"), (1, 2, "x", "renamed"), (1, 2, "x", "retyped"), (1, 2, "y", "renamed"), (1, 2, "z", "added"),
    ]


def test_unreadable_null_and_empty(spark, rows):
    records = [(1, 1, {"id": "m", "a": 1}), (1, 2, '{"id": "m", "a'), (1, 2, None), (1, 3, {"id": "m", "a": None}), (1, 3, []), (None, 1, {"q": 1}), (1, None, {"q": 1})]
    assert rows(schema_changes(frame(spark, records))) == [(1, 2, "a", "removed"), (1, 2, "id", "removed"), (1, 3, "id", "added")]
    assert schema_changes(frame(spark, [])).count() == 0


def test_canonical_values():
    assert canonical(131072) == canonical("131072") == canonical("131072.0") == canonical("1.31072E5") == "131072"
    assert canonical(True) == canonical("True") == "true" != canonical(1)
    assert canonical("0.50") == canonical("0.5") and canonical("NaN") == "nan" and canonical("A b") == "a b" and canonical("1_0") == "1_0"
    assert canonical([1, "A"]) == '[1, "a"]' and canonical("0e5") == "0" and canonical("1e999999") == "1e999999"
    assert leaves_of("[1]") is None and leaves_of('{"a": NaN}') is None and list(leaves_of('{"a": {}}')) == []


def test_one_consistent_table(spark, rows):
    records = [
        (1, 1, {"id": "a", "capabilities": {"effort": {"supported": True}}, "max_model_len": 10}),
        (1, 2, {"id": "a", "supports_effort": "false", "contextWindow": 10.0}),
        (1, 3, {"id": "a", "capabilities": {"effort": 1}, "context_length": "12"}),
        (1, 4, {"id": "b", "context_length": "long", "supports_effort": "perhaps"}), (1, 5, {"id": "c"}), (1, 5, {}), (1, 6, "broken"),
    ]
    got = {(r.file_no, r.id): (r.effort_supported, r.context_limit, r.context_integer, r.context_decimal, r.context_string) for r in unified(frame(spark, records)).collect()}
    assert got == {
        (1, "a"): (True, 10, 10, None, None), (2, "a"): (False, 10, None, 10.0, None), (3, "a"): (True, 12, None, None, "12"),
        (4, "b"): (None, None, None, None, "long"), (5, "c"): (None,) * 5, (5, None): (None,) * 5,
    }


def test_every_field_reaches_the_consistent_table(spark, tmp_path):
    records = [
        (1, 1, {"id": "a", "active": True, "metadata": {"tags": ["X", 1], "description": "A b"}, "parent": None, "max_model_len": 1, "unheard of": 10**20}),
        (1, 2, {"id": "a", "active": "TRUE", "metadata": {"tags": []}, "Active": 1, "max_model_len": 2.0, "": 0}), (1, 3, {}), (1, 4, "broken"),
    ]
    unified(frame(spark, records + records)).write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.record_id, r.file_no): r.fields.asDict(recursive=True) for r in found.collect() if r.record_id < len(records)}
    assert set(got) == {(0, 1), (1, 2), (2, 3)}
    assert got[0, 1] == {
        "(empty)": None, "Active": None, "active~2": {"value": "true", "boolean": True, "string": None}, "id": {"value": "a", "string": "a"},
        "max_model_len": {"value": "1", "integer": 1, "decimal": None}, "metadata.description": {"value": "a b", "string": "A b"},
        "metadata.tags": {"value": '["x", 1]', "array": '["X", 1]'}, "parent": {"value": None}, "unheard of": {"value": str(10**20), "integer": None},
    }
    assert got[1, 2]["active~2"] == {"value": "true", "boolean": None, "string": "TRUE"} and got[1, 2]["Active"] == {"value": "1", "integer": 1}
    assert got[1, 2]["max_model_len"] == {"value": "2", "integer": None, "decimal": 2.0} and got[1, 2]["(empty)"] == {"value": "0", "integer": 0} and got[1, 2]["parent"] is None
    assert not any(got[2, 3].values())


def test_spellings_are_derived_from_renames(spark):
    files = ["context_window", "ctx", "limits.ctx.max"]
    nested = lambda path, v: {path.split(".")[0]: nested(path.split(".", 1)[1], v)} if "." in path else {path: v}
    records = [(1, n, {"id": f"m{i}", **nested(path, 1000 + i)}) for n, path in enumerate(files) for i in range(10)] + [(2, 0, {"id": "x", "ctx": 5, "unrelated": 7})]
    got = {(r.feed_id, r.file_no, r.id): (r.context_limit, r.context_path) for r in unified(frame(spark, records)).collect()}
    assert all(got[1, n, f"m{i}"] == (1000 + i, path) for n, path in enumerate(files) for i in range(10)) and got[2, 0, "x"] == (5, "ctx")
    apart = unified(frame(spark, records), renames=False).where("context_limit is not null")
    assert {r.context_path for r in apart.collect()} == {"context_window"}


def test_names_that_are_data(spark):
    records = [(1, 1, {"id": f"m{i}", "max_model_len": i, f"only{i}": i}) for i in range(50)]
    found = unified(frame(spark, records), most_paths=2).collect()
    assert len(found) == 50 and all(set(r.fields.asDict()) == {"id", "max_model_len"} and dict(r.others) == {f"only{i}": str(i)} for r in found for i in [int(r.id[1:])])


def test_one_file_with_nearly_all_rows(spark, rows, monkeypatch):
    """Where what is known of the files isn't proven small, records and files meet in salted parts."""
    from ledgerloom.operators import schema_drift

    records = [(1, n, {"id": f"m{i}", ("a" if n == 1 else "b"): i, "t": "x" * 100}) for n in (1, 2) for i in range(300)] + [(1, 3, {"id": "m1", "b": 1, "t": 1})]
    expected = [(1, 2, "b", "renamed"), (1, 3, "t", "retyped")]
    assert rows(schema_changes(frame(spark, records))) == expected
    monkeypatch.setattr(schema_drift, "bounded_side", lambda df: df)
    assert rows(schema_changes(frame(spark, records))) == expected
