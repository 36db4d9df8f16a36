import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.filters import ModelFilter, Relation, at_most_or_missing, glob_regex, matches_field, page, parse_filter, search

SCHEMA = "id string, name string, status string, ins array<string>, tags array<string>, open boolean, tools boolean, ctx bigint, released date, created timestamp_ntz"
ROWS = [
    ("b", "Alpha", "active", ["text", "Image"], ["Fast"], True, True, 128_000, None, dt.datetime(2024, 1, 1)),
    ("a", "zulu", "Beta", ["text"], ["slow", "cheap"], False, None, 4_096, dt.date(2025, 2, 1), dt.datetime(2025, 1, 1)),
    ("c", None, None, None, None, None, None, None, None, None),
    ("d", "Mid", "active", [], [], None, False, 0, dt.date(2024, 6, 1), None),
]


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def of():
    return Relation(
        id=F.col("id"), name=F.col("name"), status=F.col("status"), input_modalities=F.col("ins"), tags=F.col("tags"), open_weights=F.col("open"), flags={"tools": F.col("tools")},
        context_window=F.col("ctx"), release_date=F.col("released"), created_at=F.col("created"),
    )


def ids(models, **wanted):
    return [r.id for r in ModelFilter(**wanted).apply(models, of()).collect()]


@pytest.mark.parametrize(
    ("wanted", "expected"),
    [
        ({}, ["a", "b", "c", "d"]), ({"id": "B"}, []), ({"name": "ALPHA"}, ["b"]), ({"name_contains": "L"}, ["a", "b"]), ({"status": "ACTIVE"}, ["b", "d"]),
        ({"modality_input": ("IMAGE", "text")}, ["b"]), ({"tags": ("FAST", "cheap")}, ["a", "b"]), ({"open_weights": False}, ["a"]), ({"features": {"tools": False}}, ["a", "c", "d"]),
        ({"min_context": 1}, ["a", "b"]), ({"max_context": 5_000}, ["a"]), ({"min_input": 1}, []), ({"released_after": "2024-06-01"}, ["a", "d"]), ({"released_before": "2024-06-01"}, ["d"]),
        ({"ids": ("a", "z")}, ["a"]), ({"sort": "created_at"}, ["b", "a", "c", "d"]), ({"sort": "created_at", "order": "desc"}, ["a", "b", "c", "d"]),
        ({"sort": "context_window"}, ["a", "b", "c", "d"]), ({"sort": "name", "order": "desc"}, ["a", "d", "b", "c"]), ({"sort": "id", "order": "desc"}, ["d", "c", "b", "a"]),
        ({"limit": 2, "offset": 1}, ["b", "c"]), ({"offset": 10}, []),
    ],
)
def test_filters(models, wanted, expected):
    assert ids(models, **wanted) == expected


@pytest.mark.parametrize(
    "wanted",
    [{"sort": "price"}, {"order": "asc"}, {"sort": "id", "order": "sideways"}, {"limit": 1001}, {"offset": -1}, {"min_context": 10, "max_context": 5}, {"features": {"fly": True}},
     {"modality_input": ("hologram",)}, {"status": "retired"}, {"released_after": "2025-01-01", "released_before": "2024-01-01"}],
)
def test_invalid_filters(models, wanted):
    with pytest.raises(ValueError, match="invalid filter"):
        ModelFilter(**wanted).apply(models, of())


def test_parameters():
    text = {"name_contains": "x", "modality_input": "text, image", "feature": "tools", "feature_streaming": "false", "tag": "a,b", "min_context": "5", "limit": "7", "open_weights": "true"}
    found = parse_filter(text, strict=True)
    assert found == ModelFilter(name_contains="x", modality_input=("text", "image"), features={"tools": True, "streaming": False}, tags=("a", "b"), min_context=5, limit=7, open_weights=True)
    assert parse_filter({"min_context": "five", "feature_x": "maybe", "released_after": "soon", "nonsense": "1"}) == ModelFilter(limit=100)
    for bad in ({"min_context": "five"}, {"feature_x": "maybe"}, {"released_after": "soon"}, {"nonsense": "1"}):
        with pytest.raises(ValueError, match=r"malformed|unknown"):
            parse_filter(bad, strict=True)


def test_pages_search_and_globs(models):
    rows, total = page(models, [F.col("id")], limit=2, offset=3)
    assert [r.id for r in rows.collect()] == ["d"] and total == 4
    rows, _ = page(models, [F.col("id")], limit=0, offset=-5)
    assert rows.count() == 4
    assert {r.id for r in models.where(search("CHEAP", F.col("name"), arrays=[F.col("tags")])).collect()} == {"a"}
    assert models.where(search("", F.col("name"))).count() == 4
    assert {r.id for r in models.where(at_most_or_missing(F.col("ctx"), 4_096)).collect()} == {"a", "c", "d"}
    import re

    assert re.match(glob_regex("gpt-*"), "gpt-4") and not re.match(glob_regex("gpt-*"), "gpt-4/x") and re.match(glob_regex("a.b?"), "a.bc") and not re.match(glob_regex("a.b"), "axb")
    assert {r.id for r in models.where(matches_field(F.col("name"), ["Z*", "mi?"])).collect()} == {"a", "d"}
