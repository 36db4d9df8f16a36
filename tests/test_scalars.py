import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions.days import calendar_day


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_days(spark):
    texts = {"2026-08-12": 12, "2026/8/12": 12, "20260812": 12, "2026-08-12T23:00:00Z": 12, " Aug 12,  2026 ": 12, "August 12 2026": 12, "12 Aug 2026": 12, "2026-02-30": None, "Foo 1, 2026": None, "soon": None, "": None, None: None}
    assert values(spark, texts, calendar_day) == [d and dt.date(2026, 8, d) for d in texts.values()]


def test_parse_date(spark):
    texts = {
        "2024-06-15": (2024, 6, 15), "2024-06": (2024, 6, 1), "2024": (2024, 1, 1), "1800": (1800, 1, 1), "2024-06-15T10:00:00Z": (2024, 6, 15), "2026-08-12T23:59:59.5-05:00": (2026, 8, 12),
        "2026-02-30": (2026, 1, 1), "2026-02-30T00:00:00Z": (2026, 1, 1), "2025-13": (2025, 1, 1), "2025 or so": (2025, 1, 1), "2026/08/12": (2026, 1, 1), "20260812": (2026, 1, 1), "3000-xx": None,
        "01/02/2025": None, "March 4, 2025": None, " 2024-06-15": None, "2024-06-15 ": (2024, 1, 1), "x": None, "": None, None: None,
    }
    assert values(spark, texts, S.parse_date) == [d and dt.date(*d) for d in texts.values()]


def test_any_date(spark):
    texts = {"2025-01-02": (2025, 1, 2), "2025-01": (2025, 1, 1), "01/02/2025": (2025, 1, 2), "March 4, 2025": (2025, 3, 4), "2025 or so": (2025, 1, 1), "1800": None, "2025-13-01": (2025, 1, 1), "x": None, None: None}
    assert values(spark, texts, S.any_date) == [d and dt.date(*d) for d in texts.values()]


def test_any_date_of_instants_and_short_months(spark):
    texts = {
        "2026-08-12T00:00:00Z": (2026, 8, 12), " 2026-08-12T23:59:59.123456789-05:00 ": (2026, 8, 12), "2026-08-12T00:30:00+09:00": (2026, 8, 12), "2024-02-29T12:00:00Z": (2024, 2, 29),
        "2026-02-30T00:00:00Z": (2026, 1, 1), "2026-08-12T24:00:00Z": (2026, 1, 1), "2026-08-12T00:00:00": (2026, 1, 1), "2026-08-12 00:00:00Z": (2026, 1, 1), "2026-08-12T00:00:00+25:00": (2026, 1, 1),
        "Jun 12, 2027": (2027, 6, 12), "May 1, 2027": (2027, 5, 1), "June 12, 2027": (2027, 6, 12), "Xyz 1, 2027": None, "Feb 30, 2027": None, "2026-08-12": (2026, 8, 12), "20260812": (2026, 1, 1), "": None, None: None,
    }
    assert values(spark, texts, lambda c: S.any_date(c, instants=True)) == [d and dt.date(*d) for d in texts.values()]


def test_identities(spark):
    assert values(spark, ["a/b", "a", "a/b/c", "/b", None], lambda c: S.definition_parts(c)["slug"]) == ["b", None, None, None, None]
    assert values(spark, ["a", "a:b", "a:b:c"], lambda c: S.split_variant(c)["variant"]) == ["", "b", None]
    assert values(spark, ["x y", " Meta AI ", "", None], S.owner_id) == ["x-y", "meta-ai", "unknown", "unknown"]
    earlier = ["canopylabs", "huggingfaceh4", "llama", "moonshot", "moonshotai", "togetherai", "zhipuai", " LLAMA ", "  Example Author  ", " "]
    assert values(spark, earlier, S.owner_id) == ["canopy-labs", "huggingface", "meta", "moonshot-ai", "moonshot-ai", "together", "zhipu-ai", "llama", "example-author", ""]
    resource = lambda c: S.resource_parts(S.resource_id(F.lit("p/1"), c))["identity"]
    assert values(spark, ["a/b c%", "é"], resource) == ["a/b c%", "é"]
    assert values(spark, ["a", "a/b/c", "%zz/b", "a%2Fb/c"], lambda c: S.resource_parts(c)["scope"]) == [None, None, None, "a/b"]
    assert values(spark, ["publishers/x/models/y", "models/z", "plain"], lambda c: S.last_path_part(c, "/models/")) == ["y", "z", "plain"]
    assert values(spark, ["publishers/x/models/y", "none"], lambda c: S.part_after(c, "publishers")) == ["x", None]


def test_json(spark):
    assert values(spark, ['{"b": 1.0, "a": [1, null]}', '{"a":[1,null],"b":1.0}', "{", None], S.canonical_json)[2:] == [None, None]
    same = values(spark, ['{"b": 1, "a": 2}', '{"a":2,"b":1}'], S.canonical_json)
    assert same[0] == same[1]
    records = ['{"k": 5}', '{"k": null}', "{}", '{"k": "x"}']
    assert values(spark, records, lambda c: S.json_presence(F.try_parse_json(c), "$.k", "bigint")["state"]) == [2, 1, 0, 2]
    assert values(spark, records, lambda c: S.json_presence(F.try_parse_json(c), "$.k", "bigint")["value"]) == [5, None, None, None]


@pytest.mark.parametrize(("a", "b", "some", "every"), [(True, None, True, None), (False, None, None, False), (False, False, False, False), (True, True, True, True), (None, None, None, None), (True, False, True, False)])
def test_three_valued(spark, a, b, some, every):
    x, y = F.lit(a).cast("boolean"), F.lit(b).cast("boolean")
    assert tuple(spark.range(1).select(S.any_known(x, y), S.all_known(x, y)).first()) == (some, every)


def test_numbers_and_display(spark):
    row = spark.range(1).select(
        S.short_count(F.lit(1_000_000)), S.short_count(F.lit(1500)), S.short_count(F.lit(7)), S.truncated(F.lit("abcdefgh"), 6), S.plain_decimal(F.lit(1e-7)), S.plain_decimal(F.lit(2.0)), S.thousands(F.lit(1234567)),
        S.snapped(F.lit(0.30000000001), 1e6), S.snapped(F.lit(0.3000004), 1e6), S.lenient_long(F.lit("7.0")), S.lenient_long(F.lit("x")), S.optional_double(F.lit(" 1.5 ")),
    ).first()
    assert tuple(row) == ("1.0M", "1.5K", "7", "abc...", "0.0000001", "2", "1,234,567", 0.3, 0.3000004, 7, 0, 1.5)


def test_presence_arrays_and_rules(spark):
    row = spark.range(1).select(
        S.presence(F.lit(5), F.lit(True))["state"], S.presence(F.lit(None).cast("int"), F.lit(True))["state"], S.presence(F.lit(5), F.lit(None).cast("boolean"))["state"],
        S.implied_presence(F.lit(True), F.lit(0)), S.implied_presence(F.lit(0), F.lit(0)), S.implied_presence(F.lit(0), F.lit(1)),
        S.ordered_union(F.array(F.lit("b"), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b"))), S.ranked(F.array(F.lit("z"), F.lit("audio"), F.lit("text")), ["text", "audio"]),
        S.flag_names({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)}), S.cleaned_tags(F.array(F.lit(" x "), F.lit(" "))), S.known_values(F.array(F.lit(" Text"), F.lit("smell")), ["text"]),
        S.mapped(F.lit("q"), {"a": "b"}, F.lit("none")), S.violations({"r1": F.lit(False), "r2": F.lit(None).cast("boolean"), "r3": F.lit(True)}), S.effective_at(F.lit(5), F.lit(5), F.lit(None).cast("int")), S.effective_at(F.lit(5), F.lit(None).cast("int"), F.lit(5)),
    ).first()
    assert tuple(row) == (2, 1, 0, 2, 0, 1, ["b", "a"], ["text", "audio", "z"], ["a", "c"], ["x"], ["text"], "none", ["r1"], True, False)
