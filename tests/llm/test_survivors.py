import datetime as dt

from ledgerloom.llm.survivors import dollar_price, surviving_fields, surviving_records
from pyspark.sql import functions as F

LISTING = "model_ref string, listing_id bigint, source_id string, observed_at timestamp_ntz, max_input_tokens bigint, openrouter struct<context_length:bigint,prompt:string>, _group int, value string"
T = dt.datetime(2026, 1, 1)


def frames(spark, data, authority):
    return spark.createDataFrame([(*r, 1, "x") for r in data], LISTING), spark.createDataFrame([(*a, "x") for a in authority], "field_name string, source_id string, priority int, _of string")


AUTHORITY = [("max_input_tokens", "good", 1), ("max_input_tokens", "fair", 2), ("max_input_tokens", "fair", 9), ("openrouter.prompt", "fair", 1)]


def test_trust_then_recency_then_key(spark, rows):
    day = dt.timedelta(days=1)
    data = [
        ("a", 1, "good", T, 0, None), ("a", 2, "fair", T, 10, (5, "free")), ("a", 3, "other", T + day, 20, (None, "$0.5")), ("a", 3, "other", T + day, 20, (None, "$0.5")),
        ("b", 4, "other", None, 7, (8, "0")), ("b", 5, None, T, 9, (100_000_001, "USD 1e-6")), ("b", 6, None, T, 9, (-1, "-1")),
        ("alone", 7, "good", T, 1, (1, "1")), ("alone", 7, "good", T, 1, (1, "1")),
        ("useless", 8, "good", T, None, None), ("useless", 9, "good", T, 0, (0, "NaN")), (None, 10, "good", T, 1, None), ("a", None, "good", T, 1, None),
    ]
    got = rows(surviving_fields(*frames(spark, data, AUTHORITY)).select("model_ref", "field_name", "listing_id"))
    assert got == [
        ("a", "max_input_tokens", 2), ("a", "openrouter.context_length", 2), ("a", "openrouter.prompt", 3),
        ("b", "max_input_tokens", 5), ("b", "openrouter.context_length", 4), ("b", "openrouter.prompt", 5),
    ]
    whole = {r.model_ref: r for r in surviving_records(*frames(spark, data, AUTHORITY)).collect()}
    assert set(whole) == {"a", "b"} and whole["a"].listing_id == 3 and whole["a"].max_input_tokens == "10" and whole["a"].max_input_tokens_from == 2
    assert whole["b"].listing_id == 4 and whole["b"].usable_fields == 3 and whole["b"].max_input_tokens_from == 5


def test_empty(spark):
    assert surviving_fields(*frames(spark, [], [])).count() == 0
    assert surviving_records(*frames(spark, [], AUTHORITY)).count() == 0


def test_prices(spark):
    good = {"0.5": 0.5, " $0.5 ": 0.5, "USD 2.5E-06": 2.5e-6, "0.1 USD": 0.1, "0e0": 0.0, ".5": 0.5, "5.": 5.0, "US$3": 3.0, "1 dollar": 1.0}
    bad = ["-1", "NaN", "null", "", "free", "1.2.3", "€5", "5 EUR", "variable", "Infinity", "0x10", "x" * 10_000, None]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    assert {r.t: r.p for r in df.select("t", dollar_price(F.col("t")).alias("p")).collect()} == good | dict.fromkeys(bad)


def test_trust_decides_between_records_that_are_as_complete(spark):
    day = dt.timedelta(days=1)
    data = [
        ("a", 1, "good", T, 9, (8, None)), ("a", 2, "fair", T + day, 9, (8, None)), ("a", 3, "other", T + 2 * day, 9, (8, None)),
        ("b", 4, "good", T, 9, None), ("b", 5, "other", T + day, 9, None), ("b", 6, None, T + 2 * day, 9, None),
        ("c", 7, "good", T, None, None), ("c", 8, "other", T, 9, None), ("d", 9, "good", T, 9, None), ("d", 10, "good", T + day, 9, None),
    ]
    got = {r.model_ref: r.listing_id for r in surviving_records(*frames(spark, data, AUTHORITY), trusted=True).collect()}
    assert got == {"a": 2, "b": 4, "c": 8, "d": 10}
    assert p2_order(spark, data) == got



def test_a_group_without_usable_value_keeps_its_best_record(spark):
    data = [
        ("useless", 1, "other", T, None, None), ("useless", 2, "good", T, 0, (0, "NaN")), ("useless", 2, "good", T, 0, (0, "NaN")),
        ("alone", 3, "good", T, None, None), ("alone", 3, "good", T, 5, None), ("fine", 4, "good", T, 5, None), ("fine", 5, "good", T, None, None),
        (None, 6, "good", T, 1, None), (None, 7, "good", T, 1, None), ("keyless", 8, "good", T, 1, None), ("keyless", None, "good", T, 1, None),
    ]
    found = surviving_records(*frames(spark, data, AUTHORITY), trusted=True, every_group=True).collect()
    got = {r.model_ref: (r.listing_id, r.usable_fields, r.max_input_tokens, r.max_input_tokens_from, r.openrouter_prompt) for r in found}
    assert len(found) == 2 and got == {"useless": (2, 0, None, None, None), "fine": (4, 1, "5", 4, None)}


def p2_order(spark, data):
    """The same by sorting: most usable fields, priorities with 99 for unlisted, latest, smallest key."""
    fields = ("max_input_tokens", "openrouter.context_length", "openrouter.prompt")
    rank = lambda s: sum(min((p for f, of, p in AUTHORITY if (f, of) == (name, s)), default=99) for name in fields)
    usable = lambda r: (r[4] is not None) + (r[5] is not None and r[5][0] is not None)
    best = {}
    for r in sorted(data, key=lambda r: (-usable(r), rank(r[2]), -r[3].timestamp(), r[1])):
        best.setdefault(r[0], r[1])
    return best
