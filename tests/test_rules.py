from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import invariants as I
from ledgerloom.operators.filters import matches_capability
from ledgerloom.operators.lookup import attributed_owners, unique_owner
from ledgerloom.operators.projections import defaults_of, operations, parameters_of, reasoning_view
from ledgerloom.operators.setops import appended, first_filled
from ledgerloom.sources.payloads import oversized, strict_problems


def none():
    return F.lit(None)


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def texts(*values):
    return F.array(*(F.lit(v).cast("string") for v in values))


def test_scalars_with_nothing_in_them(spark):
    no = none().cast("array<string>")
    options = none().cast("array<struct<type:string,values:array<string>,min:bigint,max:bigint>>")
    assert one(spark, S.effort_levels(options), S.token_range(options), S.shown_effort(none().cast("string")), S.flags_of(no, S.FEATURE_FLAGS), S.feature_label(no, no, {})) == (None, None, None, [], "")
    assert one(spark, S.modalities_by_tags(no, no, no)["input"], S.modalities_by_tags(no, texts("text"), texts(None, "x"))["output"], S.modalities_by_tags(no, no, texts("TTS", "embed"))) == (None, ["text"], (["text"], ["embedding"]))
    assert one(spark, S.normal_path(none().cast("string")), S.is_enrichment(F.lit("limitsX")), S.covers(F.lit("Limits"), F.lit("limits.output")), S.covers(F.lit("limits.output"), F.lit("limits")), S.covers(F.lit("limit"), F.lit("limits"))) == (None, True, True, True, False)


def test_projections_with_nothing_in_them(spark):
    flags, told = none().cast("map<string,boolean>"), none().cast("map<string,double>")
    assert one(spark, parameters_of(flags), defaults_of(told), reasoning_view(none().cast("boolean"), none().cast("array<string>"), none().cast("string"))) == ([], None, None)
    assert tuple(one(spark, reasoning_view(F.lit(True), none().cast("array<string>"), F.lit("low")))[0]) == (True, False, [], None)
    assert one(spark, matches_capability("vision", {}, none().cast("array<string>")), matches_capability("tools", {"tools": none().cast("boolean")}, texts("image")), matches_capability("image", {}, texts("image"))) == (False, False, True)
    assert one(spark, operations(texts("text"), texts("text"), texts("embed")), operations(texts("text"), texts("text"), texts("rerank")), operations(texts("text"), texts("text"), texts("chat"))) == (["embeddings"], [], ["chat_completions"])


def test_invariants_with_nothing_in_them(spark, rows):
    no = none().cast("array<string>")
    fine = I.fact_rules(created=none().cast("int"), updated=F.lit(1), reasons=none().cast("boolean"), controls=[none().cast("boolean")], tags=texts("embed"), inputs=no, outputs=no)
    assert one(spark, S.violations(fine)) == ([],)
    broken = I.fact_rules(created=F.lit(2), updated=F.lit(1), reasons=none().cast("boolean"), controls=[F.lit(True)], tags=texts("EMBED", None), inputs=texts("text"), outputs=no)
    assert one(spark, S.violations(broken)) == (["timestamps", "reasoning", "embedding output"],)
    offering = I.offering_rules(provider=none().cast("string"), model=F.lit(" "), definition=F.lit("d"), availability=none().cast("string"), lifecycle=F.lit("active"), regions=no, operations=no, endpoints=texts("embeddings"))
    assert one(spark, S.violations(offering)) == (["provider_id", "provider_model_id", "availability", "endpoints"],)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, ref string")
    assert rows(I.dangling(df, ["k"], "ref", spark.createDataFrame([("a",), (None,)], "t string"), "t")) == [(3, "b")]
    assert I.dangling(df.limit(0), ["k"], "ref", df, "ref").isEmpty() and I.out_of_order(df.limit(0), ["ref"], "k", ["k"]).isEmpty()


def test_strict_envelopes(spark, rows):
    data = [(1, '{"a": 1, "version": 2}'), (2, '{"a": 1, "version": 3}'), (3, '{"a": 1, "z": 2, "b": 3, "version": 2}'), (4, "[1]"), (5, "{"), (6, "1, 2"), (7, " "), (8, None), (9, '{"a": 1}')]
    df = spark.createDataFrame(data, "k int, t string")
    assert rows(strict_problems(df, "k", "t", ["a", "version"], version=2)) == [(2, "version"), (3, "unknown: b"), (4, "no object"), (5, "syntax"), (6, "trailing"), (7, "missing"), (8, "missing"), (9, "version")]
    assert (9, "version") not in rows(strict_problems(df, "k", "t", ["a", "version"])) and strict_problems(df.limit(0), "k", "t", []).isEmpty()


def test_depth_of_payloads(spark, rows):
    deep = "[" * 70 + "]" * 70
    data = [(1, deep), (2, '{"a": "' + "[" * 70 + '"}'), (3, '{"a": "\\\\\\"[[["}'), (4, "[" * 64 + "]" * 64), (5, '"' + "{" * 100), (6, "x" * 50)]
    assert rows(oversized(spark.createDataFrame(data, "k int, t string"), "k", "t", most_bytes=10_000)) == [(1, "depth"), (5, "syntax"), (6, "syntax")]


def test_owner_sets(spark, rows):
    models = spark.createDataFrame([("p", "Org/A"), ("q", "org/a.b"), (None, "org/a"), ("p", None), ("p", "Org/A")], "provider string, id string")
    rules = [("all", None, "ORG/*"), ("all", None, "org/a"), ("mine", "p", None), ("theirs", "q", "org/a?b"), ("blank", "", None), (None, "p", None), ("odd", None, "org/a(b")]
    patterns = spark.createDataFrame(rules, "owner string, provider string, pattern string")
    found = attributed_owners(models, "provider", "id", patterns)
    assert rows(found) == sorted([("p", "Org/A", ["all", "mine"])] * 2 + [("q", "org/a.b", ["all", "theirs"]), (None, "org/a", ["all"]), ("p", None, [])], key=repr)
    assert {tuple(r.owners) for r in attributed_owners(models, "provider", "id", patterns.limit(0)).collect()} == {()}
    pairs = spark.createDataFrame([("m", "p"), ("m", "q"), ("n", "p"), ("n", "p"), ("o", None)], "id string, provider string")
    assert rows(unique_owner(pairs, "id", "provider")) == [("m", None, ["p", "q"]), ("n", "p", ["p"])]


def test_appended_and_first_filled(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1,)], "k int")
    assert rows(appended(a, b)) == sorted([(1, "x"), (1, None)], key=repr) and rows(first_filled(a.limit(0), b.limit(0), a)) == [(1, "x")] and first_filled(a.limit(0)).isEmpty()
