import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.authority import Policy, filled_struct, flags_merged, reattributed, without_blank_projections, without_stale
from ledgerloom.operators.projections import architecture, default_parameters, detail, lifecycle, offering_endpoints, operations, supported_parameters
from ledgerloom.sources.converters import CONVERTERS, anthropic_models, google_models, openai_models, upstream_models

P = Policy("model", "x", ("first", "second"))


def records(spark, *values):
    return spark.createDataFrame([("p", v if v is None or isinstance(v, str) else json.dumps(v)) for v in values], "provider_id string, record string")


def test_openai(spark):
    found = openai_models(records(spark, {"id": "org/m", "max_model_len": "4096", "max_completion_tokens": 10.0, "created": 5, "input_modalities": ["Text", "smell"], "supports_tools": True, "capabilities": {"effort": True}},
        {"id": "n", "owned_by": " ", "context_window": "long", "context_length": 7, "capabilities": {"effort": {"supported": False}, "batch": {"supported": True}}}, {"id": " "}, {"object": "model"}, "{", None)).orderBy("id").collect()
    assert [(r.id, r.owner, r.created, r.context_window, r.output_tokens, r.input_modalities, r.capabilities) for r in found] == [
        ("n", None, None, 7, None, None, ["batch"]), ("org/m", "org", 5, 4096, 10, ["text"], ["tools", "effort"]),
    ]


def test_anthropic_and_google(spark):
    a = anthropic_models(records(spark, {"id": "c", "display_name": "C", "created_at": "2025-01-01T00:00:00Z", "max_input_tokens": 9, "capabilities": {"image_input": {"supported": True}, "effort": {"supported": True, "max": {"supported": True}, "low": {"supported": False}}}})).first()
    assert (a.id, a.created, a.context_window, a.input_modalities, a.capabilities) == ("c", 1735689600, 9, ["text", "image"], ["effort", "effort:maximum"])
    g = google_models(records(spark, {"name": "publishers/acme/models/x", "inputTokenLimit": 3, "supportedGenerationMethods": ["embedContent"], "thinking": True, "temperature": 0}, {"name": "models/y"})).orderBy("id").collect()
    assert [(r.id, r.owner, r.context_window, r.capabilities) for r in g] == [("x", "acme", 3, ["embedding", "temperature", "reasoning"]), ("y", "google", None, [])]
    assert set(CONVERTERS) == {"openai", "anthropic", "google", "vertex"}


def test_upstream_index(spark):
    index = {"pp": {"models": {"m": {"name": "M", "status": " Beta ", "limit": {"context": 5}, "tags": [" a ", ""], "reasoning": True, "reasoning_options": [{"type": "budget"}, {"type": "effort", "values": ["minimal", "odd", "MAX"]}]}}}, "zz": {"models": {"n": {"id": "other"}}}, "none": {}}
    payloads = spark.createDataFrame([(json.dumps(index),), ("{",)], "p string")
    found = {r.id: r for r in upstream_models(payloads, "p").collect()}
    assert set(found) == {"m", "other"} and found["m"].status == "beta" and found["m"].effort_levels == ["minimum", "maximum"] and found["m"].tags == ["a"] and found["m"].capabilities == ["reasoning"]
    aliases = spark.createDataFrame([("pp", "p"), ("zz", None)], "alias string, target string")
    assert [(r.provider_id, r.id) for r in upstream_models(payloads, "p", aliases).collect()] == [("p", "m")]


def test_projections(spark):
    text = F.array(F.lit("pdf"), F.lit("image"), F.lit("text"))
    row = spark.range(1).select(
        architecture(text, F.array(F.lit("text")), F.lit(None).cast("string")).alias("a"), supported_parameters({"tools": F.lit(True), "seed": F.lit(False)}), default_parameters({"top_p": F.lit(0.5), "top_k": F.lit(None)}),
        default_parameters({"top_k": F.lit(None)}), operations(text, F.array(F.lit("text")), F.lit(None).cast("array<string>")), operations(text, F.array(F.lit("embedding")), F.array()), operations(text, F.array(F.lit("text")), F.array(F.lit("tts"))), lifecycle(F.lit("beta")),
    ).first()
    assert row.a.modality == "text+image+file->text" and row.a.tokenizer == "Other" and tuple(row)[1:] == (["tools"], {"top_p": 0.5}, None, ["chat_completions"], ["embeddings"], [], "preview")
    with pytest.raises(Exception, match="unknown status"):
        spark.range(1).select(lifecycle(F.lit("odd"))).collect()


def test_endpoints_and_details(spark, rows):
    offers = spark.createDataFrame([("p", "m", "o", ["chat", "none"]), ("p", "n", "x", ["chat"])], "provider_id string, id string, owner string, ops array<string>")
    endpoints = spark.createDataFrame([("p", "chat", "u/{model}", {"o": "own/{model}"})], "provider_id string, operation string, base_url string, by_owner map<string,string>")
    assert rows(offering_endpoints(offers, ["provider_id", "id"], "ops", endpoints, "owner", "id")) == [("p", "m", "chat", "own/m"), ("p", "n", "chat", "u/n")]
    definitions, priced = spark.createDataFrame([("d",), ("e",)], "d string"), spark.createDataFrame([("d", "p", 5), ("d", "q", 9)], "d string, provider_id string, ctx int")
    assert rows(detail(definitions, priced, "d", priced.where("ctx = 5"), "ctx")) == [("d", 9, 2, "p"), ("e", 0, 0, None)]


def test_struct_and_flag_merges(spark):
    df = spark.createDataFrame([("k", "second", (5, None, ["b"]), {"a": True, "b": True}), ("k", "first", (0, "x", ["c", "b"]), {"a": False})], "k string, source string, v struct<n:int,s:string,t:array<string>>, flags map<string,boolean>")
    assert filled_struct(df, ["k"], "source", P, "v", lists=["t"]).first().v.asDict() == {"n": 5, "s": "x", "t": ["c", "b"]}
    assert flags_merged(df, ["k"], "source", P, "flags").first().flags == {"a": False, "b": True}
    blank = spark.createDataFrame([("local", {"a": False}), ("other", {"a": False}), ("local", {"a": True})], "source string, flags map<string,boolean>")
    assert [r.flags for r in without_blank_projections(blank, "source", "local", "flags", F.lit(False)).collect()] == [None, {"a": False}, {"a": True}]
    assert [r.v for r in without_stale(spark.createDataFrame([(1, True), (2, False)], "v int, s boolean"), "v", F.col("s"), F.lit(True)).collect()] == [None, 2]


def test_reattribution(spark, rows):
    df = spark.createDataFrame([("k", "local", 5), ("j", "local", 6), ("k", "other", 5)], "k string, source string, v int")
    told = spark.createDataFrame([("k", "first", 5), ("j", "first", 7)], "k string, source string, v int")
    assert rows(reattributed(df, ["k"], "source", "v", "local", told)) == [("j", "local", 6), ("k", "first", 5), ("k", "other", 5)]
