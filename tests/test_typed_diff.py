from pyspark.sql import functions as F

from ledgerloom.operators.diff import change_rows
from ledgerloom.operators.ranking import fact_by_evidence
from ledgerloom.operators.typed_diff import AUTHOR_PATHS, MODEL_PATHS, PROVIDER_PATHS, typed_changes

FLAG = "struct<value:boolean,state:tinyint>"
LIMIT = "struct<value:bigint,state:tinyint>"
MODEL = (
    f"id string, name string, description struct<value:string,state:tinyint>, features struct<tools:{FLAG},streaming:{FLAG},modalities:struct<input:array<string>>>, "
    f"limits struct<context_window:{LIMIT}>, metadata struct<tags:array<string>,release_date:date>, modes map<string,map<string,int>>, lineage struct<family:string>, extra int"
)


def test_models(spark, rows):
    none = (None,) * 7
    known, false, unknown, missing = (True, 2), (False, 2), (None, 1), (None, 0)
    old = [
        ("same", "n", ("d", 2), (known, missing, (["text"],)), ((10, 2),), (["a"], None), {"x": {"a": 1, "b": 2}}, None, 1), ("gone", *none, 1),
        ("m", "old", None, (unknown, missing, (None,)), ((8000, 2),), (["a"], None), {"x": {"a": 1}}, ("f",), 1), ("s", "n", ("", 2), None, None, None, None, None, 1),
    ]
    new = [
        ("same", "n", ("d", 2), (known, None, (["text"],)), ((10, 2),), (["a"], None), {"x": {"b": 2, "a": 1}}, None, 2), ("fresh", *none, 1),
        ("m", "new", (None, 1), (false, missing, (["text", "image"],)), ((2_000_000, 2),), (["a", "b"], None), {}, None, 1), ("s", "n", ("", 2), (known, known, None), None, ([], None), None, None, 1),
    ]
    found = typed_changes(spark.createDataFrame(old, MODEL), spark.createDataFrame(new, MODEL), ["id"], MODEL_PATHS)
    assert rows(change_rows(found, ["id"])) == sorted([
        ("fresh", "added", None, None, None), ("gone", "removed", None, None, None), ("m", "updated", "description", "missing", "unknown"), ("m", "updated", "features.modalities.input", "", "text,image"),
        ("m", "updated", "features.tools", "unknown", "false"), ("m", "updated", "limits.context_window", "8.0K", "2.0M"), ("m", "updated", "lineage", "present", "absent"),
        ("m", "updated", "metadata.tags", "1 tags", "2 tags"), ("m", "updated", "modes", "1 modes", "0 modes"), ("m", "updated", "name", "old", "new"),
        ("s", "updated", "features", "false", "true"), ("s", "updated", "metadata", "false", "true"),
    ], key=repr)
    ordered = {r.id: [c.path for c in r.changes] for r in found.collect()}
    assert ordered["m"] == ["name", "description", "features.tools", "features.modalities.input", "lineage", "modes", "limits.context_window", "metadata.tags"]
    shallow = typed_changes(spark.createDataFrame(old, MODEL), spark.createDataFrame(new, MODEL), ["id"], MODEL_PATHS, deep=False, ignored=["name"])
    assert rows(change_rows(shallow, ["id"]).where("path is not null").select("id", "path")) == [("m", "description")]
    assert typed_changes(spark.createDataFrame(old, MODEL), spark.createDataFrame(old, MODEL), ["id"], MODEL_PATHS).isEmpty()
    assert typed_changes(spark.createDataFrame([], MODEL), spark.createDataFrame([], MODEL), ["id"], MODEL_PATHS).isEmpty()


def test_providers_and_authors(spark, rows):
    schema = "id string, name string, aliases array<string>, headquarters string, catalog struct<url:string>, privacy_policy struct<url:string>, extensions map<string,string>"
    old = spark.createDataFrame([("p", "P", ["a"], None, ("u",), None, {"s": "1"})], schema)
    new = spark.createDataFrame([("p", "P", ["a", "b"], "", ("v",), ("w",), {"s": "2", "t": "3"})], schema)
    assert rows(change_rows(typed_changes(old, new, ["id"], PROVIDER_PATHS), ["id"]).select("path", "old", "new")) == sorted([
        ("aliases", "1 aliases", "2 aliases"), ("catalog", "settings changed", "updated"), ("extensions", "1 sources", "2 sources"), ("headquarters", "", ""), ("privacy_policy", "absent", "present"),
    ])
    schema = "id string, name string, website string, description string"
    old = spark.createDataFrame([("a", "A", None, "x" * 60), ("b", "B", None, None)], schema)
    new = spark.createDataFrame([("a", "A", "", "y"), ("b", "B", "w", "")], schema)
    assert rows(change_rows(typed_changes(old, new, ["id"], AUTHOR_PATHS), ["id"]).select("id", "path", "old", "new")) == [("a", "description", "x" * 47 + "...", "y"), ("b", "website", "", "w")]


def test_facts_by_evidence(spark, rows):
    data = [
        ("a", "x", "p", True, 0.5, 1), ("a", "y", "q", True, 0.5, 2), ("a", "z", "r", False, 1.0, 9), ("b", "x", "q", True, 1.0, 1), ("b", "w", "p", True, 1.0, 1), ("b", None, "a", True, 2.0, 5),
        ("c", "v", "q", None, None, None), ("c", "v", "p", None, None, None), ("d", None, "p", True, 1.0, 1),
    ]
    df = spark.createDataFrame(data, "k string, v string, p string, has boolean, authority double, at int")
    evidence = {"has_evidence": F.col("has"), "authority": F.col("authority"), "observed_at": F.col("at")}
    assert rows(fact_by_evidence(df, ["k"], evidence, "v", "p")) == [("a", "y", "q", True, "y"), ("b", None, "p", False, "w"), ("c", "v", "p", True, "v")]
