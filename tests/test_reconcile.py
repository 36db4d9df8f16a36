import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.authority import Policy
from ledgerloom.operators.reconcile import reconcile

T = dt.datetime(2026, 1, 1)
NOW = dt.datetime(2026, 6, 1)
SCHEMA = (
    "provider_id string, id string, source string, at int, name string, description string, authors array<string>, limits struct<context_window:bigint,output:bigint>, "
    "features map<string,boolean>, modes map<string,struct<price:double,header:string>>, extensions map<string,map<string,string>>, created_at timestamp_ntz, updated_at timestamp_ntz, junk int"
)


def row(source, at=1, **values):
    names = ("name", "description", "authors", "limits", "features", "modes", "extensions", "created_at", "updated_at")
    assert set(values) <= {*names, "provider_id", "id"}
    return (values.get("provider_id", "p"), values.get("id", "m"), source, at, *(values.get(n) for n in names), 7)


def merged(spark, observed, **options):
    return reconcile(spark.createDataFrame(observed, SCHEMA), "model", ["provider_id", "id"], "source", seen=[F.col("at")], now=F.lit(NOW), **options)


def test_each_policy_by_its_kind(spark):
    observed = [
        row("providers", name=" ", description="", authors=["b", "a"], limits=(10, None), features={"tools": False, "vision": None}, modes={"fast": (None, "h")}, extensions={"x": {"a": "local no", "b": "p"}}),
        row("providers", at=0, name="older"), row("providers", at=0, name="older"),
        row("models_dev_http", name="Upstream", description="text", authors=["a", "c", None], limits=(99, 5), features={"tools": True, "vision": True}, modes={"fast": (1.0, "g"), "slow": (2.0, None)}, extensions={"x": {"a": "up", "c": "u"}}),
        row("local_catalog", extensions={"x": {"a": "mine"}, "y": {"q": "r"}}), row("stranger", name="Nobody"), (None, "m", "providers", 1, *[None] * 10), ("p", "m", None, 1, *[None] * 10),
    ]
    result = merged(spark, observed)
    [got] = result.rows.collect()
    assert (got.name, got.description, got.authors) == ("Upstream", "text", ["a", "c", "b"])
    assert tuple(got.limits) == (10, 5) and got.features == {"tools": False, "vision": True}
    assert {k: tuple(v) for k, v in got.modes.items()} == {"fast": (1.0, "h"), "slow": (2.0, None)}
    assert got.extensions == {"x": {"a": "mine", "b": "p", "c": "u"}, "y": {"q": "r"}}
    assert (got.created_at, got.updated_at) == (NOW, NOW) and "junk" not in result.rows.columns
    told = {r.field: (r.source, r.authority) for r in result.provenance.collect()}
    assert told["name"] == ("models_dev_http", pytest.approx(5 / 6)) and told["limits"][0] == "providers" and told["authors"][0] == "models_dev_http" and told["extensions"] == ("local_catalog", 1.0)
    assert {r.field: r.value for r in result.provenance.collect()}["description"] == "text" and result.changes is None


def test_description_is_authoritative_where_it_is_stated(spark):
    """An empty description is a claim of its own; an absent one leaves the field to the next source."""
    result = merged(spark, [row("models_dev_http", description=""), row("providers", description="kept out"), row("providers", id="n", description="next"), row("models_dev_http", id="n")])
    assert {r.id: r.description for r in result.rows.collect()} == {"m": "", "n": "next"}


def test_baseline_stays_and_changes_are_told(spark, rows):
    shape = "provider_id string, id string, name string, limits struct<context_window:bigint,output:bigint>, created_at timestamp_ntz, updated_at timestamp_ntz"
    baseline = spark.createDataFrame([("p", "gone", "Old", (1, 1), T, T), ("p", "same", "Same", (2, None), T, T), ("p", "m", "Was", (3, 3), T, T)], shape)
    observed = [row("providers", name="Is"), row("providers", id="same", name="Same"), row("providers", id="new", name="New", created_at=T + dt.timedelta(5), updated_at=T + dt.timedelta(2))]
    data = spark.createDataFrame(observed, SCHEMA).select("provider_id", "id", "source", "at", "name", "limits", "created_at", "updated_at")
    result = reconcile(data, "model", ["provider_id", "id"], "source", seen=[F.col("at")], baseline=baseline, now=F.lit(NOW))
    got = {r.id: (r.name, r.limits and tuple(r.limits), r.created_at, r.updated_at) for r in result.rows.collect()}
    assert got == {
        "gone": ("Old", (1, 1), T, T), "same": ("Same", (2, None), T, T), "m": ("Is", (3, 3), T, NOW), "new": ("New", None, T + dt.timedelta(2), T + dt.timedelta(5)),
    }
    assert rows(result.changes.select("id", "change_type")) == [("m", "updated"), ("new", "added")]
    nothing = reconcile(data.limit(0), "model", ["provider_id", "id"], "source", baseline=baseline, now=F.lit(NOW))
    assert nothing.rows.count() == 3 and nothing.changes.isEmpty() and nothing.provenance.isEmpty()


def test_providers_of_the_primary_and_specific_policies(spark, rows):
    schema = "id string, source string, name string, aliases array<string>, privacy_policy struct<url:string,retains:boolean>"
    data = [("a", "providers", "A", ["x"], ("u", None)), ("a", "local_catalog", "mine", ["y", "x"], (None, False)), ("b", "models_dev_http", "B", ["old-b"], None), ("c", "models_dev_http", "C", None, None)]
    observed, primary = spark.createDataFrame(data, schema), spark.createDataFrame([("a",), ("old-b",)], "id string")
    result = reconcile(observed, "provider", ["id"], "source", primary=primary, aliases="aliases")
    assert rows(result.rows.select("id", "name", "aliases", "privacy_policy.url", "privacy_policy.retains")) == [("a", "A", ["y", "x"], "u", False), ("b", "B", ["old-b"], None, None)]
    assert rows(reconcile(observed, "provider", ["id"], "source", primary=primary).rows.select("id")) == [("a",)]
    mine = [Policy("provider", "name", ("local_catalog", "providers"))]
    assert rows(reconcile(observed, "provider", ["id"], "source", policies=mine).rows) == [("a", "mine"), ("b", None), ("c", None)]
