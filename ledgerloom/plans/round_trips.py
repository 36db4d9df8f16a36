"""Queries that go through stores, sources and streams: what comes back must be what went in."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import bounded_rows, file_uri, shared_folder, shared_uri, table
from ..engine import Engine
from ..snapshots import GenerationStore
from ..sources.listings import register
from ..sources.workspace import read_workspace
from ..streaming.publications import decisions
from .catalog_queries import _MODELS, SQL as CATALOG_SQL, _publications, models


def generation_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Commit two generations, roll back to the first and read both: what the second has more and what the current one holds."""
    store = GenerationStore(spark, f"{shared_uri(spark)}/store")
    rows = models(spark, sf).select("provider_id", "id", "context_window")
    engine = Engine(store, {"models": rows.where("context_window is not null")}, seed_id="first")
    engine.update("second", lambda _: {"models": rows})
    engine.rollback("first")
    old, new = store.read("models"), store.read("models", "second")
    return old.withColumn("generation", F.lit("current")).unionByName(new.withColumn("generation", F.lit("retained")))


def workspace_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Land the authors as a YAML workspace and read it back."""
    import yaml

    root = os.path.join(shared_folder(spark), "workspace")
    for kind in ("providers", "authors"):
        os.makedirs(os.path.join(root, kind))
        found = bounded_rows(table(spark, sf, kind[:-1]).orderBy("id"), 10_000)
        with open(os.path.join(root, f"{kind}.yaml"), "w", encoding="utf-8") as file:
            yaml.safe_dump([{k: v for k, v in r.asDict().items() if v is not None} for r in found], file)
    read = read_workspace(spark, file_uri(root))
    return read.authors.select("id", "name", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).cast("bigint").alias("aliases"), "website")


def listing_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Land a page for each provider and read them through the data source."""
    root = os.path.join(shared_folder(spark), "listings")
    for r in bounded_rows(table(spark, sf, "provider").select("id", "name"), 10_000):
        os.makedirs(os.path.join(root, r.id))
        with open(os.path.join(root, r.id, "first.json"), "w", encoding="utf-8") as file:
            json.dump({"data": [{"id": f"{r.id}/one", "name": r.name}, {"id": f"{r.id}/two", "name": r.name}]}, file)
    register(spark)
    rows = spark.read.format("catalog_listing").load(root)
    return rows.select("provider_id", "place", F.get_json_object("record", "$.id").alias("id"), F.get_json_object("record", "$.name").alias("name"))


def publication_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The decisions on all publications, made by a streaming query that keeps the active generation as state."""
    root = shared_uri(spark)
    wanted = _publications(spark, sf).withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    wanted.write.parquet(f"{root}/in")
    source = spark.readStream.schema(wanted.schema).parquet(f"{root}/in")
    run = decisions(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream string, sequence bigint, generation_id string, decision string").parquet(f"{root}/out")


QUERIES = {f.__name__: f for f in (generation_round_trip, workspace_round_trip, listing_round_trip, publication_stream)}

SQL = {
    "generation_round_trip": f"with {_MODELS} select provider_id, id, context_window, 'current' generation from models where context_window is not null union all select provider_id, id, context_window, 'retained' from models",
    "workspace_round_trip": "select id, name, coalesce(len(aliases), 0) aliases, website from author",
    "listing_round_trip": "select id provider_id, n::integer place, id || case n when 0 then '/one' else '/two' end id, name from provider, range(2) t(n)",
    "publication_stream": CATALOG_SQL["publication_activate"],
}
