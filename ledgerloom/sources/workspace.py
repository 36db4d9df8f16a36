"""Workspaces of YAML files: index files, model files below their owner, binary logos."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVIDER = "id string, aliases array<string>, name string, description string, docs_url string, headquarters string, icon_url string, status_page_url string"
AUTHOR = "id string, aliases array<string>, name string, description string, headquarters string, icon_url string, website string, huggingface string, github string, twitter string"
MODEL = (
    "id string, model string, name string, description string, status string, authors array<struct<id:string,name:string>>, "
    "metadata struct<release_date:string,knowledge_cutoff:string,open_weights:boolean,tags:array<string>>, lineage struct<family:string,root:string,parent:string>, "
    "features struct<modalities:struct<input:array<string>,output:array<string>>,tool_calls:boolean,tools:boolean,reasoning:boolean,streaming:boolean,temperature:boolean>, "
    "limits struct<context_window:bigint,input_tokens:bigint,output_tokens:bigint>, "
    "pricing struct<currency:string,tokens:struct<input:struct<per_token:double,per_1m:double>,output:struct<per_token:double,per_1m:double>>>"
)


@dataclass
class Workspace:
    """The relations of a workspace; `rejected` has (path, problem) of files and records that couldn't be read."""

    providers: DataFrame
    authors: DataFrame
    provider_models: DataFrame
    author_models: DataFrame
    logos: DataFrame
    rejected: DataFrame


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def read_yaml(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, place, record, problem): the records of all YAML files below `path` whose name fits, as JSON text.

    A file with a list has a record for each element, any other file one.  A file that can't be read
    has a row with the problem.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = yaml.load(content, loader)  # noqa: S506
                    records = value if isinstance(value, list) else [] if value is None else [value]
                    rows += [(name, i, json.dumps(_plain(r)), None) for i, r in enumerate(records)]
                except (yaml.YAMLError, UnicodeDecodeError, ValueError) as problem:
                    rows.append((name, None, None, str(problem)[:500]))
            types = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "place", "record", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(parse, "path string, place int, record string, problem string")


def typed(records: DataFrame, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(typed records with their path, rejected (path, problem)): a record outside the schema or without an id is rejected."""
    schema = T.StructType.fromDDL(ddl)
    wire = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    row = F.from_json("record", wire, {"columnNameOfCorruptRecord": "_corrupt"})
    tried = records.withColumn("_row", row)
    problem = F.coalesce("problem", F.when(F.col("_row._corrupt").isNotNull(), "schema"), F.when(F.coalesce(F.trim("_row.id"), F.lit("")) == "", "no id"))
    tried = tried.withColumn("problem", problem)
    fine = tried.where("problem is null").select("path", *(F.col(f"_row.`{f.name}`").alias(f.name) for f in schema.fields))
    return fine, tried.where("problem is not null").select("path", "problem")


def read_workspace(spark: SparkSession, root: str, *, most_models: int = 10_000) -> Workspace:
    """All relations of the workspace at `root`; the owner of a model file is a directory in its path.

    At most `most_models` model files of each kind, first by path, are taken; the rest are rejected as
    truncated, so that nothing is lost silently.
    """
    root = root.rstrip("/")
    providers, bad_providers = typed(read_yaml(spark, f"{root}/providers.yaml", "*.yaml"), PROVIDER)
    authors, bad_authors = typed(read_yaml(spark, f"{root}/authors.yaml", "*.yaml"), AUTHOR)
    provider_models, bad_pm = _models(spark, root, "providers", "provider_id", most_models)
    author_models, bad_am = _models(spark, root, "authors", "author_id", most_models)
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "logo.svg").load(root)
    kind, owner = (F.regexp_extract("path", r"/(providers|authors)/([^/]+)/logo\.svg$", i) for i in (1, 2))
    logos = images.select(kind.alias("kind"), owner.alias("id"), "content").where("kind <> ''")
    rejected = bad_providers.unionAll(bad_authors).unionAll(bad_pm).unionAll(bad_am)
    return Workspace(providers, authors, provider_models, author_models, logos, rejected)


def _models(spark: SparkSession, root: str, kind: str, owner: str, most: int) -> tuple[DataFrame, DataFrame]:
    records = read_yaml(spark, f"{root}/{kind}", "*.yaml").where(F.col("path").rlike(rf"/{kind}/[^/]+/models/"))
    last = records.select("path").distinct().orderBy("path").offset(most).limit(1).collect()  # one row
    cut = F.lit(None).cast("string") if not last else F.when(F.col("path") >= last[0][0], "truncated")
    models, rejected = typed(records.withColumn("problem", F.coalesce("problem", cut)), MODEL)
    return models.select(F.regexp_extract("path", rf"/{kind}/([^/]+)/models/", 1).alias(owner), *[c for c in models.columns if c != "path"]), rejected


PROVENANCE = "source string, field string, value string, observed_at string, authority double, reason string"


def read_provenance(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected) of a provenance file, a YAML map from a resource to its list of entries: (resource, place, the members of an entry)."""
    records = read_yaml(spark, path, "*.yaml")
    entries = records.where("problem is null").select(F.explode(F.from_json("record", f"map<string,array<struct<{', '.join(c.replace(' ', ':') for c in PROVENANCE.split(', '))}>>>")).alias("resource", "_l"))
    long = entries.select("resource", F.posexplode("_l").alias("place", "_e")).select("resource", "place", "_e.*")
    return long, records.where("problem is not null").select("path", "problem")


def write_provenance(entries: DataFrame, path: str, *, most: int = 100_000) -> int:
    """Write (resource, place, ...) as a provenance file and return the number of resources; for catalogs of bounded size."""
    import yaml

    from ..common import bounded_rows

    kept: dict[str, list] = {}
    for row in bounded_rows(entries.orderBy("resource", "place"), most):
        told = {k: v for k, v in row.asDict().items() if k not in ("resource", "place") and v is not None}
        kept.setdefault(row.resource, []).append(told)
    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(kept, file, sort_keys=True, allow_unicode=True)
    return len(kept)


class Dirty(RuntimeError):
    """The workspace holds changes that no generation has written."""


def materialise(relations: dict[str, DataFrame], root: str, generation_id: str, *, read: Callable[[str], dict[str, DataFrame]], most: int = 10_000) -> bool:
    """Write a generation's relations as index files of the workspace; False if it holds them already.

    A state file says which generation was written last and what came of it.  The workspace is only
    overwritten where `read`, which gives its relations, still finds just that; so what somebody has edited
    is never lost.  The state is written before the files: a crash in between leaves a workspace that holds
    the last state or the next one, relation by relation, and is written again.
    """
    import os

    import yaml

    from ..common import bounded_rows
    from ..snapshots import checksum

    wanted = {n: checksum(df)[0] for n, df in relations.items()}
    path = os.path.join(root, ".state.json")
    kept: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        held = {n: checksum(df)[0] for n, df in read(root).items() if n in wanted}
        last = [kept.get("before", {}), kept["now"]]
        edited = [n for n, s in held.items() if s not in [state.get(n) for state in last]]
        if edited:
            raise Dirty(f"changed since {kept['generation_id']}: {', '.join(sorted(edited))}")
        if held.items() <= wanted.items() and kept["now"] == wanted and kept["generation_id"] == generation_id:
            return False
    os.makedirs(root, exist_ok=True)
    for name, text in ((".state.json", json.dumps({"generation_id": generation_id, "before": kept.get("now", {}), "now": wanted})), *(
        (f"{n}.yaml", yaml.safe_dump([_plain({k: v for k, v in r.asDict(recursive=True).items() if v is not None}) for r in bounded_rows(df.orderBy("id"), most)], sort_keys=False, allow_unicode=True)) for n, df in relations.items()
    )):
        part = os.path.join(root, f".{name}.part")
        with open(part, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(part, os.path.join(root, name))
    return True


def write_yaml(df: DataFrame, path: str, key: str, *, most: int = 10_000) -> int:
    """Write one YAML file for each row below a directory, named by `key`; returns their number. For small relations."""
    import os

    import yaml

    from ..common import bounded_rows

    rows = bounded_rows(df, most)
    for row in rows:
        name = os.path.join(path, *str(row[key]).split("/")) + ".yaml"
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "w", encoding="utf-8") as file:
            yaml.safe_dump(json.loads(json.dumps(row.asDict(recursive=True), default=str)), file, sort_keys=False, allow_unicode=True)
    return len(rows)
