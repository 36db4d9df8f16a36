"""Helpers shared by the operators: tables, bounded sides, durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def bounded_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is proven to hold at most `most` rows, else as it is.

    The proof is one job that stops after ``most + 1`` rows, so it never reads a large table whole.
    Without the hint the planner joins by shuffle, which is right at any size.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_rows(df: DataFrame, most: int) -> list:
    """The rows of a reference table that must be small; raises when it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a reference table has more than {most} rows")
    return rows


def _named_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a new folder of this machine only where that is unset in a local session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint(), whose files every executor can read again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_named_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: A scan above so many bytes on disk is left where it is.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan with too few partitions to keep the cores busy, dealt out to as many as there are cores.

    For inputs of work that is heavy for each row.  Only a scan of at most `SPREAD_BYTES` is moved; a
    larger one is split by ``spark.sql.files.maxPartitionBytes`` where it is read.
    """
    if not hasattr(df, "_jdf"):  # a remote session doesn't tell
        return df
    cores, run = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if int(run.optimizedPlan().stats().sizeInBytes()) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the one of `_named_folder`."""
    named = _named_folder(spark)
    if "://" in named and not named.startswith("file://"):
        raise ValueError(f"{named} is no folder that files can be written to without Spark")
    path = os.path.join(named.removeprefix("file://"), f"ledgerloom-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def shared_uri(spark: SparkSession) -> str:
    """A URI below the folder of `_named_folder` that nothing has used yet, on whatever file system that is."""
    named = _named_folder(spark).rstrip("/")
    return f"{named if '://' in named else file_uri(named)}/ledgerloom-{uuid.uuid4().hex}"


def file_uri(path: object) -> str:
    """The URI of a POSIX path, so that Spark looks for it where Python does, whatever its default file system."""
    return "file://" + os.path.abspath(os.fspath(path))


def all_of(*conditions: Column) -> Column:
    result = F.lit(True)
    for c in conditions:
        result = result & c
    return result


def slices_for(rows: Column, rows_per_slice: int) -> Column:
    """Number of hash slices, a power of two, that keeps each slice near `rows_per_slice` rows."""
    return F.when(rows <= rows_per_slice, F.lit(1)).otherwise(
        F.pow(F.lit(2.0), F.ceil(F.log2(rows / F.lit(float(rows_per_slice))))).cast("int")
    )
