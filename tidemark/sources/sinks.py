"""Filing results: partition overwrite, append, whole overwrite, published views."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package when the driver runs it from a source folder; a cluster gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A session on one machine may name none and gets a temporary one; on a cluster that is refused."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.sharedDir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.sharedDir", known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows, worked out once and written to the shared folder, laid out by some columns if given."""
    path = scratch(df.sparkSession, name)
    if by:
        write_partitions(df, path, by)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def partition_keys(grouping: Sequence[str], partition_by: Sequence[str]) -> list[str]:
    """Group keys, with the partition columns that they lack."""
    return [*grouping, *(c for c in partition_by if c not in grouping)]


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that the result has; a new table is laid out by the result's own schema.

    Rows are brought together by partition, and a partition with many of them is split over tasks."""
    if missing := [c for c in by if c not in df.columns]:
        raise ValueError(f"the result lacks partition columns {', '.join(missing)}")
    df.hint("rebalance", *by).write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)


def write_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_whole(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, name: str) -> DataFrame:
    """Make a result readable by name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
