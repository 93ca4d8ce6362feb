"""Tables filed by day: the days that there are, from the names of their folders, and reading some days alone.

Neither opens a file of another day nor lists one, however long the history is; the folders are the index, so it is never
stale."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Fixed value: the folder name of a null partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def folder(column: str, value: datetime.date | int | None) -> str:
    """The folder of a partition."""
    return f"{column}={NULL_FOLDER if value is None else value}"


def filed_days(spark: SparkSession, path: str, day: str = "as_of_date") -> list[datetime.date]:
    """Days that a table has, in order; rows without a day are no day."""
    names = (n.removeprefix(f"{day}=") for n in folders(spark, path) if n.startswith(f"{day}="))
    return sorted(datetime.date.fromisoformat(n) for n in names if n != NULL_FOLDER)


def read_folders(spark: SparkSession, path: str, schema: StructType | str, names: Iterable[str]) -> DataFrame:
    """The rows of some folders of a partitioned table."""
    paths = [f"{path}/{n}" for n in names]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*paths)


@dataclass(frozen=True)
class FiledTable:
    """A table filed by day."""

    spark: SparkSession
    path: str
    schema: StructType | str
    day: str = "as_of_date"

    def days(self) -> list[datetime.date]:
        return filed_days(self.spark, self.path, self.day)

    def read(self, days: Iterable[datetime.date]) -> DataFrame:
        """The rows of some days; files of no other day are looked at, and a day that the table lacks has no rows."""
        here = set(self.days())
        return read_days(self.spark, self.path, self.schema, [d for d in days if d in here], self.day)


def read_days(spark: SparkSession, path: str, schema: StructType | str, days: Iterable[datetime.date], day: str = "as_of_date") -> DataFrame:
    """The rows of some days that the table has."""
    return read_folders(spark, path, schema, [folder(day, d) for d in days])
