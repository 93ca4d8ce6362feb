"""Reading and adapting sources: one day, a trailing range, a load as it was, client names and codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import case_value


@dataclass(frozen=True)
class Binding:
    """Canonical name -> client column, and for some a map of client codes to canonical values."""

    columns: Mapping[str, str]
    values: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def scan_as_of(df: DataFrame, day: date | str) -> DataFrame:
    """One day of a source, filtered before anything else so that it reaches the scan."""
    return df.where(F.col("as_of_date") == F.lit(day).cast("date"))


def scan_trailing(df: DataFrame, days: int, as_of: date | str) -> DataFrame:
    """Days after as_of - days, and none after as_of."""
    end = F.lit(as_of).cast("date")
    return df.where((F.col("as_of_date") > F.date_sub(end, days)) & (F.col("as_of_date") <= end))


def read_snapshot(log: DataFrame, keys: Sequence[str], at=None, load_id=None) -> DataFrame:
    """The rows of an append-only log as they were at a time, or after a load: the latest load of each key until then.

    Loads are in the order of loaded_at, and of load_id where the log has it, so that two loads at one time are told apart.
    A load is found by its id, and one that the log does not have is refused."""
    order = ["loaded_at", *(["load_id"] if "load_id" in log.columns else [])]
    place = F.struct(*order)
    if load_id is not None:
        until = log.where(F.col("load_id") == F.lit(load_id)).agg(F.max(place).alias("p")).first()["p"]
        if until is None:
            raise ValueError(f"the log has no load {load_id}")
        log = log.where(place <= F.struct(*[F.lit(until[c]).cast(log.schema[c].dataType).alias(c) for c in order]))
    else:
        log = log.where(F.col("loaded_at") <= F.lit(at).cast("timestamp"))
    value = F.struct(*[c for c in log.columns if c not in keys])
    return log.groupBy(*keys).agg(F.max_by(value, place).alias("v")).select(*keys, "v.*")


def profile_types(df: DataFrame) -> DataFrame:
    """For each text column DATE, DOUBLE, BOOLEAN or VARCHAR: the kind of which it has at least one value and no other. One pass."""
    kinds = {"DATE": r"^\d{4}-\d{2}-\d{2}$", "DOUBLE": r"^-?\d+(\.\d+)?$", "BOOLEAN": r"^(true|false)$"}
    aggs = [F.count_if(F.col(c) != "").alias(f"{c}|n") for c in df.columns]
    aggs += [F.count_if(F.col(c).rlike(p)).alias(f"{c}|{k}") for c in df.columns for k, p in kinds.items()]
    row = df.agg(*aggs)
    kind = lambda c: case_value([((F.col(f"`{c}|n`") > 0) & (F.col(f"`{c}|{k}`") == F.col(f"`{c}|n`")), F.lit(k)) for k in kinds], F.lit("VARCHAR"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("type"), F.col(f"`{c}|n`").alias("non_empty")) for c in df.columns])).alias("r")).select("r.*")


def load_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with declared types; empty text is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def adapt(df: DataFrame, binding: Binding) -> DataFrame:
    """Client columns under canonical names. A mapped column gets its value from the map alone: an unknown code is null, never passed through."""

    def of(name: str, column: str) -> Column:
        if name not in binding.values:
            return F.col(column).alias(name)
        return case_value([(F.col(column) == F.lit(code), F.lit(v)) for code, v in binding.values[name].items()]).alias(name)

    if missing := [c for c in binding.columns.values() if c not in df.columns]:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    return df.select(*[of(n, c) for n, c in binding.columns.items()])


def vocab_gaps(df: DataFrame, binding: Binding, tested: Mapping[str, Sequence[str]]) -> DataFrame:
    """Gaps of mapped columns: values that rules test and no code produces, and codes in the data with no mapping (with their rows). One pass for all columns."""
    spark, maps = df.sparkSession, binding.values
    unreachable = [(n, "unreachable", v, 0) for n, codes in maps.items() for v in tested.get(n, ()) if v not in codes.values()]
    out = spark.createDataFrame(unreachable, "field string, gap string, value string, records long")
    if not maps:
        return out
    cells = [F.struct(F.lit(n).alias("field"), F.col(binding.columns[n]).cast("string").alias("value")) for n in maps]
    found = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("records"))
    known = spark.createDataFrame([(n, c) for n, codes in maps.items() for c in codes], "field string, value string")
    unmapped = found.join(known, ["field", "value"], "left_anti")
    return out.unionByName(unmapped.select("field", F.lit("unmapped").alias("gap"), "value", "records"))


def binding_issues(columns: Sequence[str], binding: Binding, needed: Sequence[str]) -> list[str]:
    """Needed canonical columns that nothing maps, mapped ones that nothing reads, client columns that are not there."""
    out = [f"{n}: needed, not mapped" for n in needed if n not in binding.columns]
    out += [f"{n}: mapped, not read" for n in binding.columns if n not in needed]
    return out + [f"{c}: not a column of the source" for c in binding.columns.values() if c not in columns]


def capped(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows and whether there are more; n + 1 are fetched."""
    some = df.orderBy(*order).limit(n + 1)
    whole = some.agg(F.count("*").alias("fetched"))
    return some.orderBy(*order).limit(n).crossJoin(F.broadcast(whole)).withColumn("truncated", F.col("fetched") > n).drop("fetched")

