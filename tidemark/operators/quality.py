"""Quality of results: reconciliation, conservation, coherence, samples, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import CURRENCY, DIFFERS, EXACT, RATIO, findings

__all__ = ["CURRENCY", "EXACT", "RATIO"]  # also reached from here


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerances: Mapping[str, str], day: str | None = None) -> DataFrame:
    """Measures that disagree: keys, measure, expected, actual; see `findings`, which has the keys of one side too."""
    return findings(expected, actual, keys, tolerances, day).where(F.col("finding") == DIFFERS).drop("finding")


def reconcile_missing(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side alone has; blank and null alike."""
    key = lambda df: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
    e, a = key(expected), key(actual)
    return e.join(a, list(keys), "left_anti").withColumn("side", F.lit("expected")).unionByName(a.join(e, list(keys), "left_anti").withColumn("side", F.lit("actual")))


def mass_check(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """Whether each dimension's groups sum to the headline, within max(1e-6, 1e-9 of it)."""
    sets = [(), *((d,) for d in dims)]
    grouped = df.groupingSets([list(map(F.col, s)) for s in sets], *map(F.col, dims)).agg(F.sum(value).cast("double").alias("v"), F.grouping_id().alias("g"))
    full = (1 << len(dims)) - 1
    head = grouped.where(F.col("g") == full).select(F.col("v").alias("headline"))
    dim = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(dims) for x in (full - (1 << (len(dims) - 1 - i)), d)]), F.col("g").cast("int"))
    sums = grouped.where(F.col("g") != full).groupBy(dim.alias("dim")).agg(F.sum("v").alias("group_sum"))
    return sums.crossJoin(F.broadcast(head)).select("dim", F.round("group_sum", 2).alias("group_sum"), F.round("headline", 2).alias("headline"), (F.abs(F.col("group_sum") - F.col("headline")) <= F.greatest(F.lit(1e-6), F.abs("headline") * 1e-9)).alias("ties"))


def asof_coherence(frames: Sequence[tuple[str, DataFrame]], day: str = "as_of_date") -> DataFrame:
    """Days that each result is for, and whether all are for one day."""
    out = None
    for name, df in frames:
        one = df.select(F.lit(name).alias("result"), F.col(day).alias("day")).distinct()
        out = one if out is None else out.unionByName(one)
    one_day = out.agg((F.countDistinct("day") <= 1).alias("coherent"))
    return out.crossJoin(F.broadcast(one_day))


def finite_check(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Cells that hold no finite number."""
    cells = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("value")) for v in values])).alias("c")).select(*keys, "c.*")
    problem = F.when(F.col("value").isNull(), "null").when(F.isnan("value"), "nan").when(F.abs("value") == float("inf"), "infinite")
    return cells.withColumn("problem", problem).where("problem is not null").drop("value")


def empty_filters(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Filters (name -> condition) that keep no row; one pass for all."""
    row = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in filters.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("records")) for n in filters])).alias("f")).select("f.*").where("records = 0")


def dup_measures(measures: DataFrame) -> DataFrame:
    """Measures with the same aggregate, field and filter, names in order."""
    shape = ["agg", "field", F.coalesce("filter", F.lit("")).alias("filter")]
    return measures.groupBy(*shape).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n")).where("n > 1")


def stratified_sample(df: DataFrame, strata: Sequence[str], per_stratum: int, key: Sequence[str]) -> DataFrame:
    """Up to per_stratum rows of each combination of strata, by a hash of the key: the same rows each time."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", *key)), *key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_stratum).drop("_n")


def export_rows(name: str, df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows of a view, if it is on the list; refused before any job runs."""
    if name not in allowed:
        raise PermissionError(f"{name} may not be exported row by row")
    return df


def dim_profile(df: DataFrame, max_values: int = 40, ordered: Sequence[str] = ()) -> DataFrame:
    """Name, type, whether ordered, number of distinct values (null if over max_values) and the values, for each column.

    A sketch screens the columns first; only those that may be short enough are counted exactly."""
    short = {"string": "text", "date": "date", "boolean": "boolean"}
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns]).first()
    few = [c for c in df.columns if rough[c] <= 2 * max_values + 10]
    exact = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in few]) if few else df.sparkSession.range(1)
    none = F.lit(None).cast("array<string>")
    cells = []
    for c, kind in df.dtypes:
        values = F.when(F.size(F.col(c)) <= max_values, F.col(c)) if c in few else none
        cells.append(F.struct(F.lit(c).alias("name"), F.lit(short.get(kind, "number")).alias("type"), F.lit(c in ordered).alias("is_ordered"), F.when(values.isNotNull(), F.size(values)).cast("long").alias("n_values"), F.array_join(values, ",").alias("value_list")))
    return exact.select(F.explode(F.array(*cells)).alias("d")).select("d.*")
