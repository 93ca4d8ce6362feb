"""Measures: filtered aggregates over a dense day spine, derived measures, windows over a series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cents
from .keys import join_keys

DAY = "as_of_date"


@dataclass(frozen=True)
class Measure:
    """One aggregate: sum, avg, min, max, count, first, last or weighted_avg of a field, over the rows that `where` keeps.

    order: total order for first and last. money: the result is an amount, rounded to the cent."""

    name: str
    agg: str
    field: str = "*"
    where: str | None = None
    weight: str | None = None
    order: tuple[str, ...] = ()
    money: bool = False

    def column(self) -> Column:
        keep = F.expr(self.where) if self.where else F.lit(True)
        x = F.when(keep, F.lit(1) if self.field == "*" else F.expr(self.field))
        if self.agg == "sum":
            out = F.coalesce(F.sum(x), F.lit(0))
        elif self.agg == "weighted_avg":
            w = F.when(keep, F.expr(self.weight))
            both = x.isNotNull() & w.isNotNull()
            total = lambda c: F.sum(F.when(both, c)).cast("double")
            out = F.try_divide(total(x * w), total(w))
        elif self.agg in ("first", "last"):
            rank = F.when(keep, F.struct(*self.order))
            out = (F.min_by if self.agg == "first" else F.max_by)(F.expr(self.field), rank)
        else:
            out = {"avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[self.agg](x)
        return (cents(out) if self.money else out).alias(self.name)


def aggregate(df: DataFrame, measures: Sequence[Measure], keys: Sequence[str] = ()) -> DataFrame:
    """All measures in one pass and one shuffle. Without keys, one row even over nothing."""
    columns = [m.column() for m in measures]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def dependency_order(derived: Mapping[str, tuple[Sequence[str], str]]) -> list[str]:
    """Derived measures, name -> (inputs, expression), each after its inputs; a cycle is refused."""
    return [n for n in TopologicalSorter({n: [i for i in inputs if i in derived] for n, (inputs, _) in derived.items()}).static_order() if n in derived]


def derive(df: DataFrame, derived: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Adds derived measures, one projection for each in dependency order."""
    for name in dependency_order(derived):
        df = df.withColumn(name, F.expr(derived[name][1]))
    return df


def spine(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last for each key."""
    bounds = df.agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi")).where("lo is not null")
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias(DAY))
    return df.select(*keys).distinct().crossJoin(F.broadcast(days)) if keys else days


def series(df: DataFrame, measures: Sequence[Measure], keys: Sequence[str] = ()) -> DataFrame:
    """Measures for each day and key, on every day of the range; sums and counts over nothing are 0, others null."""
    made = aggregate(df, measures, [*keys, DAY])
    full = join_keys(spine(df, keys), made, [*keys, DAY])
    return full.withColumns({m.name: F.coalesce(m.name, F.lit(0)) for m in measures if m.agg in ("sum", "count")})


def series_counts(df: DataFrame, where: str) -> DataFrame:
    """Rows used and rows scanned on each day."""
    made = df.groupBy(DAY).agg(F.count_if(F.expr(where)).alias("rows_used"), F.count("*").alias("rows_scanned"))
    return spine(df).join(made, DAY, "left").select(DAY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_used", "rows_scanned")])


def headline_and_groups(df: DataFrame, measures: Sequence[Measure], dims: Sequence[str]) -> DataFrame:
    """The headline and the groups of each dimension in one pass; level names what a row is grouped by."""
    sets = [(), *((d,) for d in dims)]
    grouped = df.groupingSets([list(map(F.col, s)) for s in sets], *map(F.col, dims)).agg(*[m.column() for m in measures], F.grouping_id().alias("_g"))
    full = (1 << len(dims)) - 1
    level = F.when(F.col("_g") == full, "headline")
    for i, d in enumerate(dims):
        level = level.when(F.col("_g") == full - (1 << (len(dims) - 1 - i)), d)
    return grouped.withColumn("level", level).drop("_g")


def grain_risk(df: DataFrame, key: str, value: Column, cap: float) -> DataFrame:
    """A cap applied to each group and to the whole: both totals and the gap."""
    groups = df.groupBy(key).agg(F.sum(value).alias("v"))
    c = F.lit(cap).cast("decimal(38,2)")
    return groups.agg(F.sum(F.least("v", c)).cast("double").alias("capped_by_group"), F.least(F.sum("v"), c).cast("double").alias("capped_whole"), (F.sum(F.least("v", c)) - F.least(F.sum("v"), c)).cast("double").alias("gap"))


def observed_values(df: DataFrame, column: str, limit: int = 40) -> DataFrame:
    """The first distinct values of a column in order, and whether there are more; null is none."""
    some = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(limit + 1)
    n = some.agg((F.count("*") > limit).alias("truncated"))
    return some.orderBy("value").limit(limit).crossJoin(F.broadcast(n))


def range_check(values: DataFrame, value: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose value lies outside its declared range."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(value) < low)
    if high is not None:
        bad = bad | (F.col(value) > high)
    return values.where(bad)


def window_measure(df: DataFrame, value: str, op: str, n: int, keys: Sequence[str] = (), date_col: str = DAY, frame: str = "rows") -> DataFrame:
    """Adds `<op>_<n>` over each key's series in date order.

    delta and pct_change look n rows back; avg, sum, min, max, stddev and variance take the last n rows with today's and
    are null until there are n (frame="rows"), or the last n calendar days, however many rows they hold (frame="time")."""
    ordered = Window.partitionBy(*keys).orderBy(date_col)
    x = F.col(value)
    if op in ("delta", "pct_change"):
        before = F.lag(x, n).over(ordered)
        out = x - before if op == "delta" else F.try_divide((x - before).cast("double"), before.cast("double")) * 100
    else:
        make = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp}[op]
        if frame == "time":
            out = make(x).over(Window.partitionBy(*keys).orderBy(F.unix_date(date_col)).rangeBetween(-(n - 1), 0))
        else:
            out = F.when(F.row_number().over(ordered) >= n, make(x).over(ordered.rowsBetween(-(n - 1), 0)))
    return df.withColumn(f"{op}_{n}", out)
