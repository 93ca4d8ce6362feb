"""Presentation tables: pivots, heat maps, waterfalls, histograms, stacks, gauges, packs, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import Ladder, formatted, ladder_ordinal
from ..sources.sinks import stored
from .ranks import median

TOTAL = "(total)"


def pivot_margins(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """Sums by row and column with row, column and grand totals; one pass."""
    cube = df.cube(row, column).agg(F.sum(value).cast("decimal(38,2)").cast("double").alias("value"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    name = lambda c, g: F.when(F.col(g) == 1, F.lit(TOTAL)).otherwise(F.col(c))
    return cube.select(name(row, "_r").alias(row), name(column, "_c").alias(column), "value")


def heatmap(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """Cells with intensity |v| / largest |v| and sign."""
    cells = df.groupBy(row, column).agg(F.sum(value).cast("double").alias("value"))
    top = cells.agg(F.max(F.abs("value")).alias("_top"))
    return cells.crossJoin(F.broadcast(top)).select(row, column, "value", F.coalesce(F.try_divide(F.abs("value"), "_top"), F.lit(0.0)).alias("intensity"), F.signum("value").cast("int").alias("sign"))


def waterfall(moves: DataFrame, key: str) -> DataFrame:
    """Prior total, a step for each key with where it starts and ends, current total. moves: key, value, prior (decimals), of a group count that a chart can show."""
    w = Window.orderBy(F.desc("delta"), key)
    steps = moves.withColumn("delta", F.col("value") - F.col("prior"))
    start = moves.agg(F.sum("prior").alias("prior"), F.sum("value").alias("value"))
    run = steps.withColumn("run", F.sum("delta").over(w)).crossJoin(F.broadcast(start.withColumnsRenamed({"prior": "_p", "value": "_v"})))
    out = run.select((F.row_number().over(w)).alias("ord"), F.col(key).alias("step"), (F.col("_p") + F.col("run") - F.col("delta")).alias("from_value"), (F.col("_p") + F.col("run")).alias("to_value"))
    zero = F.lit(0).cast("decimal(38,2)")
    first = start.select(F.lit(0).alias("ord"), F.lit("prior").alias("step"), zero.alias("from_value"), F.col("prior").alias("to_value"))
    last = start.crossJoin(moves.agg((F.count("*") + 1).cast("int").alias("ord"))).select("ord", F.lit("current").alias("step"), zero.alias("from_value"), F.col("value").alias("to_value"))
    both = first.unionByName(out).unionByName(last)
    return both.select("ord", "step", F.col("from_value").cast("double").alias("from_value"), F.col("to_value").cast("double").alias("to_value"))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """Equal bins, as many as Sturges' rule says but 3 to 12, with counts, and the exact median of all."""
    x = stored(df.where(value.isNotNull()).select(value.cast("double").alias("x")), "values")
    about = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("median", F.lit(median(x)).cast("double"))
    about = about.withColumn("bins", F.greatest(F.lit(3), F.least(F.lit(12), (F.ceil(F.log2("n")) + 1).cast("int"))))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1)).cast("int")
    counts = x.crossJoin(F.broadcast(about)).groupBy(place.alias("bin")).agg(F.count("*").alias("records"))
    frame = about.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    joined = frame.join(counts, "bin", "left")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return joined.select("bin", (F.col("lo") + width * F.col("bin")).alias("from_value"), F.coalesce("records", F.lit(0)).alias("records"), "median")


def stacked_bands(values: DataFrame, date_col: str, band: str) -> DataFrame:
    """Bottom and top of each band on each day, and whether the day has a negative value, which cannot be stacked."""
    w = Window.partitionBy(date_col).orderBy(band)
    top = F.sum("value").over(w)
    return values.withColumns({"top": top.cast("double"), "bottom": (top - F.col("value")).cast("double"), "refused": F.bool_or(F.col("value") < 0).over(Window.partitionBy(date_col))}).withColumn("value", F.col("value").cast("double"))


def bar_topk(values: DataFrame, dim: str, k: int, ladder: Ladder | None = None) -> DataFrame:
    """The k first bars: by value, or in ladder order for an ordinal dimension."""
    order = [ladder_ordinal(F.col(dim), ladder).asc_nulls_last(), F.col(dim)] if ladder else [F.col("value").desc_nulls_last(), F.col(dim)]
    return values.orderBy(*order).limit(k)


def delta_table(groups: DataFrame) -> DataFrame:
    """Value, prior, move and percent move."""
    move = (F.col("value") - F.col("prior")).cast("double")
    return groups.withColumns({"move": move, "move_pct": F.try_divide(move, F.abs(F.col("prior").cast("double"))) * 100})


def limit_gauge(values: DataFrame, limit: float | None, side: str | None) -> DataFrame:
    """Breach of a floor or ceiling, and the room left; without a declared side there is no status."""
    if side is None or limit is None:
        return values.withColumns({"status": F.lit(None).cast("string"), "room": F.lit(None).cast("double")})
    v = F.col("value").cast("double")
    room = v - limit if side == "floor" else F.lit(float(limit)) - v
    return values.withColumns({"status": F.when(room < 0, "breach").when(room >= 0, "within"), "room": room})


def shared_extent(df: DataFrame, value: str, currency: bool, pad: float = 0.08) -> DataFrame:
    """One axis for all panels: smallest and largest, with zero for amounts, padded."""
    v = F.col(value).cast("double")
    lo, hi = (F.least(F.min(v), F.lit(0.0)), F.greatest(F.max(v), F.lit(0.0))) if currency else (F.min(v), F.max(v))
    out = df.agg(lo.alias("lo"), hi.alias("hi"))
    return out.select((F.col("lo") - (F.col("hi") - F.col("lo")) * pad).alias("low"), (F.col("hi") + (F.col("hi") - F.col("lo")) * pad).alias("high"))


def pack_rows(items: Sequence[tuple[str, DataFrame | None, str]]) -> DataFrame:
    """One row for each board item (name, frame of label, value and prior as decimals, format); an item that could not be made is `skipped`."""
    out = None
    for i, (name, df, fmt) in enumerate(items):
        if df is None:
            continue
        one = df.select(F.lit(i).alias("ord"), F.lit(name).alias("item"), "label", formatted(F.col("value"), fmt).alias("value"), formatted(F.col("prior"), fmt).alias("prior"), F.lit("ok").alias("status"))
        out = one if out is None else out.unionByName(one)
    none = F.lit(None).cast("string")
    for i, (name, df, _) in enumerate(items):
        if df is None:
            spark = out.sparkSession
            out = out.unionByName(spark.range(1).select(F.lit(i).alias("ord"), F.lit(name).alias("item"), none.alias("label"), none.alias("value"), none.alias("prior"), F.lit("skipped").alias("status")))
    return out


def measure_trace(values: DataFrame, edges: Sequence[tuple[str, str, int]], branch: Column, rows_read: str) -> DataFrame:
    """Each input of a measure (parent, input, depth) with its value, the rows that were read and the branch that the measure took; values is one row."""
    cells = [F.struct(F.lit(p).alias("parent"), F.lit(i).alias("input"), F.lit(d).alias("depth"), F.col(i).cast("double").alias("value"), F.col(rows_read).alias("rows_read"), branch.alias("branch")) for p, i, d in edges]
    return values.select(F.explode(F.array(*cells)).alias("t")).select("t.*")
