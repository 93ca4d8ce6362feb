"""Places in a total order, and values at given places, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored

BINS = 1024
FEW = 100_000  # values that are sorted at once in the end


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", kind: str = "int") -> DataFrame:
    """Rows with their place, from 1, in a total order.

    Rows are dealt out by ranges of the order, sorted within each, and written with their place in it. Then a place in all
    is the place in the range plus the rows of the ranges before; those are as many numbers as there are ranges. Writing
    them keeps the ranges from being drawn anew when the rows are counted."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_place": place})
    kept = stored(laid, "ranges")
    counts = sorted(tuple(r) for r in kept.groupBy("_range").count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    offsets = [(r, b) for (r, _), b in zip(counts, before, strict=False)]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before long"))
    return kept.join(table, "_range").select(*df.columns, (F.col("_before") + F.col("_place") + 1).cast(kind).alias(name))


def values_at(x: DataFrame, places: Sequence[int], few: int = FEW) -> list[float]:
    """The values at some places, from 0, of one double column x in ascending order; NaN comes last.

    Values are counted into bins between the smallest and the largest that may be at the place; the bin that holds it,
    with its own smallest and largest, is the next stretch. Both ends of a stretch fall into different bins, so it ends:
    at a bin of one value, however often that occurs, or at few values, which are sorted. Each round is one pass, and what
    comes to the driver is a row for each bin."""
    finite = ~F.isnan("x") & (F.abs("x") != float("inf"))
    out, todo = {}, [(tuple(sorted(set(places))), None, 0)]  # places, the stretch (low, high), values before it
    while todo:
        wanted, stretch, before = todo.pop()
        if stretch is None:
            # infinities and NaN have bins of their own; finite values are all in one at first
            rows, bins = x, F.when(F.isnan("x"), 3).when(F.col("x") == float("inf"), 2).when(finite, 1).otherwise(0)
        else:
            low, high = stretch
            rows = x.where(F.col("x").between(low, high))
            # halves, as the difference of two finite doubles need not be finite
            share = (F.col("x") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            bins = F.least(F.floor(F.greatest(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))
            bins = F.when(F.col("x") == low, 0).when(F.col("x") == high, BINS - 1).otherwise(F.greatest(F.lit(0), bins)).cast("int")
        found = rows.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(found, key=lambda r: r["bin"]):
            here = tuple(p for p in wanted if before <= p < before + r["n"])
            if here and (r["low"] == r["high"] or r["low"] != r["low"]):
                out |= dict.fromkeys(here, r["low"])
            elif here and r["n"] <= few:
                some = sorted(v[0] for v in x.where(F.col("x").between(r["low"], r["high"])).collect())
                out |= {p: some[p - before] for p in here}
            elif here:
                todo.append((here, (r["low"], r["high"]), before))
            before += r["n"]
    if missing := set(places) - set(out):
        raise IndexError(f"there are no values at {sorted(missing)}")
    return [out[p] for p in places]


def median(x: DataFrame) -> float | None:
    """The exact median of one double column x without nulls, the mean of the two middle values of an even number; none without rows."""
    n = x.count()
    if not n:
        return None
    low, high = values_at(x, [(n - 1) // 2, n // 2])
    return low if low == high or low != low else low + 0.5 * (high - low)
