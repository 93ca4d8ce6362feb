"""Reconciling two results: digests of stretches first, then only the rows of stretches that differ.

A stretch is a day and a range of key hashes. Its digest does not depend on the order of rows: their number and two sums
of 64-bit hashes of keys and values, so unequal stretches pass as equal with a probability of about 2**-128."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import join_keys

EXACT, CURRENCY, RATIO = "exact", "currency", "ratio"
RANGES = 64
DIFFERS, ONLY_EXPECTED, ONLY_ACTUAL = "differs", "expected", "actual"


def _keyed(df: DataFrame, keys: Sequence[str], measures: Sequence[str], day: str | None, ranges: int) -> DataFrame:
    """keys as text (blank and null alike), measures as doubles, the stretch (_day, _range) and _day_value to prune by."""
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    date = F.col(day) if day else F.lit(None).cast("date")
    rows = df.select(*own, *[F.col(m).cast("double").alias(m) for m in measures], date.alias("_day"))
    return rows.withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int"))


def digests(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """_day, _range and the digest of each stretch of rows as `_keyed` makes them; partial sums are combined before the shuffle."""
    # a hash skips nulls, so whether a value is there is hashed too; 0.0 + -0.0 is 0.0
    cells = [c for m in measures for c in (F.coalesce(F.col(m) + 0.0, F.lit(0.0)), F.col(m).isNull())]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *keys, *cells).cast("decimal(20,0)")).cast("decimal(38,0)")
    return rows.groupBy("_day", "_range").agg(F.count("*").alias("rows"), total(1).alias("one"), total(2).alias("two"))


def stretches_that_differ(expected: DataFrame, actual: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """_day and _range of the stretches whose digests are not equal, or that one side lacks."""
    names = {"rows": "rows_a", "one": "one_a", "two": "two_a"}
    both = join_keys(digests(expected, keys, measures), digests(actual, keys, measures).withColumnsRenamed(names), ["_day", "_range"], "full_outer")
    same = F.lit(True)
    for c, a in names.items():
        same = same & F.col(c).eqNullSafe(F.col(a))
    return both.where(~same).select("_day", "_range")


def _agree(e: Column, a: Column, tolerance: str) -> Column:
    gap, top = F.abs(e - a), F.greatest(F.abs(e), F.abs(a))
    allowed = {EXACT: F.lit(0.0), CURRENCY: F.lit(0.001), RATIO: top * 1e-9}[tolerance]
    return F.when(e.isNull() | a.isNull(), e.isNull() & a.isNull()).otherwise(gap <= allowed)


def findings(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerances: Mapping[str, str], day: str | None = None, ranges: int = RANGES
) -> DataFrame:
    """keys, finding, measure, expected and actual: measures that disagree (`differs`), and keys that one side alone has.

    Blank and null keys are one key, null agrees with null; currency allows 0.001, ratio 1e-9 of the larger, exact nothing.
    Both sides are read for their digests, and again for the stretches that differ; with `day`, a date column that tables
    are laid out by, the second reading opens the days that differ alone. Frames that cost much to make are best stored
    first. Rows meet in one full outer join, and are expanded only into measures that differ."""
    measures = list(tolerances)
    e, a = (_keyed(df, keys, measures, day, ranges) for df in (expected, actual))
    differ = stretches_that_differ(e, a, keys, measures)
    if day:
        found = differ.groupBy("_day").agg(F.collect_set("_range").alias("r")).collect()  # days and ranges, not rows
        days = [r["_day"] for r in found if r["_day"] is not None]
        known = F.col(day).isin(days) if days else F.lit(False)
        here = known | F.col(day).isNull() if any(r["_day"] is None for r in found) else known
        e, a = (_keyed(df.where(here), keys, measures, day, ranges) for df in (expected, actual))
        rows = [(r["_day"], x) for r in found for x in r["r"]]
        differ = expected.sparkSession.createDataFrame(rows, "_day date, _range int")
    of = {m: f"_a_{m}" for m in measures}
    left, right = (join_keys(x, differ, ["_day", "_range"], "left_semi").drop("_day", "_range") for x in (e, a))
    both = join_keys(left.withColumn("_e", F.lit(True)), right.withColumnsRenamed(of).withColumn("_a", F.lit(True)), list(keys), "full_outer")
    cell = lambda m: F.struct(F.lit(m).alias("measure"), F.col(m).alias("expected"), F.col(of[m]).alias("actual"))
    none = F.lit(None).cast("double")
    gone = F.array(F.struct(F.lit("*").alias("measure"), none.alias("expected"), none.alias("actual")))
    wrong = F.filter(F.array(*[F.when(~_agree(F.col(m), F.col(of[m]), t), cell(m)) for m, t in tolerances.items()]), lambda x: x.isNotNull())
    matched = F.col("_e") & F.col("_a")
    side = F.when(F.col("_a").isNull(), ONLY_EXPECTED).when(F.col("_e").isNull(), ONLY_ACTUAL).otherwise(DIFFERS)
    cells = both.select(*keys, side.alias("finding"), F.explode(F.when(matched, wrong).otherwise(gone)).alias("c"))
    return cells.select(*keys, "finding", "c.*")
