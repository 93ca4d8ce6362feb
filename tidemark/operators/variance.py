"""Monitors over filed tables: change against the last observation, trailing sigma, thresholds, verdicts.

Series are sparse on purpose: a key's change is against its previous observation, whenever that was."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

DAY = "as_of_date"
LEAST_OBSERVATIONS = 10
SEVERITIES = ("high", "medium", "low")


@dataclass(frozen=True)
class Threshold:
    id: str
    basis: str  # static_abs, static_pct, stddev_30d or stddev_60d
    limit: float  # an amount, a percentage, or a number of sigmas
    severity: str = "medium"
    applies_to: str | None = None  # a condition over the key columns


def rollup(filed: DataFrame, measure: str, grain: Sequence[str]) -> DataFrame:
    """Filed rows at the watched grain, rounded again."""
    return filed.groupBy(*grain, DAY).agg(F.sum(measure).cast("decimal(38,2)").alias("value"))


def points(rolled: DataFrame, grain: Sequence[str], windows: Sequence[int] = (30, 60)) -> DataFrame:
    """Each observation with its predecessor, change, percent change, and sigma and count of the changes before it."""
    w = Window.partitionBy(*grain).orderBy(DAY)
    changed = rolled.withColumns({"prior": F.lag("value").over(w), "prior_date": F.lag(DAY).over(w)}).withColumn("delta", (F.col("value") - F.col("prior")).cast("decimal(38,2)"))
    changed = changed.withColumn("pct", F.try_divide(F.col("delta").cast("double"), F.nullif(F.abs("prior"), F.lit(0)).cast("double")) * 100)
    added = {}
    for n in windows:
        before = w.rowsBetween(-n, -1)
        added[f"sigma_{n}"] = F.stddev_samp(F.col("delta").cast("double")).over(before)
        added[f"n_{n}"] = F.count("delta").over(before)
    return changed.withColumns(added)


def gap_days(rolled: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Positions in the list of all days between an observation and the one before; 1 if no day was missed."""
    days = rolled.select(DAY).distinct().withColumn("place", F.row_number().over(Window.orderBy(DAY)))  # days, not rows
    w = Window.partitionBy(*grain).orderBy(DAY)
    return rolled.join(F.broadcast(days), DAY).withColumn("gap_days", F.col("place") - F.lag("place").over(w)).drop("place")


def appeared(rolled: DataFrame, grain: Sequence[str]) -> DataFrame:
    """First day of a key that is not the first of all, and the first absent day after each presence."""
    days = rolled.select(DAY).distinct().withColumns({"next_day": F.lead(DAY).over(Window.orderBy(DAY)), "first_day": F.min(DAY).over(Window.orderBy(DAY))})
    w = Window.partitionBy(*grain).orderBy(DAY)
    seen = rolled.select(*grain, DAY).withColumns({"prior_date": F.lag(DAY).over(w), "following": F.lead(DAY).over(w)}).join(F.broadcast(days), DAY)
    new = seen.where(f"prior_date is null and {DAY} <> first_day").select(*grain, DAY, F.lit("appeared").alias("event"))
    gone = seen.where("next_day is not null and (following is null or following > next_day)").select(*grain, F.col("next_day").alias(DAY), F.lit("disappeared").alias("event"))
    return new.unionByName(gone)


def _verdict(t: Threshold) -> tuple[Column, Column, Column, Column]:
    """(compared size, limit, sigma, observations) of a threshold."""
    size, none = F.abs(F.col("delta")).cast("double"), F.lit(None).cast("double")
    if t.basis == "static_abs":
        return size, F.lit(float(t.limit)), none, F.lit(None).cast("long")
    if t.basis == "static_pct":
        return F.abs(F.col("pct")), F.lit(float(t.limit)), none, F.lit(None).cast("long")
    n = t.basis.removeprefix("stddev_").removesuffix("d")
    sigma = F.when(F.col(f"n_{n}") >= LEAST_OBSERVATIONS, F.col(f"sigma_{n}"))
    return size, F.when(sigma > 0, sigma * t.limit), F.col(f"sigma_{n}"), F.col(f"n_{n}")


def judge(observed: DataFrame, thresholds: Sequence[Threshold]) -> DataFrame:
    """Every point against every threshold: breach, pass, insufficient (no predecessor, too few changes, no spread, or no base) or not_applicable.

    Thresholds are expanded from one array, so the points are read once and never joined."""
    cells = []
    for t in thresholds:
        size, limit, sigma, n = _verdict(t)
        scope = F.coalesce(F.expr(t.applies_to), F.lit(False)) if t.applies_to else F.lit(True)
        verdict = F.when(~scope, "not_applicable").when(size.isNull() | limit.isNull(), "insufficient").when(size > limit, "breach").otherwise("pass")
        cells.append(F.struct(F.lit(t.id).alias("threshold_id"), F.lit(t.basis).alias("basis"), F.lit(t.severity).alias("severity"), limit.alias("limit_value"), sigma.alias("sigma"), n.alias("observations"), verdict.alias("verdict")))
    return observed.withColumn("_t", F.explode(F.array(*cells))).select("*", "_t.*").drop("_t")


def breaches(judged: DataFrame) -> DataFrame:
    """Breaches with their severity's rank; order by severity_rank, then the change's size."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    return judged.where("verdict = 'breach'").withColumns({"severity_rank": rank, "change_size": F.abs("delta").cast("double")})


def monitor_stats(judged: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Verdicts of each threshold, keys watched and key-days evaluated."""
    count = {v: F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("breach", "pass", "insufficient", "not_applicable")}
    return judged.groupBy("threshold_id").agg(*count.values(), F.countDistinct(F.struct(*grain)).alias("keys_watched"), F.count("*").alias("key_days"))


def behaviour(stats: DataFrame) -> DataFrame:
    """What a threshold's verdicts say about it as a control; the first that holds."""
    judged = F.col("n_breach") + F.col("n_pass")
    seen = judged + F.col("n_insufficient")
    finding = F.when(F.col("key_days") == 0, "nothing evaluated").when(seen == 0, "applies to nothing").when(F.col("n_insufficient") > 0.5 * seen, "mostly insufficient").when(F.col("n_breach") == 0, "never fires").when(F.col("n_breach") > 0.25 * judged, "fires too often").otherwise("ok")
    return stats.select("threshold_id", finding.alias("finding"))


def exceptions(monitors: Sequence[tuple[str, DataFrame]], key: Column, as_of: str) -> DataFrame:
    """Breaches of one day over several monitors, each with a message."""
    parts = []
    for name, judged in monitors:
        day = breaches(judged.where(F.col(DAY) == F.lit(as_of).cast("date"))).withColumns({"monitor": F.lit(name), "key": key})
        parts.append(day.select("monitor", "key", "threshold_id", "severity", F.concat("key", F.lit(" moved "), F.col("delta").cast("string"), F.lit(" against "), F.col("prior").cast("string"), F.lit(" ("), F.col("basis"), F.lit(")")).alias("message")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exception_strip(breached: DataFrame, upgrades: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Breaches and pending version upgrades, without the acknowledged, ranked: columns id, kind, severity_rank, size."""
    both = breached.unionByName(upgrades).join(acknowledged.select("id"), "id", "left_anti")
    return ranked(both, [F.col("severity_rank").asc(), F.col("size").desc(), F.col("id").asc()])
