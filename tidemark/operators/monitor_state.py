"""Monitors day by day: the last changes of each key are carried in a state, so a new day reads the state and that day.

The points that come out are those of `variance.points` over the whole history. They are filed by day, and thresholds can
be judged again over them at any time without working out the series again."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.filed import folder, folders
from ..sources.sinks import write_partitions
from .keys import join_keys

DAY = "as_of_date"
WINDOWS = (30, 60)
UPTO = "_upto"
NONE = "array<double>"


def _last(values: Column, n: int) -> Column:
    """The last n of an array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def _deviation(values: Column) -> Column:
    """Sample deviation of the values that are there, null for fewer than two."""
    known = F.filter(values, lambda v: v.isNotNull())
    n = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / n
    squares = F.aggregate(known, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def _carried(state: DataFrame | None, rolled: DataFrame, grain: Sequence[str], most: int) -> DataFrame:
    """Each observation with its predecessor and _before, the changes before it, from the state and from the period itself.

    The first observation of a key has no change; its null keeps its place, as in a frame of rows."""
    if state is None:
        known = rolled.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("_value", "decimal(38,2)"), ("_date", "date"), ("_changes", NONE))])
    else:
        own = state.select(*grain, F.col("last_value").alias("_value"), F.col("last_date").alias("_date"), F.col("changes").alias("_changes"))
        known = join_keys(rolled, own, grain)
    line = Window.partitionBy(*grain).orderBy(DAY)
    prior = {"prior": F.coalesce(F.lag("value").over(line), F.col("_value")), "prior_date": F.coalesce(F.lag(DAY).over(line), F.col("_date"))}
    changed = known.withColumns(prior).withColumn("delta", (F.col("value") - F.col("prior")).cast("decimal(38,2)"))
    here = F.collect_list(F.struct(F.col("delta").cast("double").alias("d"))).over(line.rowsBetween(-most, -1))
    before = F.concat(F.coalesce("_changes", F.array().cast(NONE)), F.transform(here, lambda x: x["d"]))
    return changed.withColumn("_before", _last(before, most)).drop("_value", "_date", "_changes")


def advance(state: DataFrame | None, rolled: DataFrame, grain: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Points of a period (one day or several, all later than the state) as `variance.points` gives them, from the state and the period's rows alone.

    rolled: grain, day and value. state: what `state_after` gave for the period before, none at the start."""
    made = _carried(state, rolled, grain, max(windows))
    pct = F.try_divide(F.col("delta").cast("double"), F.nullif(F.abs("prior"), F.lit(0)).cast("double")) * 100
    added = {"pct": pct}
    for n in windows:
        tail = _last(F.col("_before"), n)
        added[f"sigma_{n}"] = _deviation(tail)
        added[f"n_{n}"] = F.size(F.filter(tail, lambda v: v.isNotNull())).cast("long")
    return made.withColumns(added).drop("_before")


def state_after(state: DataFrame | None, rolled: DataFrame, grain: Sequence[str], most: int = max(WINDOWS)) -> DataFrame:
    """grain, last_value, last_date and changes (the last `most`) of every key; keys that the period lacks keep theirs."""
    made = _carried(state, rolled, grain, most)
    changes = _last(F.concat("_before", F.array(F.col("delta").cast("double"))), most)
    last = F.max_by(F.struct(F.col("value").cast("decimal(38,2)").alias("last_value"), F.col(DAY).alias("last_date"), changes.alias("changes")), F.col(DAY))
    new = made.groupBy(*grain).agg(last.alias("s")).select(*grain, "s.*")
    if state is None:
        return new
    kept = state.select(*grain, "last_value", "last_date", "changes")
    return new.unionByName(join_keys(kept, rolled.select(*grain), grain, "left_anti"))


def state_schema(rolled: DataFrame, grain: Sequence[str]) -> str:
    kinds = dict(rolled.dtypes)
    return ", ".join(f"`{g}` {kinds[g]}" for g in grain) + ", last_value decimal(38,2), last_date date, changes array<double>"


def last_state(spark: SparkSession, states: str, before: datetime.date | None = None) -> str | None:
    """The folder of the newest state, or of the newest one that holds no day from `before` on."""
    names = [n for n in folders(spark, states) if n.startswith(f"{UPTO}=")]
    days = [d for d in (n.removeprefix(f"{UPTO}=") for n in names) if before is None or d < before.isoformat()]
    return f"{states}/{UPTO}={max(days)}" if days else None


def run_period(rolled: DataFrame, first: datetime.date, last: datetime.date, states: str, points: str, grain: Sequence[str], windows: Sequence[int] = WINDOWS) -> None:
    """File the points of the days first to last, and the state after them.

    rolled has these days only; they are read once more for the state. The state before is the newest one before `first`,
    so a period that runs again, after a failure or a correction, replaces what it filed and counts nothing twice; later
    periods then have to run again too, which `stale_states` names."""
    spark = rolled.sparkSession
    at = last_state(spark, states, first)
    state = spark.read.schema(state_schema(rolled, grain)).parquet(at) if at else None
    write_partitions(advance(state, rolled, grain, windows), points, [DAY])
    state_after(state, rolled, grain, max(windows)).write.mode("overwrite").parquet(f"{states}/{folder(UPTO, last)}")


def stale_states(spark: SparkSession, states: str, day: datetime.date) -> list[datetime.date]:
    """Ends of the periods after a day, which have to run again once that day has."""
    days = [datetime.date.fromisoformat(n.removeprefix(f"{UPTO}=")) for n in folders(spark, states) if n.startswith(f"{UPTO}=")]
    return sorted(d for d in days if d > day)
