"""Dashboard queries: a value, groups or a series as of a day, each with a prior value."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import scan_trailing
from ..sources.filed import FiledTable
from .keys import join_keys
from .measures import Measure

DAY = "as_of_date"


def calendar(df: DataFrame) -> DataFrame:
    """Available days with the prior day, the day seven places before (or the first), and the last day of an earlier month."""
    days = df.select(DAY).where(f"{DAY} is not null").distinct()
    w = Window.orderBy(DAY)  # days, not rows
    month = F.trunc(DAY, "month")
    monthly = days.groupBy(month.alias("_m")).agg(F.max(DAY).alias("_last")).withColumn("month_end", F.lag("_last").over(Window.orderBy("_m"))).select("_m", "month_end")
    out = days.withColumns({"prior_day": F.lag(DAY).over(w), "prior_week": F.when(F.lag(DAY).over(w).isNotNull(), F.coalesce(F.lag(DAY, 7).over(w), F.first(DAY).over(w.rowsBetween(Window.unboundedPreceding, 0)))), "is_latest": F.lead(DAY).over(w).isNull()})
    return out.join(F.broadcast(monthly), month == F.col("_m")).drop("_m")


def resolve_as_of(days: DataFrame, as_of: str | None) -> DataFrame:
    """The calendar's row of a day, or of the latest one if the day is unknown."""
    wanted = F.lit(as_of).cast("date")
    known = days.agg(F.coalesce(F.max(F.when(F.col(DAY) == wanted, F.col(DAY))), F.max(DAY)).alias("_d"))
    return days.join(F.broadcast(known), F.col(DAY) == F.col("_d")).drop("_d")


def conditions(filters: Sequence[tuple[str, str, object]]) -> Column:
    """(column, =, != or in, value) as one condition."""
    out = F.lit(True)
    for column, op, value in filters:
        c = F.col(column)
        out = out & {"=": lambda c=c, v=value: c == F.lit(v), "!=": lambda c=c, v=value: c != F.lit(v), "in": lambda c=c, v=value: c.isin(list(v))}[op]()
    return out


def _marked(view: DataFrame, now: date | None, prior: date | None) -> DataFrame:
    now, prior = (F.lit(d).cast("date") for d in (now, prior))
    return view.where((F.col(DAY) == now) | (F.col(DAY) == prior)).withColumns({"_is_now": F.col(DAY) == now, "_as_of": now})


def _two_days(view: DataFrame, as_of: str | None, basis: str) -> DataFrame:
    """Rows of the as-of day and its prior, marked _is_now. The two days are looked up first, so that they prune partitions.

    A filed table knows its days: they are its folders, no file is opened for them, and the other days are not read."""
    if isinstance(view, FiledTable):
        now, prior = days_for(view.days(), as_of, basis)
        return _marked(view.read([d for d in (now, prior) if d]), now, prior)
    found = resolve_as_of(calendar(view), as_of).select(F.col(DAY), F.col(basis)).first() or (None, None)
    return _marked(view, *found)


def days_for(days: Sequence[date], as_of: str | None, basis: str = "prior_day") -> tuple[date | None, date | None]:
    """The as-of day, or the latest if it is unknown, and its prior, from the days in order; as `calendar` and `resolve_as_of`."""
    if not days:
        return None, None
    wanted = date.fromisoformat(as_of) if as_of else None
    now = wanted if wanted in days else days[-1]
    at = days.index(now)
    if basis == "prior_day":
        return now, days[at - 1] if at else None
    if basis == "prior_week":
        return now, (days[max(at - 7, 0)] if at else None)
    if basis == "month_end":
        earlier = [d for d in days[:at] if (d.year, d.month) < (now.year, now.month)]
        return now, earlier[-1] if earlier else None
    raise ValueError(f"no such basis: {basis}")


def _value(measure: Measure, now: bool) -> Column:
    mark = "_is_now" if now else "not _is_now"
    where = f"({measure.where}) and {mark}" if measure.where else mark
    return Measure("value" if now else "prior", measure.agg, measure.field, where, measure.weight, measure.order, measure.money).column()


def query_scalar(view: DataFrame | FiledTable, measure: Measure, filters=(), as_of: str | None = None, basis: str = "prior_day") -> DataFrame:
    """Value at the as-of day and the prior; one row."""
    return _two_days(view, as_of, basis).where(conditions(filters)).agg(F.max("_as_of").alias(DAY), _value(measure, True), _value(measure, False))


def query_groups(view: DataFrame | FiledTable, measure: Measure, dims: Sequence[str], filters=(), as_of: str | None = None, basis: str = "prior_day") -> DataFrame:
    """Value and prior of each key that is present at the as-of day; a sum's missing prior is 0, another's null."""
    grouped = _two_days(view, as_of, basis).where(conditions(filters)).groupBy(*dims).agg(_value(measure, True), _value(measure, False), F.bool_or("_is_now").alias("_seen"))
    return grouped.where("_seen").drop("_seen")


def query_series(view: DataFrame, measure: Measure, dims: Sequence[str] = (), filters=(), trailing: int | None = None, as_of: str | None = None) -> DataFrame:
    """Values for each day up to as_of, of the keys that are present at as_of; with trailing, of so many days only."""
    rows = view.where(conditions(filters))
    rows = scan_trailing(rows, trailing, as_of) if trailing and as_of else rows.where(F.col(DAY) <= F.lit(as_of).cast("date")) if as_of else rows
    made = rows.groupBy(*dims, DAY).agg(Measure("value", measure.agg, measure.field, measure.where, measure.weight, measure.order, measure.money).column())
    if dims and as_of:
        present = rows.where(F.col(DAY) == F.lit(as_of).cast("date")).select(*dims).distinct()
        on = [made[d].eqNullSafe(present[d]) for d in dims]
        made = made.join(present, on, "left_semi")
    return made


def check_groups(view: DataFrame, dims: Sequence[str], most: int = 50_000) -> None:
    """Refuse a query of more groups than a dashboard can show; counts no further than that."""
    if view.select(*dims).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")


def compare(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A value beside another measure's: columns value and other."""
    return join_keys(left, right.withColumnRenamed("value", "other"), list(on))


def adhoc(left: DataFrame, right: DataFrame, on: Sequence[str], op: str) -> DataFrame:
    """ratio, delta or pct_change of two measures."""
    both = compare(left, right, on)
    x, y = F.col("value").cast("double"), F.col("other").cast("double")
    return both.withColumn("result", {"ratio": F.try_divide(x, y), "delta": x - y, "pct_change": F.try_divide(x - y, y) * 100}[op])
