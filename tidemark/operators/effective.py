"""Effective-dated versions: the one in force on each row's day, and the days that have none or several.

A version is in force on [effective_from, effective_to); an open end never ends. A version without a start, or with an end
that is not after it, is never in force."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "effective_from", "effective_to"
FOREVER = datetime.date(9999, 12, 31)
SLICES, SALTS = 64, 8  # stretches of time, and shares of the rows in each, that a merge deals a key out to
HOT_ROWS = 500_000  # rows of a key from which a merge deals it out
STRETCH = 32  # days of a stretch when versions are sent to every task instead
SMALL_BYTES = 16 << 20  # which is done up to this size


def _dated(versions: DataFrame) -> DataFrame:
    """_from and _to as dates, for versions that are in force at all."""
    ends = F.coalesce(F.col(END).cast("date"), F.lit(FOREVER))
    return versions.withColumns({"_from": F.col(START).cast("date"), "_to": ends}).where("_from < _to")


def overlapping(versions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Versions that begin before an earlier one of their key has ended."""
    earlier = Window.partitionBy(*keys).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max("_to").over(earlier)
    return _dated(versions).withColumn("_ended", ended).where("_ended > _from").drop("_ended", "_from", "_to")


def _slice(day: Column, first: datetime.date, width: int, slices: int) -> Column:
    """The stretch of time that a day is in: -1 before the first start, `slices` from the end of the last stretch on."""
    place = F.floor(F.datediff(day, F.lit(first)) / width)
    return F.greatest(F.lit(-1), F.least(F.lit(slices), place)).cast("int")


def _pieces(versions: DataFrame, first: datetime.date, width: int, slices: int) -> DataFrame:
    """A row for each stretch of time that a version is in force in, with its number _slice."""
    last = _slice(F.date_sub("_to", 1), first, width, slices)
    return versions.withColumn("_slice", F.explode(F.sequence(_slice(F.col("_from"), first, width, slices), last)))


def join_in_force(df: DataFrame, versions: DataFrame, date_col: str, keys: Sequence[str] = (), small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Each row with the version in force on its own date; without one, nulls. Null dates and null keys have none.

    Versions of a key that overlap are refused, as they would multiply rows, and so are columns that both sides have.
    Versions are measured first, in one job. Up to small_bytes they are sent to every task and found by key and stretch of
    time, so that rows are not shuffled; beyond that `merged` shuffles the rows once."""
    added = [c for c in versions.columns if c not in keys]
    if clash := [c for c in added if c in df.columns]:
        raise ValueError(f"both sides have {', '.join(clash)}")
    keyed = _dated(versions.dropna(subset=list(keys)) if keys else versions)
    first, days, size, n, groups = _measured(keyed, keys)
    if not n:
        return df.select("*", *[F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in added])
    rows = df.withColumn("_day", F.col(date_col).cast("date"))
    stretches = days // STRETCH + 1
    if size / n * (n + groups * (stretches + 1)) > small_bytes:
        return merged(rows, keyed, keys, added, first, days // SLICES + 1).select(*df.columns, *added)
    # versions that follow each other last a day at least, so a key has STRETCH + 1 of them at most in a stretch
    of = [F.col(k).alias(f"_k_{k}") for k in keys]
    pieces = F.broadcast(_pieces(keyed, first, STRETCH, stretches).select(*of, *added, "_slice", "_from", "_to"))
    on = (_slice(F.col("_day"), first, STRETCH, stretches) == pieces["_slice"]) & (F.col("_day") >= pieces["_from"]) & (F.col("_day") < pieces["_to"])
    for k in keys:
        on = on & (rows[k] == pieces[f"_k_{k}"])
    return rows.join(pieces, on, "left").select(*[rows[c] for c in df.columns], *[pieces[c] for c in added])


def _measured(keyed: DataFrame, keys: Sequence[str]) -> tuple[datetime.date, int, int, int, int]:
    """First start, days from there to the last start or end, bytes, versions, and keys; refuses overlaps. One job."""
    own = Window.partitionBy(*keys).orderBy("_from", "_to")
    ended = F.max("_to").over(own.rowsBetween(Window.unboundedPreceding, -1))
    row = F.octet_length(F.to_json(F.struct(*[c for c in keyed.columns if not c.startswith("_")])))
    marked = keyed.select("_from", "_to", row.alias("_b"), F.row_number().over(own).alias("_n"), (ended > F.col("_from")).alias("_over"))
    last = F.max(F.when(F.col("_to") == F.lit(FOREVER), F.col("_from")).otherwise(F.col("_to")))
    found = marked.agg(F.min("_from"), F.datediff(last, F.min("_from")), F.sum("_b"), F.count("*"), F.count_if(F.col("_n") == 1), F.bool_or("_over")).first()
    if found[5]:
        raise ValueError("versions overlap" + (f" for a key of {', '.join(keys)}" if keys else ""))
    return tuple(found)[:5]


def merged(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], added: Sequence[str], first: datetime.date, width: int) -> DataFrame:
    """Rows (with _day) and versions in one list by key and day, where every row takes the last version that began.

    One shuffle, whatever the number of versions. A key of more than HOT_ROWS rows, which are counted first, is dealt out by
    stretches of time, into which the version that is in force goes along, and the rows of a stretch by their input
    partition, so that no such key and no day of it is one task. The versions of all other keys are there once."""
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int")
    row = F.struct(*[F.col(c) for c in rows.columns])
    version = F.struct(*[F.col(c) for c in added], F.col("_to").alias("_until"))
    own = [F.col(k).alias(f"_k_{k}") for k in keys]
    hot = None
    if keys:  # at most one key for each HOT_ROWS rows
        hot = F.broadcast(rows.groupBy(*own).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(*[F.col(f"_k_{k}").alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot")))

    def marked(df: DataFrame) -> DataFrame:
        """df with _hot; without keys everything is."""
        if hot is None:
            return df.withColumn("_hot", F.lit(True))
        on = reduce(lambda x, y: x & y, [F.col(f"_k_{k}").eqNullSafe(F.col(f"_h_{k}")) for k in keys])
        return df.join(hot, on, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))

    given = marked(keyed.select(*own, "_from", "_to", version.alias("_version")))
    dealt = _pieces(given.where("_hot"), first, width, SLICES).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    versions = dealt.unionByName(given.where("not _hot").withColumns({"_slice": F.lit(0), "_salt": F.lit(0)}))
    ahead = versions.select(*[f"_k_{k}" for k in keys], "_slice", "_salt", F.col("_from").alias("_at"), F.lit(0).alias("_kind"), "_version")
    listed = marked(rows.select(*own, F.col("_day").alias("_at"), salt.alias("_salt"), row.alias("_row")))
    at = F.when(F.col("_hot"), _slice(F.col("_at"), first, width, SLICES)).otherwise(0).alias("_slice")
    listed = listed.select(*[f"_k_{k}" for k in keys], at, F.when(F.col("_hot"), F.col("_salt")).otherwise(0).alias("_salt"), "_at", F.lit(1).alias("_kind"), "_row")
    both = listed.unionByName(ahead, allowMissingColumns=True)
    line = Window.partitionBy(*[f"_k_{k}" for k in keys], "_slice", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_version", ignorenulls=True).over(line)).where("_kind = 1")
    holds = F.col("_at") < F.col("_found._until")
    return found.select("_row.*", *[F.when(holds, F.col(f"_found.{c}")).alias(c) for c in added])


def coverage(versions: DataFrame, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, from_day, to_day (not included) and versions: the stretches of [first, last] with the same number of versions in force.

    A sweep: each version adds one where it begins and takes one where it ends, events of a day are added up first, and a
    running sum over the days that have any gives the number. A key is listed if a version of it lies in the range; without
    keys the whole range is."""
    start, stop = F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 1)
    cut = _dated(versions).select(*keys, F.greatest("_from", start).alias("_a"), F.least("_to", stop).alias("_b")).where("_a < _b")
    of = lambda day, by: F.struct(day.alias("from_day"), F.lit(by).alias("_by"))
    both = F.array(of(start, 0), of(F.col("_a"), 1), of(F.col("_b"), -1), of(stop, 0))
    events = cut.select(*keys, F.explode(both).alias("e")).select(*keys, "e.*")
    if not keys:
        events = events.unionByName(versions.sparkSession.range(1).select(F.explode(F.array(of(start, 0), of(stop, 0))).alias("e")).select("e.*"))
    daily = events.groupBy(*keys, "from_day").agg(F.sum("_by").alias("_by"))  # as many rows as days with an event, for each key
    line = Window.partitionBy(*keys).orderBy("from_day")
    swept = daily.withColumns({"versions": F.sum("_by").over(line.rowsBetween(Window.unboundedPreceding, 0)), "to_day": F.lead("from_day").over(line)})
    # stretches that follow each other with the same number are one
    new = swept.withColumn("_new", ~F.col("versions").eqNullSafe(F.lag("versions").over(line)))
    groups = new.where("to_day is not null").withColumn("_g", F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(*keys, "_g", "versions").agg(F.min("from_day").alias("from_day"), F.max("to_day").alias("to_day")).select(*keys, "from_day", "to_day", "versions")


def _named(problems: DataFrame) -> DataFrame:
    return problems.withColumn("problem", F.when(F.col("versions") == 0, "gap").otherwise("overlap"))


def effective_stretches(versions: DataFrame, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
    """Stretches of a range that no version, or more than one, covers."""
    return _named(coverage(versions, first, last, keys).where("versions <> 1"))


def effective_problems(versions: DataFrame, first: str, last: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days of a range that no version, or more than one, covers."""
    days = F.explode(F.sequence("from_day", F.date_sub("to_day", 1))).alias("day")
    return _named(coverage(versions, first, last, keys).where("versions <> 1").select(*keys, days, "versions"))
