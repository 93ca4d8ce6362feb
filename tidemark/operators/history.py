"""Definition history: revisions, releases, channels, lineage, activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import between_effective
from ..sources.sinks import checkpoints
from .keys import SPREAD, join_keys


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The last revision of every artifact."""
    rest = [c for c in revisions.columns if c != "name"]
    return revisions.groupBy("name").agg(F.max_by(F.struct(*rest), F.col("revision_no")).alias("r")).select("name", "r.*")


def as_known_at(revisions: DataFrame, at) -> DataFrame:
    """The workspace as it was known at a time."""
    return latest_revision(revisions.where(F.col("created_at") <= F.lit(at).cast("timestamp")))


def bitemporal(revisions: DataFrame, at, day) -> DataFrame:
    """Known at a time and in force on a day."""
    return as_known_at(revisions, at).where(between_effective(F.lit(day).cast("date"), F.col("effective_from"), F.col("effective_to")))


def revision_history(revisions: DataFrame) -> DataFrame:
    return revisions.select("name", "revision_no", F.length("body").alias("size"), "created_at")


def append_revisions(revisions: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows to append: batch entries (name, body, seq) whose content differs from the one before, numbered on from the latest."""
    latest = latest_revision(revisions).select("name", F.sha2("body", 256).alias("_hash"), F.col("revision_no").alias("_no"))
    w = Window.partitionBy("name").orderBy("seq")
    joined = batch.withColumn("content_hash", F.sha2("body", 256)).join(latest, "name", "left")
    fresh = joined.withColumn("_before", F.coalesce(F.lag("content_hash").over(w), F.col("_hash"))).where(~F.col("content_hash").eqNullSafe(F.col("_before")))
    return fresh.select("name", "seq", "content_hash", (F.coalesce("_no", F.lit(0)) + F.row_number().over(w)).alias("revision_no"))


def release_contents(pins: DataFrame, revisions: DataFrame) -> DataFrame:
    """What a release holds: its pins with their revisions."""
    return pins.join(revisions, ["name", "revision_no"])


def channel_at(promotions: DataFrame, at) -> DataFrame:
    """The release that each channel serves at a time."""
    return promotions.where(F.col("created_at") <= F.lit(at).cast("timestamp")).groupBy("channel").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def ahead_of_release(revisions: DataFrame, deployed: DataFrame) -> DataFrame:
    """Artifacts whose latest content differs from what is deployed (name, content_hash), or is not deployed."""
    latest = latest_revision(revisions).select("name", "revision_no", F.sha2("body", 256).alias("_h"))
    joined = latest.join(deployed.select("name", F.col("content_hash").alias("_d")), "name", "left")
    return joined.where(~F.col("_h").eqNullSafe(F.col("_d"))).select("name", "revision_no", F.when(F.col("_d").isNull(), "new").otherwise("changed").alias("status"))


def stale_pins(board: DataFrame, revisions: DataFrame) -> DataFrame:
    """Board items (board, item, name, revision_no) that are bound to an older revision."""
    latest = latest_revision(revisions).select("name", F.col("revision_no").alias("latest_no"))
    return board.join(latest, "name").where("revision_no < latest_no").groupBy("board", "name", "latest_no").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All dependents of each artifact: source, target, least number of steps, up to max_depth of them if it is given.

    Paths double with each round: those of exactly as many steps as are known go on by all known ones. Each round is a
    checkpoint in the shared folder, as plans of rounds within rounds would double too."""
    checkpoints(edges.sparkSession)
    known = ahead = edges.select("source", "target").distinct().withColumn("depth", F.lit(1)).checkpoint()
    reach = 1
    while max_depth is None or reach < max_depth:
        onward = known.select(F.col("source").alias("_mid"), "target", F.col("depth").alias("_more"))
        longer = ahead.select("source", F.col("target").alias("_mid"), "depth").join(onward.hint(SPREAD), "_mid").groupBy("source", "target").agg(F.min(F.col("depth") + F.col("_more")).alias("depth"))
        new = longer.join(known.select("source", "target").hint(SPREAD), ["source", "target"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        known, reach = known.unionByName(new), 2 * reach
        ahead = new.where(F.col("depth") == reach)
    return known if max_depth is None else known.where(F.col("depth") <= max_depth)


def activity_metrics(events: DataFrame) -> DataFrame:
    """For each board: decisions, share approved, median wait (the upper of the two in the middle), and versions."""
    rate = F.try_divide(F.count_if("approved").cast("double"), F.count("*").cast("double"))
    about = events.groupBy("board").agg(F.count("*").alias("decisions"), rate.alias("approval_rate"), F.countDistinct("version").alias("versions"))
    waits = upper_middle(events, "board", "wait_hours").withColumnRenamed("middle", "median_wait")
    return join_keys(about, waits, ["board"]).select("board", "decisions", "approval_rate", "median_wait", "versions")


def upper_middle(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group and middle: the middle value of each group without its nulls, of an even number the upper of the two.

    Equal values are counted first, by part before the shuffle, so what a group keeps together is its distinct values; they
    are summed up in order and the one that goes over half is taken."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    upto = F.sum("_n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    summed = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(own)})
    half = F.floor(F.col("_all") / 2)  # so many values lie before the middle one
    return summed.where((F.col("_upto") > half) & (F.col("_upto") - F.col("_n") <= half)).select(group, F.col(value).alias("middle"))


def activity_counts(fixes: DataFrame, boards: DataFrame, proposals: DataFrame) -> DataFrame:
    """figure, name and n: fixes applied by rule (column rule), and boards and proposals by status (column status), with a row of name null for all of each."""
    parts = [("fixes", fixes.select(F.col("rule").alias("name"))), ("boards", boards.select(F.col("status").alias("name"))), ("proposals", proposals.select(F.col("status").alias("name")))]
    listed = reduce(DataFrame.unionByName, [df.select(F.lit(figure).alias("figure"), F.coalesce("name", F.lit("(none)")).alias("name")) for figure, df in parts])
    return listed.rollup("figure", "name").agg(F.count("*").alias("n")).where("figure is not null")
