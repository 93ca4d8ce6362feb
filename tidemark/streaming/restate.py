"""Row stages over streams, and restating filed days when late rows arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Step, row_stage
from ..sources.filed import folder, folders, read_folders
from ..sources.sinks import write_partitions

TOTAL = "decimal(38,4)"


def staged_stream(spark: SparkSession, path: str, schema, steps: Sequence[Step], files_per_trigger: int = 1) -> DataFrame:
    """The same row stage as for a batch: it keeps no state, so it runs on a stream as it is."""
    return row_stage(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), steps)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to a table, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def add_batch(batch: DataFrame, number: int, totals: str, table: str, keys: Sequence[str], amounts: Sequence[str], day: str = "as_of_date") -> None:
    """File the days that a batch touches again: their totals so far and the batch's own sums, added up.

    Totals are kept by day in two folders, 0 and 1, each with the number of the batch that it is complete with. A batch
    reads the newer of those from before it and writes the other one. So it reads the batch and the totals of its own
    days, never raw rows of earlier batches nor other days; and one that runs again finds the same totals as at first, so
    nothing counts twice. Rows without a day are filed in the partition of null."""
    spark = batch.sparkSession
    sums = [F.sum(a).cast(TOTAL).alias(a) for a in amounts]
    partial = batch.groupBy(*keys, day).agg(*sums, F.count("*").alias("records")).persist()
    try:
        touched = [r[0] for r in partial.select(day).distinct().collect()]  # days, not rows
        names = [f"{folder(day, d)}/{n}" for d in touched for n in folders(spark, f"{totals}/{folder(day, d)}")]
        kinds = dict(partial.dtypes)
        columns = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *amounts, "records"])
        known = read_folders(spark, totals, f"{columns}, _batch long, `{day}` {kinds[day]}, _slot int", names).where(F.col("_batch") < number)
        newest = known.groupBy(day).agg(F.max_by("_slot", "_batch").alias("_newest"))  # two rows a day at most come in
        on = known[day].eqNullSafe(newest[day]) & (known["_slot"] == newest["_newest"])
        before = known.join(F.broadcast(newest), on, "left_semi")
        slots = partial.select(day).distinct()
        slot = F.when(newest["_newest"] == 0, 1).otherwise(0).alias("_slot")
        slots = slots.join(F.broadcast(newest), slots[day].eqNullSafe(newest[day]), "left").select(slots[day].alias("_day"), slot)
        both = partial.unionByName(before.select(*partial.columns))
        made = both.groupBy(*keys, day).agg(*sums, F.sum("records").alias("records"))
        placed = made.join(F.broadcast(slots), made[day].eqNullSafe(slots["_day"])).drop("_day").withColumn("_batch", F.lit(number).cast("long"))
        write_partitions(placed, totals, [day, "_slot"])
        # what was just written is what is filed
        written = read_folders(spark, totals, f"{columns}, _batch long, `{day}` {kinds[day]}, _slot int", [folder(day, d) for d in touched])
        write_partitions(written.where(F.col("_batch") == number).select(*keys, *amounts, "records", day), table, [day])
    finally:
        partial.unpersist()


def restate(stream: DataFrame, totals: str, table: str, checkpoint: str, keys: Sequence[str], amounts: Sequence[str], day: str = "as_of_date") -> None:
    """File a stream by day, and file a day again whenever rows of it arrive, however late; see `add_batch`."""

    def once(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, totals, table, keys, amounts, day)

    stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
