"""Where documents stand: the stage of each, and its level in the graph of what reads what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .history import closure
from .keys import SPREAD

REPORT, MONITOR, VIEW = "report", "variance_monitor", "metrics_view"
#: Kinds of documents that feed others, whatever reads them.
FEEDING = ("source_binding", "prepared_source", "classification", "parameter_set")
ON_CYCLE, BEHIND_CYCLE = "on a cycle", "behind a cycle"


def stages(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """docs (name, kind, ...) with stage: prepare, file, watch or publish.

    A view prepares if some report files from it (an edge source -> target to a report), and else publishes; so does a
    document of no known kind. Names are taken to be unique; edges may repeat and name documents that are not there."""
    reports = docs.where(F.col("kind") == REPORT).select(F.col("name").alias("target"))
    filed = edges.join(reports, "target", "left_semi").select(F.col("source").alias("name")).distinct().withColumn("_filed", F.lit(True))
    kind = F.col("kind")
    stage = (
        F.when(kind == REPORT, "file").when(kind == MONITOR, "watch").when(kind.isin(*FEEDING), "prepare")
        .when(F.col("_filed"), "prepare").otherwise("publish")
    )
    return docs.join(filed, "name", "left").withColumn("stage", stage).drop("_filed")


def _anchors(edges: DataFrame, single: DataFrame) -> DataFrame:
    """node, anchor, steps: for a document that reads one other alone, the first one back that does not, by pointers that double.

    Where the way back only leads around a cycle, steps is null."""
    hops = stored(edges.join(single.hint(SPREAD), edges["target"] == single["node"]).select("node", F.col("source").alias("anchor"), F.lit(1).cast("long").alias("steps")), "hops")
    doublings = max(hops.count(), 1).bit_length() + 1
    for _ in range(doublings):
        onward = hops.select(F.col("node").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("steps").alias("_steps"))
        moved = hops.join(onward.hint(SPREAD), "anchor", "left")
        if moved.where("_anchor is not null").isEmpty():
            return hops
        hops = stored(moved.select("node", F.coalesce("_anchor", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), "hops")
    around = hops.select(F.col("node").alias("anchor")).distinct().withColumn("_around", F.lit(True))
    return hops.join(around.hint(SPREAD), "anchor", "left").select("node", "anchor", F.when(F.col("_around").isNull(), F.col("steps")).alias("steps"))


def levels(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """name, level and problem: a document that reads nothing has level 0, any other one more than the highest that it reads.

    edges: source is read by target; docs (name): adds documents without edges. Documents on a cycle, and those that read
    from one, have no level and the problem says which. Chains of documents that read one other alone are contracted first,
    in a number of rounds that is the logarithm of their length; what is left is peeled level by level."""
    edges = stored(edges.select("source", "target").dropna().distinct(), "edges")
    names = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    if docs is not None:
        names = names.union(docs.select("name").dropna())
    reads = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("_reads"))
    nodes = stored(names.distinct().join(reads.hint(SPREAD), "node", "left").select("node", F.coalesce("_reads", F.lit(0)).alias("_reads")), "nodes")
    back = stored(_anchors(edges, nodes.where("_reads = 1").select("node")), "anchors")
    merges = nodes.where("_reads > 1").select("node", "_reads")
    into = edges.join(merges.select(F.col("node").alias("target")).hint(SPREAD), "target", "left_semi")
    hop = into.join(back.withColumnRenamed("node", "source").hint(SPREAD), "source", "left")
    alone = F.col("anchor").isNull()
    steps = F.when(alone, F.lit(1).cast("long")).otherwise(F.col("steps") + 1)
    hop = stored(hop.select(F.coalesce("anchor", "source").alias("source"), "target", steps.alias("steps")), "contracted")
    known = stored(nodes.where("_reads = 0").select("node", F.lit(0).cast("long").alias("level")), "levels")
    while True:
        ready = hop.where("steps is not null").join(known.withColumnRenamed("node", "source").hint(SPREAD), "source")
        made = ready.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("_n"), F.max(F.col("level") + F.col("steps")).alias("level"))
        made = made.join(merges.hint(SPREAD), "node").where("_n = _reads").join(known.hint(SPREAD), "node", "left_anti").select("node", "level")
        made = stored(made, "levels")
        if made.isEmpty():
            break
        known = known.unionByName(made)
    chained = back.join(known.select(F.col("node").alias("anchor"), "level").hint(SPREAD), "anchor").select("node", (F.col("level") + F.col("steps")).alias("level"))
    found = stored(nodes.select("node").join(known.unionByName(chained).hint(SPREAD), "node", "left"), "levels")
    lost = found.where("level is null").select("node")
    problem = F.lit(None).cast("string")
    if lost.isEmpty():
        return found.select(F.col("node").alias("name"), "level", problem.alias("problem"))
    among = edges.join(lost.withColumnRenamed("node", "source").hint(SPREAD), "source", "left_semi").join(lost.withColumnRenamed("node", "target").hint(SPREAD), "target", "left_semi")
    round_ = closure(among).where(F.col("source") == F.col("target")).select(F.col("source").alias("node"), F.lit(True).alias("_round"))
    problem = F.when(F.col("level").isNotNull(), None).when(F.col("_round"), ON_CYCLE).otherwise(BEHIND_CYCLE)
    return found.join(round_.hint(SPREAD), "node", "left").select(F.col("node").alias("name"), "level", problem.alias("problem"))
