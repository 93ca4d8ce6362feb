"""What a change of definitions does: both versions over the same data, compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_keys
from .rules import UNMAPPED

DAY = "as_of_date"


def impact_breaches(before: DataFrame, after: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Breaches silenced and added for each threshold: how many, on how many series, and the largest move among them."""
    on = ["threshold_id", *grain, DAY]
    key = F.struct(*grain)
    side = lambda a, b, name: join_keys(a, b.select(*on), on, "left_anti").groupBy("threshold_id").agg(F.count("*").alias("breaches"), F.countDistinct(key).alias("series"), F.max(F.abs("delta")).cast("double").alias("largest_move")).withColumn("change", F.lit(name))
    return side(before, after, "silenced").unionByName(side(after, before, "added"))


def coverage_loss(before: DataFrame, after: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Thresholds that are gone, and those that watch fewer keys, from judged points."""
    watched = lambda d, n: d.where("verdict <> 'not_applicable'").groupBy("threshold_id").agg(F.countDistinct(F.struct(*grain)).alias(n))
    known = before.select("threshold_id").distinct().join(watched(before, "keys_before"), "threshold_id", "left")
    kept = after.select("threshold_id", F.lit(True).alias("there")).distinct().join(watched(after, "keys_after"), "threshold_id", "left")
    joined = known.join(kept, "threshold_id", "left").select("threshold_id", F.col("there").isNull().alias("removed"), F.coalesce("keys_before", F.lit(0)).alias("keys_before"), F.coalesce("keys_after", F.lit(0)).alias("keys_after"))
    return joined.where("removed or keys_after < keys_before")


def reclassified(moved: DataFrame) -> DataFrame:
    """A migration with a flag where records lose their value."""
    return moved.withColumn("newly_unmapped", (F.col("to_value") == UNMAPPED) & (F.col("from_value") != UNMAPPED))


def impact_rates(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str = "rate", citation: str = "citation") -> DataFrame:
    """Rates changed, added or removed; a changed rate under the old citation is marked."""
    a = before.select(*keys, F.col(value).alias("rate_before"), F.col(citation).alias("_c_before"), F.lit(True).alias("_b"))
    b = after.select(*keys, F.col(value).alias("rate_after"), F.col(citation).alias("_c_after"), F.lit(True).alias("_a"))
    both = join_keys(a, b, list(keys), "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("rate_before").eqNullSafe(F.col("rate_after")), "changed")
    out = both.withColumns({"change": change, "uncited": (change == "changed") & F.col("_c_before").eqNullSafe(F.col("_c_after"))})
    return out.where("change is not null").select(*keys, "rate_before", "rate_after", "change", "uncited")


def impact_report(before: DataFrame, after: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Members of a report's array columns (grain, measures, targets) that went or came: part, member, change."""
    rows = []
    pair = before.select("report", *[F.col(p).alias(f"a_{p}") for p in parts]).join(after.select("report", *[F.col(p).alias(f"b_{p}") for p in parts]), "report")
    for p in parts:
        for x, y, name in (("a", "b", "removed"), ("b", "a", "added")):
            rows.append(pair.select("report", F.lit(p).alias("part"), F.explode(F.array_except(f"{x}_{p}", f"{y}_{p}")).alias("member"), F.lit(name).alias("change")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def impact_measures(before: DataFrame, after: DataFrame, relative: float = 1e-9) -> DataFrame:
    """Values (columns name, value) that move, appear or vanish."""
    a, b = before.select("name", F.col("value").alias("value_before")), after.select("name", F.col("value").alias("value_after"))
    x, y = F.col("value_before"), F.col("value_after")
    change = F.when(x.isNull() & y.isNotNull(), "appeared").when(x.isNotNull() & y.isNull(), "vanished").when(F.abs(x - y) > relative * F.greatest(F.abs(x), F.abs(y)), "moved")
    return join_keys(a, b, ["name"], "full_outer").withColumn("change", change).where("change is not null")


def impact_summary(findings: Sequence[tuple[str, int, bool, DataFrame]]) -> DataFrame:
    """How many findings of each kind (name, rank of its consequence, whether it weakens a control), and whether the whole needs review."""
    out = None
    for name, rank, weakens, df in findings:
        one = df.agg(F.count("*").alias("findings")).select(F.lit(name).alias("kind"), F.lit(rank).alias("rank"), "findings", (F.lit(weakens) & (F.col("findings") > 0)).alias("weakens"))
        out = one if out is None else out.unionByName(one)
    review = out.agg(F.bool_or("weakens").alias("needs_review"))
    return out.where("findings > 0").crossJoin(F.broadcast(review))


def promote(findings: DataFrame, acknowledged: bool) -> None:
    """Refuse to promote a candidate that weakens a control, unless that is acknowledged."""
    if not acknowledged and not findings.where("weakens").isEmpty():
        raise ValueError("the candidate weakens controls: " + ", ".join(r["kind"] for r in findings.where("weakens").orderBy("rank").collect()))
