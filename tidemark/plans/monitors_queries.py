"""Queries of monitors, impact of changes, dashboards and presentation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import case_branch
from ..operators import impact as I
from ..operators import present as P
from ..operators import query as Q
from ..operators import rules as C
from ..operators import variance as V
from ..operators.measures import Measure
from .fixtures import ACTIVITY, FILED, LADDER, POSITIONS, PRODUCT, RULES, RULES_AFTER, STAGED, activity, filed, positions, staged
from .registry import query, values
from .rules_measures import AFTER, MIGRATION

THRESHOLDS = [
    V.Threshold("abs", "static_abs", 1500.0, "low"), V.Threshold("pct", "static_pct", 40.0, "medium"), V.Threshold("sigma30", "stddev_30d", 2.0, "high"),
    V.Threshold("sigma60", "stddev_60d", 2.5, "medium"), V.Threshold("clicks", "static_abs", 500.0, "high", "key = 'click'"),
]
LOOSER = [V.Threshold("abs", "static_abs", 2500.0, "low"), V.Threshold("pct", "static_pct", 40.0, "medium"), V.Threshold("sigma30", "stddev_30d", 1.5, "high"), V.Threshold("clicks", "static_abs", 500.0, "high", "key = 'none'")]
DAY = "2024-01-20"


def rolled_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rollup(activity(spark, sf_dir).withColumnRenamed("event_type", "key").withColumn("value", F.round("value", 2)), "value", ["key"])


def rolled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("as_of_date"), F.col("o_orderpriority").alias("key"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return V.rollup(o, "price", ["key"])


ROLL_A = f"{ACTIVITY}, rolled as (select event_type as key, as_of_date, sum(round(value, 2))::decimal(38,2) as value from activity group by 1, 2)"
ROLL_O = "rolled as (select o_orderpriority as key, cast(o_orderdate as date) as as_of_date, sum(cast(o_totalprice as decimal(18,2)))::decimal(38,2) as value from orders group by 1, 2)"
POINTS = """p0 as (select *, lag(value) over w as prior, lag(as_of_date) over w as prior_date from rolled window w as (partition by key order by as_of_date)),
p1 as (select *, value - prior as delta, (value - prior)::double / nullif(abs(prior), 0)::double * 100 as pct from p0),
points as (select *, stddev_samp(delta::double) over (partition by key order by as_of_date rows between 30 preceding and 1 preceding) as sigma_30, count(delta) over (partition by key order by as_of_date rows between 30 preceding and 1 preceding) as n_30,
  stddev_samp(delta::double) over (partition by key order by as_of_date rows between 60 preceding and 1 preceding) as sigma_60, count(delta) over (partition by key order by as_of_date rows between 60 preceding and 1 preceding) as n_60 from p1)"""


def _judged_sql(name: str, thresholds: list[V.Threshold]) -> str:
    parts = []
    for t in thresholds:
        size = "abs(pct)" if t.basis == "static_pct" else "abs(delta)::double"
        n = t.basis.removeprefix("stddev_").removesuffix("d")
        sigma = t.basis.startswith("stddev")
        limit = f"case when n_{n} >= 10 and sigma_{n} > 0 then sigma_{n} * {t.limit}::double end" if sigma else f"{t.limit}::double"
        scope = f"not coalesce({t.applies_to}, false)" if t.applies_to else "false"
        parts.append(
            f"select key, as_of_date, value, prior, delta, '{t.id}' as threshold_id, '{t.basis}' as basis, '{t.severity}' as severity, {limit} as limit_value, {f'sigma_{n}' if sigma else 'null::double'} as sigma, {f'n_{n}' if sigma else 'null::bigint'} as observations, "
            f"case when {scope} then 'not_applicable' when {size} is null or {limit} is null then 'insufficient' when {size} > {limit} then 'breach' else 'pass' end as verdict from points"
        )
    return f"{name} as (" + " union all ".join(parts) + ")"


JUDGED_A = f"with {ROLL_A}, {POINTS}, {_judged_sql('judged', THRESHOLDS)}"
_d = lambda df, *cols: df.withColumns({c: F.col(c).cast("double") for c in cols})
_judged = lambda s, d, t=THRESHOLDS: V.judge(V.points(rolled_activity(s, d), ["key"]), t)
_shown = "key, as_of_date, threshold_id, verdict, round(limit_value, 4) as limit_value, round(sigma, 4) as sigma, observations, delta::double as delta"
_show = lambda df: _d(df, "delta").select("key", "as_of_date", "threshold_id", "verdict", F.round("limit_value", 4).alias("limit_value"), F.round("sigma", 4).alias("sigma"), "observations", "delta")

query("var_rollup", f"with {FILED} select product_id, entity_id, as_of_date, sum(weighted_outflow_30d)::double as value from filed group by 1, 2, 3")(lambda s, d: _d(V.rollup(filed(s, d), "weighted_outflow_30d", ["product_id", "entity_id"]), "value"))
query("var_change", f"with {ROLL_O}, {POINTS} select key, as_of_date, value::double as value, prior::double as prior, prior_date, delta::double as delta, pct from points")(
    lambda s, d: _d(V.points(rolled_orders(s, d), ["key"]), "value", "prior", "delta").select("key", "as_of_date", "value", "prior", "prior_date", "delta", "pct")
)
query("var_gap_days", f"with {ROLL_O}, days as (select as_of_date, row_number() over (order by as_of_date) as place from (select distinct as_of_date from rolled)) select key, as_of_date, (place - lag(place) over (partition by key order by as_of_date))::int as gap_days from rolled join days using (as_of_date)")(
    lambda s, d: V.gap_days(rolled_orders(s, d), ["key"]).select("key", "as_of_date", "gap_days")
)
query("var_sigma", f"with {ROLL_O}, {POINTS} select key, as_of_date, round(sigma_30, 4) as sigma_30, n_30, round(sigma_60, 4) as sigma_60, n_60 from points")(
    lambda s, d: V.points(rolled_orders(s, d), ["key"]).select("key", "as_of_date", F.round("sigma_30", 4).alias("sigma_30"), "n_30", F.round("sigma_60", 4).alias("sigma_60"), "n_60")
)
query(
    "var_appeared",
    f"""with {ROLL_O}, days as (select distinct as_of_date from rolled), grid as (select k.key, d.as_of_date, r.value is not null as present from (select distinct key from rolled) k cross join days d left join rolled r on r.key = k.key and r.as_of_date = d.as_of_date),
g as (select *, lag(present) over (partition by key order by as_of_date) as was, count(*) filter (where present) over (partition by key order by as_of_date rows between unbounded preceding and 1 preceding) as seen from grid)
select key, as_of_date, 'appeared' as event from g where present and seen = 0 and as_of_date <> (select min(as_of_date) from days) union all select key, as_of_date, 'disappeared' from g where not present and was""",
)(lambda s, d: V.appeared(rolled_orders(s, d), ["key"]))
query("var_judged", f"{JUDGED_A} select {_shown} from judged")(lambda s, d: _show(_judged(s, d)))
query("var_scoped", f"{JUDGED_A} select key, verdict, count(*) as n from judged where threshold_id = 'clicks' group by 1, 2")(lambda s, d: _judged(s, d).where("threshold_id = 'clicks'").groupBy("key", "verdict").agg(F.count("*").alias("n")))
_rank = "case severity when 'high' then 1 when 'medium' then 2 else 3 end::int"
query("var_breaches", f"{JUDGED_A} select {_shown}, {_rank} as severity_rank, abs(delta)::double as change_size from judged where verdict = 'breach' order by severity_rank, change_size desc")(
    lambda s, d: (lambda b: _show(b).withColumn("severity_rank", F.element_at(F.create_map(*[F.lit(x) for t in THRESHOLDS for x in (t.id, V.SEVERITIES.index(t.severity) + 1)]), F.col("threshold_id"))).withColumn("change_size", F.abs("delta")).orderBy("severity_rank", F.desc("change_size")))(V.breaches(_judged(s, d)))
)
_tally = ", ".join(f"count(*) filter (where verdict = '{v}') as n_{v}" for v in ("breach", "pass", "insufficient", "not_applicable"))
_stats = f"stats as (select threshold_id, {_tally}, count(distinct key) as keys_watched, count(*) as key_days from judged group by 1)"
query("var_stats", f"{JUDGED_A}, {_stats} select * from stats")(lambda s, d: V.monitor_stats(_judged(s, d), ["key"]))
query("var_behaviour", f"{JUDGED_A}, {_stats} select threshold_id, case when key_days = 0 then 'nothing evaluated' when n_breach + n_pass + n_insufficient = 0 then 'applies to nothing' when n_insufficient > 0.5 * (n_breach + n_pass + n_insufficient) then 'mostly insufficient' when n_breach = 0 then 'never fires' when n_breach > 0.25 * (n_breach + n_pass) then 'fires too often' else 'ok' end as finding from stats")(
    lambda s, d: V.behaviour(V.monitor_stats(_judged(s, d), ["key"]))
)
_exc = f"select 'activity' as monitor, key, threshold_id, severity, key || ' moved ' || delta::varchar || ' against ' || prior::varchar || ' (' || basis || ')' as message from judged where verdict = 'breach' and as_of_date = date '{DAY}'"
query("exceptions_for_date", f"{JUDGED_A} {_exc}")(lambda s, d: V.exceptions([("activity", _judged(s, d))], F.col("key"), DAY))


@query(
    "exception_strip",
    f"""{JUDGED_A}, b as (select threshold_id || '/' || key as id, 'breach' as kind, {_rank} as severity_rank, abs(delta)::double as size from judged where verdict = 'breach' and as_of_date = date '{DAY}'
  union all select * from (values ('upgrade/lcr', 'upgrade', 2, 0.0::double), ('upgrade/nsfr', 'upgrade', 2, 0.0)))
select *, row_number() over (order by severity_rank, size desc, id)::int as rank from b where id not in ('upgrade/nsfr', 'abs/click')""",
)
def exception_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.breaches(_judged(spark, sf_dir).where(F.col("as_of_date") == F.lit(DAY).cast("date")))
    breached = found.select(F.concat_ws("/", "threshold_id", "key").alias("id"), F.lit("breach").alias("kind"), "severity_rank", F.col("change_size").alias("size"))
    upgrades = values(spark, [("upgrade/lcr", "upgrade", 2, 0.0), ("upgrade/nsfr", "upgrade", 2, 0.0)], "id string, kind string, severity_rank int, size double")
    return V.exception_strip(breached, upgrades, values(spark, [("upgrade/nsfr",), ("abs/click",)], "id string"))


# --- impact ------------------------------------------------------------------------------------------------------

BOTH = f"{JUDGED_A}, {_judged_sql('after', LOOSER)}"
_breached = lambda n, t: f"{n} as (select threshold_id, key, as_of_date, delta from {t} where verdict = 'breach')"
_diff = lambda a, b, name: f"select threshold_id, count(*) as breaches, count(distinct key) as series, max(abs(delta))::double as largest_move, '{name}' as change from {a} where (threshold_id, key, as_of_date) not in (select (threshold_id, key, as_of_date) from {b}) group by 1"
_sides = f"{BOTH}, {_breached('ba', 'judged')}, {_breached('bb', 'after')}"
query("impact_breaches", f"{_sides} {_diff('ba', 'bb', 'silenced')} union all {_diff('bb', 'ba', 'added')}")(lambda s, d: I.impact_breaches(V.breaches(_judged(s, d)), V.breaches(_judged(s, d, LOOSER)), ["key"]))
_cov = "a as (select threshold_id, count(distinct key) filter (where verdict <> 'not_applicable') as keys_before from judged group by 1), b as (select threshold_id, count(distinct key) filter (where verdict <> 'not_applicable') as keys_after from after group by 1)"
query("impact_coverage_loss", f"{BOTH}, {_cov} select threshold_id, b.threshold_id is null as removed, keys_before, coalesce(keys_after, 0) as keys_after from a left join b using (threshold_id) where b.threshold_id is null or keys_after < keys_before")(
    lambda s, d: I.coverage_loss(_judged(s, d), _judged(s, d, LOOSER), ["key"])
)
query("impact_reclass", f"select *, to_value = '(unmapped)' and from_value <> '(unmapped)' as newly_unmapped from ({MIGRATION})")(lambda s, d: I.reclassified(C.migration(positions(s, d), RULES, RULES_AFTER, "balance_usd")))


def _rate_table(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """A rate for each segment and priority of the data; the second version lacks some, adds some, changes some."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    pairs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    n = F.length("segment") + F.length("priority")
    rate = (n * 3 + F.lit(step) * F.when(n % 3 == 0, 1).otherwise(0)).cast("double")
    return pairs.where(n % 5 != step).select("segment", "priority", rate.alias("rate"), F.when((n % 2 == 0) | F.lit(step == 0), "v1").otherwise("v2").alias("citation"))


_rates_sql = lambda name, step: f"{name} as (select c_mktsegment as segment, o_orderpriority as priority, (length(c_mktsegment) + length(o_orderpriority)) * 3 + {step} * (case when (length(c_mktsegment) + length(o_orderpriority)) % 3 = 0 then 1 else 0 end)::double as rate, case when (length(c_mktsegment) + length(o_orderpriority)) % 2 = 0 or {step} = 0 then 'v1' else 'v2' end as citation from orders join customer on o_custkey = c_custkey where (length(c_mktsegment) + length(o_orderpriority)) % 5 <> {step} group by all)"
query("impact_rates", f"with {_rates_sql('a', 0)}, {_rates_sql('b', 1)}, j as (select coalesce(a.segment, b.segment) as segment, coalesce(a.priority, b.priority) as priority, a.rate::double as rate_before, b.rate::double as rate_after, case when a.segment is null then 'added' when b.segment is null then 'removed' when a.rate is distinct from b.rate then 'changed' end as change, coalesce(a.segment is not null and b.segment is not null and a.rate is distinct from b.rate and a.citation is not distinct from b.citation, false) as uncited from a full join b on a.segment = b.segment and a.priority = b.priority) select segment, priority, rate_before, rate_after, change, uncited from j where change is not null")(
    lambda s, d: I.impact_rates(_rate_table(s, d, 0), _rate_table(s, d, 1), ["segment", "priority"])
)


@query("impact_report", "with c as (select distinct n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA') select 'asia' as report, 'grain' as part, n_name as member, 'removed' as change from c where n_name < 'INDO' union all select 'asia', 'measures', 'net', 'added'")
def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    names = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'").agg(F.collect_set("n_name").alias("grain"))  # 25 nations at most
    before = names.select(F.lit("asia").alias("report"), "grain", F.array(F.lit("gross")).alias("measures"))
    after = before.select("report", F.filter("grain", lambda g: g >= "INDO").alias("grain"), F.array(F.lit("gross"), F.lit("net")).alias("measures"))
    return I.impact_report(before, after, ["grain", "measures"])


def _measure_values(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    rows = C.classify(positions(spark, sf_dir), RULES_AFTER if after else RULES, "product_id").where("product_id is not null")
    return rows.groupBy(F.col("product_id").alias("name")).agg(F.sum("balance_usd").cast("double").alias("value"))


_mv = lambda n, c: f"{n} as (select {c} as name, sum(balance_usd)::double as value from positions where {c} is not null group by 1)"

query("impact_measures", f"with {POSITIONS}, {_mv('a', PRODUCT)}, {_mv('b', AFTER)}, j as (select coalesce(a.name, b.name) as name, a.value as value_before, b.value as value_after, case when a.value is null and b.value is not null then 'appeared' when a.value is not null and b.value is null then 'vanished' when abs(a.value - b.value) > 1e-9 * greatest(abs(a.value), abs(b.value)) then 'moved' end as change from a full join b on a.name = b.name) select * from j where change is not null")(
    lambda s, d: I.impact_measures(_measure_values(s, d, False), _measure_values(s, d, True))
)
query(
    "impact_summary",
    f"""{_sides}, {_cov}, s as (select count(*) as n from ({_diff('ba', 'bb', 'silenced')})), l as (select count(*) as n from (select threshold_id from a left join b using (threshold_id) where b.threshold_id is null or keys_after < keys_before)), r as (select count(*) as n from ({_diff('bb', 'ba', 'added')})),
f as (select 'silenced' as kind, 1 as rank, n as findings, n > 0 as weakens from s union all select 'coverage', 2, n, n > 0 from l union all select 'added', 3, n, false from r) select *, (select bool_or(weakens) from f) as needs_review from f where findings > 0""",
)(
    lambda s, d: (lambda ba, bb: I.impact_summary([("silenced", 1, True, ba.where("change = 'silenced'")), ("coverage", 2, True, bb), ("added", 3, False, ba.where("change = 'added'"))]))(
        I.impact_breaches(V.breaches(_judged(s, d)), V.breaches(_judged(s, d, LOOSER)), ["key"]), I.coverage_loss(_judged(s, d), _judged(s, d, LOOSER), ["key"])
    )
)

# --- dashboard queries -------------------------------------------------------------------------------------------

TOTAL = Measure("total", "sum", "value")
_now, _prev = f"as_of_date = date '{DAY}'", "as_of_date = date '2024-01-19'"
query("query_scalar", f"with {ACTIVITY} select date '{DAY}' as as_of_date, coalesce(sum(value) filter (where {_now}), 0)::double as value, coalesce(sum(value) filter (where {_prev}), 0)::double as prior from activity where event_type <> 'view'")(
    lambda s, d: _d(Q.query_scalar(activity(s, d), TOTAL, [("event_type", "!=", "view")], DAY), "value", "prior")
)
query("query_groups", f"with {ACTIVITY} select event_type, coalesce(sum(value) filter (where {_now}), 0)::double as value, coalesce(sum(value) filter (where as_of_date = date '2024-01-13'), 0)::double as prior from activity group by 1 having count(*) filter (where {_now}) > 0")(
    lambda s, d: _d(Q.query_groups(activity(s, d), TOTAL, ["event_type"], as_of=DAY, basis="prior_week"), "value", "prior")
)
query("query_series", f"with {ACTIVITY} select event_type, as_of_date, sum(value)::double as value from activity where as_of_date > date '{DAY}' - 10 and as_of_date <= date '{DAY}' and event_type in (select event_type from activity where {_now}) group by 1, 2")(
    lambda s, d: _d(Q.query_series(activity(s, d), TOTAL, ["event_type"], trailing=10, as_of=DAY), "value")
)
_cal = """cal as (select d as as_of_date, lag(d) over (order by d) as prior_day, case when lag(d) over (order by d) is not null then coalesce(lag(d, 7) over (order by d), min(d) over ()) end as prior_week, d = max(d) over () as is_latest,
  (select max(e.d) from days e where date_trunc('month', e.d) < date_trunc('month', days.d)) as month_end from days)"""
query("prior_basis", f"with days as (select distinct cast(o_orderdate as date) as d from orders), {_cal} select as_of_date, prior_day, prior_week, month_end from cal")(lambda s, d: Q.calendar(_order_days(s, d)).select("as_of_date", "prior_day", "prior_week", "month_end"))
query("query_unknown_date", f"with {ACTIVITY}, m as (select max(as_of_date) as d from activity) select (select d from m) as as_of_date, coalesce(sum(value) filter (where as_of_date = (select d from m)), 0)::double as value, coalesce(sum(value) filter (where as_of_date = (select d from m) - 1), 0)::double as prior from activity")(
    lambda s, d: _d(Q.query_scalar(activity(s, d), TOTAL, as_of="2031-01-01"), "value", "prior")
)

query("query_filters", f"with {STAGED} select entity_id, as_of_date, sum(balance_usd)::double as value from staged where maturity_bucket in ('open', '8-30') and product_id = 'O.D.2' and currency <> 'EUR' group by 1, 2")(
    lambda s, d: _d(Q.query_series(staged(s, d), Measure("b", "sum", "balance_usd"), ["entity_id"], [("maturity_bucket", "in", ["open", "8-30"]), ("product_id", "=", "O.D.2"), ("currency", "!=", "EUR")]), "value")
)


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("as_of_date"))


query("calendar", "with d as (select distinct cast(ts as date) as as_of_date from events) select as_of_date, as_of_date = max(as_of_date) over () as is_latest from d")(lambda s, d: Q.calendar(activity(s, d)).select("as_of_date", "is_latest"))
query("query_compare", f"with {ACTIVITY} select event_type, as_of_date, sum(value)::double as value, count(*) as other from activity where as_of_date <= date '{DAY}' and event_type in (select event_type from activity where {_now}) group by 1, 2")(
    lambda s, d: _d(Q.compare(Q.query_series(activity(s, d), TOTAL, ["event_type"], as_of=DAY), Q.query_series(activity(s, d), Measure("n", "count"), ["event_type"], as_of=DAY), ["event_type", "as_of_date"]), "value")
)
query("cross_filter", f"with {POSITIONS} select segment, coalesce(sum(balance_usd) filter (where entity_id = 'ASIA'), 0)::double as value, sum(balance_usd)::double as other from positions group by 1")(
    lambda s, d: (lambda p: _d(p.groupBy("segment").agg(Measure("value", "sum", "balance_usd", "entity_id = 'ASIA'").column(), F.sum("balance_usd").alias("other")), "value", "other"))(positions(s, d))
)
query("adhoc_derived", f"with {ACTIVITY}, g as (select event_type, as_of_date, sum(value)::double as value, count(*) as other from activity where as_of_date <= date '{DAY}' and event_type in (select event_type from activity where {_now}) group by 1, 2) select event_type, as_of_date, value, other, value / nullif(other::double, 0) as result from g")(
    lambda s, d: _d(Q.adhoc(_d(Q.query_series(activity(s, d), TOTAL, ["event_type"], as_of=DAY), "value"), Q.query_series(activity(s, d), Measure("n", "count"), ["event_type"], as_of=DAY), ["event_type", "as_of_date"], "ratio"), "value")
)

# --- presentation ------------------------------------------------------------------------------------------------

query("pivot_margins", f"with {POSITIONS} select case when grouping(entity_id) = 1 then '(total)' else entity_id end as entity_id, case when grouping(segment) = 1 then '(total)' else segment end as segment, sum(balance_usd)::double as value from positions group by cube (entity_id, segment)")(
    lambda s, d: P.pivot_margins(positions(s, d), "entity_id", "segment", F.col("balance_usd"))
)
query("heatmap", f"with {POSITIONS}, c as (select entity_id, collateral_class, sum(case when direction = 'INFLOW' then balance_usd * 2 else -balance_usd end)::double as value from positions group by 1, 2) select *, abs(value) / max(abs(value)) over () as intensity, sign(value)::int as sign from c")(
    lambda s, d: P.heatmap(positions(s, d), "entity_id", "collateral_class", F.when(F.col("direction") == "INFLOW", F.col("balance_usd") * 2).otherwise(-F.col("balance_usd")))
)
_moves = f"moves as (select event_type, coalesce(sum(value) filter (where {_now}), 0) as value, coalesce(sum(value) filter (where {_prev}), 0) as prior from activity group by 1 having count(*) filter (where {_now}) > 0)"
query(
    "waterfall",
    f"""with {ACTIVITY}, {_moves}, r as (select *, value - prior as delta, row_number() over (order by value - prior desc, event_type) as ord, sum(value - prior) over (order by value - prior desc, event_type) as run from moves)
select 0::int as ord, 'prior' as step, 0::double as from_value, (select sum(prior) from moves)::double as to_value union all select ord::int, event_type, ((select sum(prior) from moves) + run - delta)::double, ((select sum(prior) from moves) + run)::double from r
union all select (select count(*) + 1 from moves)::int, 'current', 0, (select sum(value) from moves)::double""",
)(lambda s, d: P.waterfall(Q.query_groups(activity(s, d), TOTAL, ["event_type"], as_of=DAY).withColumns({c: F.col(c).cast("decimal(28,4)") for c in ("value", "prior")}), "event_type"))
query(
    "histogram",
    """with x as (select l_extendedprice as x from lineitem), a as (select count(*) as n, min(x) as lo, max(x) as hi, median(x) as m, greatest(3, least(12, ceil(log2(count(*)))::int + 1)) as bins from x),
c as (select (case when hi = lo then 0 else least(floor((x - lo) * bins / (hi - lo)), bins - 1) end)::int as bin, count(*) as records from x, a group by 1), f as (select unnest(range(0, bins))::int as bin, * from a)
select f.bin, lo + (hi - lo) / bins * f.bin as from_value, coalesce(records, 0) as records, m as median from f left join c on f.bin = c.bin""",
)(lambda s, d: P.histogram(s.read.parquet(f"{d}/lineitem.parquet"), F.col("l_extendedprice")))
query("stacked_bands", f"with {ACTIVITY}, g as (select as_of_date, event_type, sum(value) as value from activity group by 1, 2) select as_of_date, event_type, value::double as value, (sum(value) over w)::double as top, (sum(value) over w - value)::double as bottom, bool_or(value < 0) over (partition by as_of_date) as refused from g window w as (partition by as_of_date order by event_type)")(
    lambda s, d: P.stacked_bands(activity(s, d).groupBy("as_of_date", "event_type").agg(F.sum("value").alias("value")), "as_of_date", "event_type")
)
query("bar_topk", f"with {STAGED}, a as (select product_id, sum(balance_usd)::double as value from staged group by 1 order by value desc nulls last, product_id limit 3), o as (values ('open', 0), ('0-1', 1), ('2-7', 2), ('8-30', 3), ('31-90', 4), ('91-365', 5), ('over-365', 6)), b as (select maturity_bucket, sum(balance_usd)::double as value from staged join o on col0 = maturity_bucket group by 1, col1 order by col1 limit 4) select 'product' as chart, product_id as bar, value from a union all select 'bucket', maturity_bucket, value from b")(
    lambda s, d: (lambda t: P.bar_topk(t.groupBy("product_id").agg(F.sum("balance_usd").cast("double").alias("value")), "product_id", 3).select(F.lit("product").alias("chart"), F.col("product_id").alias("bar"), "value").unionByName(
        P.bar_topk(t.groupBy("maturity_bucket").agg(F.sum("balance_usd").cast("double").alias("value")), "maturity_bucket", 4, LADDER).select(F.lit("bucket").alias("chart"), F.col("maturity_bucket").alias("bar"), "value")))(staged(s, d))
)
query("delta_table", f"with {ACTIVITY}, {_moves} select event_type, value::double as value, prior::double as prior, (value - prior)::double as move, (value - prior)::double / nullif(abs(prior::double), 0) * 100 as move_pct from moves")(
    lambda s, d: _d(P.delta_table(Q.query_groups(activity(s, d), TOTAL, ["event_type"], as_of=DAY)), "value", "prior")
)
_gauge = f"with {ACTIVITY}, g as (select event_type, sum(value)::double as value from activity where {_now} group by 1)"
query("limit_gauge", f"{_gauge} select event_type, value, case when 700 - value < 0 then 'breach' else 'within' end as status, 700::double - value as room, 'ceiling' as side from g union all select event_type, value, case when value - 700 < 0 then 'breach' else 'within' end, value - 700::double, 'floor' from g union all select event_type, value, null, null, null from g")(
    lambda s, d: (lambda g: reduce(DataFrame.unionByName, [P.limit_gauge(g, 700.0 if side else None, side).withColumn("side", F.lit(side).cast("string")) for side in ("ceiling", "floor", None)]))(activity(s, d).where(F.col("as_of_date") == F.lit(DAY).cast("date")).groupBy("event_type").agg(F.sum("value").cast("double").alias("value")))
)
query("shared_extent", f"with {ACTIVITY}, g as (select sum(value)::double as value from activity group by event_type, as_of_date), e as (select least(min(value), 0::double) as lo, greatest(max(value), 0::double) as hi from g) select lo - (hi - lo) * 0.08::double as low, hi + (hi - lo) * 0.08::double as high from e")(
    lambda s, d: P.shared_extent(activity(s, d).groupBy("event_type", "as_of_date").agg(F.sum("value").alias("value")), "value", True)
)
query(
    "pack_rows",
    f"""with {ACTIVITY}, {_moves}, s as (select coalesce(sum(value) filter (where {_now}), 0) as value, coalesce(sum(value) filter (where {_prev}), 0) as prior from activity)
select 0::int as ord, 'total' as item, 'all' as label, round(value, 1)::decimal(38,1)::varchar || '%' as value, round(prior, 1)::decimal(38,1)::varchar || '%' as prior, 'ok' as status from s
union all select 1, 'by type', event_type, round(value, 0)::bigint::varchar || ' bps', round(prior, 0)::bigint::varchar || ' bps', 'ok' from moves union all select 2, 'broken', null, null, null, 'skipped'""",
)(
    lambda s, d: P.pack_rows([("total", Q.query_scalar(activity(s, d), TOTAL, as_of=DAY).withColumn("label", F.lit("all")), "percent_1dp"), ("by type", Q.query_groups(activity(s, d), TOTAL, ["event_type"], as_of=DAY).withColumnRenamed("event_type", "label"), "bps"), ("broken", None, "usd")])
)
query(
    "measure_trace",
    f"""with {POSITIONS}, m as (select coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0)::double as outflow, coalesce(sum(balance_usd) filter (where direction = 'INFLOW'), 0)::double as inflow, count(*) as n from positions), v as (select *, least(inflow, outflow * 0.75::double) as capped, case when inflow <= outflow * 0.75::double then 'branch 1' else 'else' end as branch from m)
select 'net' as parent, 'outflow' as input, 1::int as depth, outflow as value, n as rows_read, branch from v union all select 'net', 'capped', 1, capped, n, branch from v union all select 'capped', 'inflow', 2, inflow, n, branch from v""",
)(
    lambda s, d: P.measure_trace(
        positions(s, d).agg(*[Measure(n.lower(), "sum", "balance_usd", f"direction = '{n}'").column().cast("double").alias(n.lower()) for n in ("OUTFLOW", "INFLOW")], F.count("*").alias("n")).withColumn("capped", F.least("inflow", F.col("outflow") * 0.75)),
        [("net", "outflow", 1), ("net", "capped", 1), ("capped", "inflow", 2)], case_branch([F.col("inflow") <= F.col("outflow") * 0.75], True), "n",
    )
)
