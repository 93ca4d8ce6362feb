"""Queries of row stages, rule analytics, measures, windows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import report as R
from ..operators import rules as C
from ..operators.measures import Measure
from .fixtures import ACTIVITY, FILED, LADDER, PLAIN_VERSIONS, POSITIONS, PRODUCT, RATES_2, RULE_SQL, RULES, RULES_AFTER, STAGED, VERSIONS, WINNER, activity, filed, positions, prepared, rates, staged
from .registry import query, values

_money = lambda c: F.sum(c).cast("decimal(38,2)").cast("double")

query("classify_first_match", f"with {POSITIONS} select pos_key, {PRODUCT} as product_id from positions")(lambda s, d: C.classify(positions(s, d), RULES, "product_id").select("pos_key", "product_id"))
query("rule_attribution", f"with {POSITIONS} select {WINNER} as rule_id, {PRODUCT} as product_id, count(*) as n from positions group by all")(
    lambda s, d: C.classify(positions(s, d), RULES, "product_id", "rule_id").groupBy("rule_id", "product_id").agg(F.count("*").alias("n"))
)
query("param_lookup", f"with {STAGED} select product_id, rate::double as rate, count(*) as n, coalesce(sum(balance_usd * rate), 0)::double as weighted from staged group by all")(
    lambda s, d: staged(s, d).groupBy("product_id", F.col("rate").cast("double").alias("rate")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("balance_usd") * F.col("rate")), F.lit(0)).cast("double").alias("weighted"))
)


@query(
    "param_lookup_multi",
    f"""with {STAGED}, r2(product_id, currency, rate2) as (values ('O.D.1', 'USD', 0.03::double), ('O.D.1', 'EUR', 0.05), ('O.D.2', 'USD', 0.1), ('O.W.2', 'EUR', 0.4))
select product_id, currency, rate2, count(*) as n from staged left join r2 using (product_id, currency) group by all""",
)
def param_lookup_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = values(spark, [(a, b, float(r)) for a, b, r in RATES_2], "product_id string, currency string, r double")
    return C.param_lookup(staged(spark, sf_dir), table, ["product_id", "currency"], "r", "rate2").groupBy("product_id", "currency", "rate2").agg(F.count("*").alias("n"))


@query("prepared_equals_inline", f"with {STAGED} select count(*) as rows_compared, 0::bigint as rows_that_differ from staged")
def prepared_equals_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared row stage gives what the same steps give inline."""
    base = positions(spark, sf_dir)
    shared = C.row_stage(base, [prepared, lambda d: C.classify(d, RULES, "product_id")]).select("pos_key", "days_to_maturity", "maturity_bucket", "product_id", "balance_usd")
    from ..functions.exprs import date_bucket, days_between

    own = C.classify(base.withColumn("days_to_maturity", days_between(F.col("as_of_date"), F.col("maturity_date"))).withColumn("maturity_bucket", date_bucket(F.col("as_of_date"), F.col("maturity_date"), LADDER)), RULES, "product_id").select(*shared.columns)
    both = shared.withColumn("side", F.lit(1)).unionByName(own.withColumn("side", F.lit(-1)))
    odd = both.groupBy(*shared.columns).agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("n"))
    return odd.agg(F.sum("n").alias("rows_compared"), F.count_if(F.col("d") != 0).alias("rows_that_differ"))


def _versions(spark: SparkSession, rows) -> DataFrame:
    return values(spark, rows, "version int, f string, t string, rate string").select("version", F.col("f").cast("date").alias("effective_from"), F.col("t").cast("date").alias("effective_to"), F.col("rate").cast("decimal(9,4)").alias("rate"))


_version_sql = lambda rows: "versions(version, effective_from, effective_to, rate) as (values " + ", ".join(f"({v}, date '{f}', {f'date {t!r}' if t else 'null::date'}, {r}::decimal(9,4))" for v, f, t, r in rows) + ")"

query("effective_rates", f"with {POSITIONS}, {_version_sql(PLAIN_VERSIONS)} select version, count(*) as n, sum(balance_usd * rate)::double as weighted from positions left join versions on as_of_date >= effective_from and (effective_to is null or as_of_date < effective_to) group by 1")(
    lambda s, d: C.join_in_force(positions(s, d), _versions(s, PLAIN_VERSIONS), "as_of_date").groupBy("version").agg(F.count("*").alias("n"), F.sum(F.col("balance_usd") * F.col("rate")).cast("double").alias("weighted"))
)


@query(
    "effective_gaps",
    f"""with {_version_sql(VERSIONS)}, days as (select distinct cast(o_orderdate as date) as day from orders), c as (select day, count(version) as versions from days left join versions on day >= effective_from and (effective_to is null or day < effective_to) group by 1)
select day, versions, case when versions = 0 then 'gap' else 'overlap' end as problem from c where versions <> 1""",
)
def effective_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the data that no version, or more than one, covers."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return C.effective_problems(_versions(spark, VERSIONS), "1995-01-01", "2002-01-01").join(days, "day", "left_semi")


query(
    "coverage_totals",
    f"""with {POSITIONS}, c as (select *, {WINNER} as rule_id from positions) select count(*) as records, count(rule_id) as matched_records, count(*) - count(rule_id) as unmatched_records, sum(balance_usd)::double as notional,
  coalesce(sum(balance_usd) filter (where rule_id is not null), 0)::double as matched_notional, coalesce(sum(balance_usd) filter (where rule_id is null), 0)::double as unmatched_notional from c""",
)(lambda s, d: C.coverage_totals(positions(s, d), RULES, "balance_usd"))
_rule_list = "rules(ord, rule_id, emit) as (values (1, 'r1', 'O.D.1'), (2, 'r2', 'O.D.2'), (3, 'r3', 'O.W.1'), (4, 'r4', 'O.W.2'), (5, 'r5', 'I.S.1'), (6, 'r6', 'I.U.1'), (7, 'r7', 'X.X.1'), (8, 'r8', 'I.S.2'))"
_won = f"with {POSITIONS}, {_rule_list}, c as (select *, {WINNER} as rule_id from positions), w as (select rule_id, count(*) as records, sum(balance_usd) as notional from c group by 1)"
query("rule_stats", f"{_won} select ord, rule_id, emit, coalesce(records, 0) as records, coalesce(notional, 0)::double as notional from rules left join w using (rule_id)")(lambda s, d: C.rule_stats(positions(s, d), RULES, "balance_usd"))
query("value_stats", f"with {POSITIONS}, c as (select *, {PRODUCT} as value from positions) select value, count(*) as records, sum(balance_usd)::double as notional from c where value is not null group by 1")(lambda s, d: C.value_stats(positions(s, d), RULES, "balance_usd"))
_hits = "hits as (select *, " + ", ".join(f"coalesce({c}, false) as {r}" for r, c in RULE_SQL.items()) + f", {WINNER} as winner from positions)"
_over = " union all ".join(f"select winner, '{r}' as other, count(*) as records from hits where {r} and winner is not null and winner <> '{r}' group by 1" for r in RULE_SQL)
query("rule_overlaps", f"with {POSITIONS}, {_hits} {_over}")(lambda s, d: C.rule_overlaps(positions(s, d), RULES))
query("rule_preemption", f"with {POSITIONS}, {_hits}, o as ({_over}) select other as rule_id, winner as taken_by, records from o")(lambda s, d: C.rule_preemption(positions(s, d), RULES))
query("dead_rules", f"with {POSITIONS}, {_hits}, {_rule_list}, o as ({_over}), t as (select other, sum(records)::bigint as taken from o group by 1) select rule_id, case when taken is null then 'dead' else 'preempted' end as status, coalesce(taken, 0) as taken_records from rules left join t on other = rule_id where rule_id not in (select winner from hits where winner is not null)")(
    lambda s, d: C.dead_rules(positions(s, d), RULES, "balance_usd")
)
query("off_domain", f"with {POSITIONS}, c as (select {PRODUCT} as value from positions) select value, count(*) as records from c where value not in ('O.D.1', 'O.D.2', 'I.S.1', 'X.X.1') group by 1")(
    lambda s, d: C.off_domain(positions(s, d), RULES, values(s, [("O.D.1",), ("O.D.2",), ("I.S.1",), ("X.X.1",)], "value string"))
)
query("rate_misses", f"with {STAGED} select product_id, count(*) as records from staged where product_id is not null and rate is null group by 1")(
    lambda s, d: C.rate_misses(C.classify(positions(s, d), RULES, "product_id"), rates(s), ["product_id"])
)
query("live_coverage", f"with {STAGED} select product_id, count(*) as records, sum(balance_usd)::double as balance from staged group by 1")(lambda s, d: staged(s, d).groupBy("product_id").agg(F.count("*").alias("records"), _money("balance_usd").alias("balance")))
AFTER = f"""case when {RULE_SQL['r1']} and account_type <> 'TIME' then 'O.D.1' when {RULE_SQL['r2']} then 'O.D.2' when {RULE_SQL['r4']} then 'O.W.2'
  when direction = 'INFLOW' and is_secured and collateral_class = 'L1' then 'I.S.1' when direction = 'INFLOW' and segment = 'RETAIL' then 'I.U.1' end"""
MIGRATION = f"with {POSITIONS}, m as (select {PRODUCT} as a, {AFTER} as b, balance_usd from positions) select coalesce(a, '(unmapped)') as from_value, coalesce(b, '(unmapped)') as to_value, count(*) as records, sum(balance_usd)::double as notional from m where a is distinct from b group by 1, 2"
query("class_migration", MIGRATION)(lambda s, d: C.migration(positions(s, d), RULES, RULES_AFTER, "balance_usd"))
query("rules_with_share", f"{_won} select ord, rule_id, emit, coalesce(records, 0) as records, coalesce(records, 0)::double / (select count(*) from positions)::double as record_share, coalesce(notional, 0)::double / (select sum(balance_usd)::double from positions) as notional_share from rules left join w using (rule_id)")(
    lambda s, d: C.rules_with_share(positions(s, d), RULES, "balance_usd")
)

# --- measures ----------------------------------------------------------------------------------------------------

query(
    "agg_basic",
    f"""with {POSITIONS} select entity_id, coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0)::double as total, round(avg(balance_usd::double), 6) as mean, min(balance_usd)::double as lo, max(balance_usd)::double as hi, count(maturity_date) as dated,
  coalesce(sum(balance_usd) filter (where direction = 'SIDEWAYS'), 0)::double as none_total, max(balance_usd::double) filter (where direction = 'SIDEWAYS') as none_max from positions group by 1""",
)(
    lambda s, d: M.aggregate(
        positions(s, d).withColumn("b", F.col("balance_usd").cast("double")),
        [Measure("total", "sum", "balance_usd", "direction = 'OUTFLOW'"), Measure("mean", "avg", "b"), Measure("lo", "min", "balance_usd"), Measure("hi", "max", "balance_usd"), Measure("dated", "count", "maturity_date"), Measure("none_total", "sum", "balance_usd", "direction = 'SIDEWAYS'"), Measure("none_max", "max", "b", "direction = 'SIDEWAYS'")],
        ["entity_id"],
    ).withColumns({c: F.col(c).cast("double") for c in ("total", "lo", "hi", "none_total")}).withColumn("mean", F.round("mean", 6))
)
query("agg_first_last", f"with {POSITIONS} select entity_id, arg_min(balance_usd, (as_of_date, pos_key, balance_usd))::double as first_balance, arg_max(balance_usd, (as_of_date, pos_key, balance_usd))::double as last_balance from positions group by 1")(
    lambda s, d: M.aggregate(positions(s, d), [Measure(f"{n}_balance", n, "balance_usd", order=("as_of_date", "pos_key", "balance_usd")) for n in ("first", "last")], ["entity_id"]).withColumns({f"{n}_balance": F.col(f"{n}_balance").cast("double") for n in ("first", "last")})
)
query("agg_weighted", f"with {STAGED} select currency, product_id, sum(rate * balance_usd) filter (where rate is not null)::double / nullif(sum(balance_usd) filter (where rate is not null)::double, 0) as mean_rate from staged group by all")(
    lambda s, d: M.aggregate(staged(s, d), [Measure("mean_rate", "weighted_avg", "rate", weight="balance_usd")], ["currency", "product_id"])
)
query("agg_filtered", f"with {POSITIONS} select as_of_date, coalesce(sum(balance_usd) filter (where is_secured), 0)::double as secured, coalesce(sum(balance_usd) filter (where insured_flag and segment = 'RETAIL'), 0)::double as insured_retail, count(*) filter (where segment is null) as unmapped from positions group by 1")(
    lambda s, d: M.aggregate(positions(s, d), [Measure("secured", "sum", "balance_usd", "is_secured"), Measure("insured_retail", "sum", "balance_usd", "insured_flag and segment = 'RETAIL'"), Measure("unmapped", "count", where="segment is null")], ["as_of_date"]).withColumns({c: F.col(c).cast("double") for c in ("secured", "insured_retail")})
)
SPINE = "spine as (select unnest(generate_series((select min(as_of_date) from positions), (select max(as_of_date) from positions), interval 1 day))::date as as_of_date)"


@query("measure_series", f"with {POSITIONS}, {SPINE} select as_of_date, coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0)::double as outflow, count(*) filter (where direction = 'OUTFLOW') as rows_used, count(pos_key) as rows_scanned from spine left join positions using (as_of_date) group by 1")
def measure_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    made = M.series(p, [Measure("outflow", "sum", "balance_usd", "direction = 'OUTFLOW'")])
    return made.join(M.series_counts(p, "direction = 'OUTFLOW'"), "as_of_date").withColumn("outflow", F.col("outflow").cast("double"))


DERIVED = {"net": (("outflow", "capped"), "outflow - capped"), "capped": (("inflow", "outflow"), "case when inflow is null or outflow is null then null else least(inflow, outflow * 0.75) end"), "ratio": (("net", "outflow"), "try_divide(net, outflow)")}
query("derived_chain", f"with {POSITIONS}, a as (select as_of_date, coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0)::double as outflow, coalesce(sum(balance_usd) filter (where direction = 'INFLOW'), 0)::double as inflow from positions group by 1), b as (select *, least(inflow, outflow * 0.75::double) as capped from a), c as (select *, outflow - capped as net from b) select *, net / nullif(outflow, 0) as ratio from c")(
    lambda s, d: M.derive(M.aggregate(positions(s, d), [Measure(n.lower(), "sum", "balance_usd", f"direction = '{n}'") for n in ("OUTFLOW", "INFLOW")], ["as_of_date"]).withColumns({c: F.col(c).cast("double") for c in ("outflow", "inflow")}), {**DERIVED, "capped": (DERIVED["capped"][0], DERIVED["capped"][1].replace("0.75", "0.75D"))})
)
query("derived_grouped", f"with {FILED} select product_id, entity_id, sum(gross_outflow)::double as outflow, sum(weighted_outflow_30d)::double as weighted, sum(weighted_outflow_30d)::double / nullif(sum(gross_outflow)::double, 0) as run_off from filed group by 1, 2")(
    lambda s, d: M.derive(filed(s, d).groupBy("product_id", "entity_id").agg(_money("gross_outflow").alias("outflow"), _money("weighted_outflow_30d").alias("weighted")), {"run_off": (("weighted", "outflow"), "try_divide(weighted, outflow)")})
)
query("grain_risk", f"with {POSITIONS}, g as (select entity_id, sum(balance_usd) as v from positions where direction = 'INFLOW' group by 1) select sum(least(v, 20000000::decimal(38,2)))::double as capped_by_group, least(sum(v), 20000000::decimal(38,2))::double as capped_whole, (sum(least(v, 20000000::decimal(38,2))) - least(sum(v), 20000000::decimal(38,2)))::double as gap from g")(
    lambda s, d: M.grain_risk(positions(s, d).where("direction = 'INFLOW'"), "entity_id", F.col("balance_usd"), 20000000)
)
query("grouping_sets", f"with {POSITIONS} select entity_id, segment, case when grouping(entity_id) = 1 and grouping(segment) = 1 then 'headline' when grouping(entity_id) = 0 then 'entity_id' else 'segment' end as level, coalesce(sum(balance_usd), 0)::double as balance from positions group by grouping sets ((), (entity_id), (segment))")(
    lambda s, d: M.headline_and_groups(positions(s, d), [Measure("balance", "sum", "balance_usd")], ["entity_id", "segment"]).withColumn("balance", F.col("balance").cast("double"))
)
query("observed_values", f"with {POSITIONS}, v as (select distinct account_type as value from positions where account_type is not null order by 1 limit 4) select value, (select count(*) from v) > 3 as truncated from v order by value limit 3")(lambda s, d: M.observed_values(positions(s, d), "account_type", 3))
query("range_check", f"with {POSITIONS} select as_of_date, sum(balance_usd)::double as total from positions group by 1 having sum(balance_usd)::double < 50000 or sum(balance_usd)::double > 250000")(
    lambda s, d: M.range_check(positions(s, d).groupBy("as_of_date").agg(F.sum("balance_usd").cast("double").alias("total")), "total", 50000, 250000)
)


# --- windows -----------------------------------------------------------------------------------------------------


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense series for each event type, in decimals."""
    return M.series(activity(spark, sf_dir), [Measure("value", "sum", "value")], ["event_type"])


_DAILY = f"{ACTIVITY}, daily as (select t.event_type, d.as_of_date, coalesce(sum(a.value), 0) as value from (select distinct event_type from activity) t cross join (select unnest(generate_series((select min(as_of_date) from activity), (select max(as_of_date) from activity), interval 1 day))::date as as_of_date) d left join activity a on a.event_type = t.event_type and a.as_of_date = d.as_of_date group by 1, 2)"
_W = "over (partition by event_type order by as_of_date"


def _window(name: str, specs: list[tuple[str, int, str]], columns: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _daily(spark, sf_dir)
        for op, n, frame in specs:
            df = M.window_measure(df, "value", op, n, ["event_type"], frame=frame)
        return df.select("event_type", "as_of_date", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns])

    query(name, f"with {_DAILY} select event_type, as_of_date, " + ", ".join(f"round(({sql})::double, 6) as {c}" for c, sql in columns.items()) + " from daily")(run)


_window("win_delta", [("delta", 1, "rows"), ("delta", 5, "rows")], {f"delta_{n}": f"value - lag(value, {n}) {_W})" for n in (1, 5)})
_window("win_pct_change", [("pct_change", 1, "rows"), ("pct_change", 7, "rows")], {f"pct_change_{n}": f"(value - lag(value, {n}) {_W}))::double / nullif((lag(value, {n}) {_W}))::double, 0) * 100" for n in (1, 7)})
_rows = lambda n: f"{_W} rows between {n - 1} preceding and current row)"
_guard = lambda n, sql: f"case when row_number() {_W}) >= {n} then {sql} end"
_window("win_trailing", [(o, 7, "rows") for o in ("sum", "min", "max")] + [("avg", 5, "rows")], {f"{o}_7": _guard(7, f"{o}(value) {_rows(7)}") for o in ("sum", "min", "max")} | {"avg_5": _guard(5, f"sum(value) {_rows(5)}::double / 5")})
_window("win_stddev", [("stddev", 7, "rows"), ("variance", 7, "rows"), ("stddev", 1, "rows")], {"stddev_7": _guard(7, f"stddev_samp(value::double) {_rows(7)}"), "variance_7": _guard(7, f"var_samp(value::double) {_rows(7)}"), "stddev_1": _guard(1, f"stddev_samp(value::double) {_rows(1)}")})


@query("win_time_frame", f"with {POSITIONS}, d as (select as_of_date, sum(balance_usd) as value from positions group by 1) select as_of_date, (sum(value) over (order by as_of_date range between interval 6 days preceding and current row))::double as sum_7 from d")
def win_time_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven calendar days over a series with gaps."""
    daily = positions(spark, sf_dir).groupBy("as_of_date").agg(F.sum("balance_usd").alias("value"))
    return M.window_measure(daily, "value", "sum", 7, frame="time").select("as_of_date", F.col("sum_7").cast("double").alias("sum_7"))


@query("win_partitioned", f"with {POSITIONS}, d as (select entity_id, segment, as_of_date, sum(balance_usd) as value from positions group by all) select entity_id, segment, as_of_date, (value - lag(value, 1) over (partition by entity_id, segment order by as_of_date))::double as delta_1 from d")
def win_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = positions(spark, sf_dir).groupBy("entity_id", "segment", "as_of_date").agg(F.sum("balance_usd").alias("value"))
    return M.window_measure(daily, "value", "delta", 1, ["entity_id", "segment"]).select("entity_id", "segment", "as_of_date", F.col("delta_1").cast("double").alias("delta_1"))


# --- reports -----------------------------------------------------------------------------------------------------

_amounts = ("gross_outflow", "weighted_outflow_30d", "gross_inflow")
_doubles = lambda df: df.withColumns({a: F.col(a).cast("double") for a in _amounts if a in df.columns})
_amount_sql = ", ".join(f"{a}::double as {a}" for a in _amounts)
query("report_filed", f"with {FILED} select product_id, maturity_bucket, currency, entity_id, as_of_date, {_amount_sql}, records from filed")(lambda s, d: _doubles(filed(s, d)))
query("report_top", f"with {FILED} select product_id, maturity_bucket, currency, entity_id, as_of_date, gross_outflow::double as gross_outflow from filed order by gross_outflow desc nulls last, product_id, maturity_bucket, currency, entity_id, as_of_date limit 20")(
    lambda s, d: _doubles(filed(s, d)).select("product_id", "maturity_bucket", "currency", "entity_id", "as_of_date", "gross_outflow").orderBy(F.desc_nulls_last("gross_outflow"), *[F.asc_nulls_last(c) for c in ("product_id", "maturity_bucket", "currency", "entity_id", "as_of_date")]).limit(20)
)
query("report_totals", f"with {FILED} select as_of_date, " + ", ".join(f"sum({a})::double as {a}" for a in _amounts) + ", sum(records)::bigint as records from filed group by 1")(lambda s, d: _doubles(R.report_totals(filed(s, d), _amounts)))


@query("report_ties", f"with {FILED}, t as (select as_of_date, sum(gross_outflow)::double as filed_total from filed group by 1), m as (select as_of_date, coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0)::double as measure from positions group by 1) select as_of_date, filed_total, measure, abs(filed_total - measure) <= 0.001 as ties from t join m using (as_of_date)")
def report_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = R.report_totals(filed(spark, sf_dir), ["gross_outflow"]).select("as_of_date", F.col("gross_outflow").cast("double").alias("filed_total"))
    whole = M.aggregate(positions(spark, sf_dir), [Measure("measure", "sum", "balance_usd", "direction = 'OUTFLOW'")], ["as_of_date"]).withColumn("measure", F.col("measure").cast("double"))
    return total.join(whole, "as_of_date").withColumn("ties", F.abs(F.col("filed_total") - F.col("measure")) <= 0.001)


@query(
    "report_range",
    f"""with {POSITIONS}, c as (select *, case when as_of_date >= date '1995-01-01' and as_of_date < date '1998-01-01' then {PRODUCT} when as_of_date >= date '1998-01-01' then {AFTER} end as product_id from positions)
select product_id, entity_id, as_of_date, coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0)::double as gross_outflow, count(*) as records from c group by all""",
)
def report_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many days in one job, each under the rule set in force on it."""
    versions = [("1995-01-01", "1998-01-01", RULES), ("1998-01-01", None, RULES_AFTER)]
    spec = R.ReportSpec(("product_id", "entity_id"), (Measure("gross_outflow", "sum", "balance_usd", "direction = 'OUTFLOW'", money=True),), (lambda d: C.classify_in_force(d, versions, "as_of_date", "product_id"),))
    return _doubles(R.report(positions(spark, sf_dir), spec))


