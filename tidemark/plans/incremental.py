"""Queries of operators that keep state, skip what is equal or unread, or spread out what one task would hold."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import effective as E
from ..operators import history as H
from ..operators import lineage as L
from ..operators import monitor_state as M
from ..operators import nearest as N
from ..operators import query as Q
from ..operators import reconcile as R
from ..operators import rules as C
from ..operators.measures import Measure
from ..sources import adapters
from ..sources.filed import FiledTable
from ..sources.sinks import scratch, stored, write_partitions
from .fixtures import ACTIVITY, FILED, activity, filed
from .monitors_queries import DAY, POINTS, ROLL_A, rolled_activity
from .quality_history import KEYS, _join, _other_sql
from .registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- effective dates ---------------------------------------------------------------------------------------------

TERMS = """starts as (select o_custkey as customer, cast(o_orderdate as date) as f, max(o_orderkey) as version from orders group by 1, 2),
chain as (select *, lead(f) over (partition by customer order by f) as next_f from starts),
terms as (select customer, version, f as effective_from, case when version % 3 = 0 then least(coalesce(next_f, f + 200), f + 200) else next_f end as effective_to from chain)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of each customer's terms from each order on, some of which end before the next one begins."""
    from pyspark.sql import Window

    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("effective_from"), "o_orderkey")
    starts = o.groupBy("customer", "effective_from").agg(F.max("o_orderkey").alias("version"))
    following = F.lead("effective_from").over(Window.partitionBy("customer").orderBy("effective_from"))
    short = F.date_add("effective_from", 200)
    ends = F.when(F.col("version") % 3 == 0, F.least(F.coalesce(following, short), short)).otherwise(following)
    return starts.withColumn("effective_to", ends)


@query(
    "effective_by_key",
    f"""with {TERMS}, lines as (select o_custkey as customer, cast(l_shipdate as date) as shipped, cast(l_extendedprice as decimal(18,2)) as price from lineitem join orders on l_orderkey = o_orderkey)
select version, effective_from, count(*) as n, sum(price)::double as price
from lines l left join terms t on l.customer = t.customer and shipped >= effective_from and (effective_to is null or shipped < effective_to) group by all""",
)
def effective_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line under the terms of its customer on the day of shipping; as many versions as orders, so they are merged with the lines."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.col("o_custkey").alias("customer"), F.col("l_shipdate").cast("date").alias("shipped"), price)
    found = E.join_in_force(lines, terms(spark, sf_dir), "shipped", ["customer"], small_bytes=0)
    return found.groupBy("version", "effective_from").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("price"))


@query(
    "effective_stretches",
    """with v as (select o_custkey as customer, cast(o_orderdate as date) as f, cast(o_orderdate as date) + 300 as t from orders),
days as (select unnest(generate_series(date '1997-01-01', date '1997-12-31', interval 1 day))::date as d),
keys as (select distinct customer from v where f <= date '1997-12-31' and t > date '1997-01-01'),
c as (select k.customer, d, count(v.f) as versions from keys k cross join days left join v on v.customer = k.customer and d >= f and d < t group by all),
p as (select *, lag(versions) over (partition by customer order by d) as was from c)
select customer, case when versions = 0 then 'gap' else 'overlap' end as problem, count(*) as days, count(*) filter (where versions is distinct from was) as stretches from p where versions <> 1 group by 1, 2""",
)
def effective_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a year that no contract of a customer covers, or several do; a contract runs 300 days from each order."""
    start = F.col("o_orderdate").cast("date")
    v = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), start.alias("effective_from"), F.date_add(start, 300).alias("effective_to"))
    found = E.effective_stretches(v, "1997-01-01", "1997-12-31", ["customer"])
    return found.groupBy("customer", "problem").agg(F.sum(F.datediff("to_day", "from_day")).alias("days"), F.count("*").alias("stretches"))


# --- state -------------------------------------------------------------------------------------------------------


@query(
    "var_carried",
    f"""with {ROLL_A}, {POINTS} select key, as_of_date, value::double as value, prior::double as prior, prior_date, delta::double as delta, round(pct, 6) as pct,
  round(sigma_30, 4) as sigma_30, n_30, round(sigma_60, 4) as sigma_60, n_60 from points""",
)
def var_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of monitor points, worked out week by week from the carried state and that week's rows."""
    states, points = scratch(spark, "states"), scratch(spark, "points")
    rolled = rolled_activity(spark, sf_dir)
    first, last = rolled.agg(F.min("as_of_date"), F.max("as_of_date")).first()
    while first and first <= last:
        end = first + datetime.timedelta(days=6)
        M.run_period(rolled.where(F.col("as_of_date").between(first, end)), first, end, states, points, ["key"])
        first = end + datetime.timedelta(days=1)
    schema = M.advance(None, rolled, ["key"]).schema
    shown = [F.col(c).cast("double").alias(c) for c in ("value", "prior", "delta")]
    rounded = [F.round(c, n).alias(c) for c, n in (("pct", 6), ("sigma_30", 4), ("sigma_60", 4))]
    return spark.read.schema(schema).parquet(points).select("key", "as_of_date", "prior_date", "n_30", "n_60", *shown, *rounded)


@query(
    "query_filed",
    f"""with {ACTIVITY} select event_type, coalesce(sum(value) filter (where as_of_date = date '{DAY}'), 0)::double as value,
  coalesce(sum(value) filter (where as_of_date = date '2024-01-13'), 0)::double as prior from activity group by 1 having count(*) filter (where as_of_date = date '{DAY}') > 0""",
)
def query_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dashboard value over a table filed by day: its folders name the days, and two of them are read."""
    rows, path = activity(spark, sf_dir), scratch(spark, "activity")
    write_partitions(rows, path, ["as_of_date"])
    view = FiledTable(spark, path, rows.schema)
    found = Q.query_groups(view, Measure("total", "sum", "value"), ["event_type"], as_of=DAY, basis="prior_week")
    return found.withColumns({c: F.col(c).cast("double") for c in ("value", "prior")})


@query(
    "snapshot_load",
    """with log as (select o_orderkey as k, o_totalprice as v, cast(o_orderdate as date)::timestamp as loaded_at, 'a' || o_custkey::varchar as load_id from orders
  union all select o_orderkey, o_totalprice * 2, timestamp '1998-06-01', 'b' from orders where o_orderkey % 3 = 0 union all select o_orderkey, o_totalprice * 3, timestamp '1998-06-01', 'c' from orders where o_orderkey % 5 = 0),
r as (select *, row_number() over (partition by k order by loaded_at desc, load_id desc) as n from log where (loaded_at, load_id) <= (timestamp '1998-06-01', 'b')) select k, v, load_id from r where n = 1""",
)
def snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table was after load b, beside a load c at the same time."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_custkey")
    own = o.select("k", "v", F.col("o_orderdate").cast("date").cast("timestamp").alias("loaded_at"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("load_id"))
    at = F.lit("1998-06-01").cast("timestamp").alias("loaded_at")
    later = [o.where(F.col("k") % n == 0).select("k", (F.col("v") * times).alias("v"), at, F.lit(name).alias("load_id")) for n, times, name in ((3, 2, "b"), (5, 3, "c"))]
    return adapters.read_snapshot(own.unionByName(later[0]).unionByName(later[1]), ["k"], load_id="b").select("k", "v", "load_id")


# --- reconciliation ----------------------------------------------------------------------------------------------

_shown = ", ".join(f"{'o' if k == 'product_id' else 'f'}.{k}{'::varchar' if k == 'as_of_date' else ''} as {k}" for k in KEYS)


@query(
    "reconcile_findings",
    f"""with {FILED}, {_other_sql} select {_shown}, 'differs' as finding, 'gross_outflow' as measure, f.gross_outflow::double as expected, o.gross_outflow::double as actual
from {_join} where abs(f.gross_outflow::double - o.gross_outflow::double) > 0.001
union all select coalesce(product_id, ''), maturity_bucket, currency, entity_id, as_of_date::varchar, 'expected', '*', null, null from filed where day(as_of_date) = 7""",
)
def reconcile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of findings in one pass over the days whose digests differ; the filed table is made once."""
    from .quality_history import shifted

    kept = stored(filed(spark, sf_dir), "filed")
    return R.findings(kept, shifted(kept), KEYS, {"gross_outflow": R.CURRENCY, "records": R.EXACT}, day="as_of_date")


# --- graphs of documents -----------------------------------------------------------------------------------------

_KINDS = """case c_custkey % 7 when 0 then 'report' when 1 then 'variance_monitor' when 2 then 'source_binding' when 3 then 'prepared_source'
  when 4 then 'classification' when 5 then 'parameter_set' else 'metrics_view' end"""
EDGES = """e as (select distinct c_custkey as s, c_custkey * 3 + 1 as t from customer union select c_custkey, c_custkey * 2 + 1 from customer where c_custkey % 2 = 0
  union select c_custkey * 3 + 1, c_custkey from customer where c_custkey % 100 = 99)"""


def _document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 3k + 1 and some 2k + 1 read document k; a few are read by what they read."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    first = c.select(k.alias("source"), (k * 3 + 1).alias("target"))
    return first.union(c.where(k % 2 == 0).select(k, k * 2 + 1)).union(c.where(k % 100 == 99).select(k * 3 + 1, k)).distinct()


@query("lineage_stages", f"with {EDGES}, d as (select c_custkey as name, {_KINDS} as kind from customer) select name, kind, case when kind = 'report' then 'file' when kind = 'variance_monitor' then 'watch' when kind <> 'metrics_view' then 'prepare' when exists (select 1 from e join d r on r.name = e.t and r.kind = 'report' where e.s = d.name) then 'prepare' else 'publish' end as stage from d")
def lineage_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.expr(_KINDS).alias("kind"))
    return L.stages(docs, _document_edges(spark, sf_dir))


@query(
    "lineage_levels",
    f"""with recursive {EDGES}, names as (select s as name from e union select t from e), reach as (select s as a, t as b from e union select a, t from reach join e on b = s),
round as (select distinct a as name from reach where a = b), behind as (select distinct b as name from reach join round on a = name where b not in (select name from round)),
bad as (select name from round union select name from behind), good as (select s, t from e where t not in (select name from bad)),
r as (select name, 0::bigint as level from names where name not in (select t from e) union select t, level + 1 from r join good on name = s)
select name, max(level) as level, null::varchar as problem from r group by 1 union all select name, null, 'on a cycle' from round union all select name, null, 'behind a cycle' from behind""",
)
def lineage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.levels(_document_edges(spark, sf_dir))


# --- rules, codes, activity --------------------------------------------------------------------------------------

MANY = [C.Rule(f"q{q:02d}-{flag}", f"l_quantity >= {q} and l_returnflag = '{flag}'", flag) for q in range(1, 51) for flag in "ANR"]


@query(
    "overlaps_of_many_rules",
    """select 'q01-' || l_returnflag as winner, 'q' || lpad(q::varchar, 2, '0') || '-' || l_returnflag as other, count(*) as records
from lineitem, (select unnest(range(2, 51)) as q) where l_quantity >= q and l_returnflag in ('A', 'N', 'R') group by 1, 2""",
)
def overlaps_of_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 rules of 53 conditions; each condition is worked out once a row."""
    return C.rule_overlaps(_table(spark, sf_dir, "lineitem"), MANY)


_CODE = "p_brand || '-' || p_type || '-' || p_size::varchar"
_TYPO = f"""case p_partkey % 5 when 0 then reverse({_CODE}) when 1 then substr({_CODE}, 2) when 2 then 'x' || {_CODE} when 3 then replace({_CODE}, 'Brand', 'Bnard') else {_CODE} end"""


@query(
    "nearest_codes",
    f"""with known as (select distinct {_CODE} as code from part), u as (select distinct {_TYPO} as unknown from part),
r as (select unknown, code, levenshtein(unknown, code)::int as distance, row_number() over (partition by unknown order by levenshtein(unknown, code), code) as n from u, known)
select unknown, code, distance from r where n = 1""",
)
def nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    code = F.expr(_CODE.replace("::varchar", "::string"))
    return N.nearest_codes(parts.select(F.expr(_TYPO.replace("::varchar", "::string")).alias("unknown")), parts.select(code.alias("code")))


@query(
    "activity_counts",
    """with x as (select 'fixes' as figure, p_brand as name from part union all select 'boards', o_orderstatus from orders union all select 'proposals', coalesce(nullif(c_mktsegment, 'MACHINERY'), '(none)') from customer)
select figure, name, count(*) as n from x group by 1, 2 union all select figure, null, count(*) from x group by 1""",
)
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, column, to: _table(spark, sf_dir, name).select(F.col(column).alias(to))
    proposals = t("customer", "c_mktsegment", "status").select(F.nullif("status", F.lit("MACHINERY")).alias("status"))
    return H.activity_counts(t("part", "p_brand", "rule"), t("orders", "o_orderstatus", "status"), proposals)
