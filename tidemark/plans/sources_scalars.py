"""Queries of sources, sinks, predicates and scalar expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.measures import Measure, derive, series
from ..sources import adapters, sinks
from ..sources.filed import FiledTable
from ..sources.sinks import scratch
from .fixtures import ACTIVITY, BINDING, BUCKET, FILED, LADDER, POSITIONS, activity, filed, foreign_positions, positions
from .registry import query, values


DAY, PERIOD = "1997-03-14", "1997"

query("scan_as_of", f"with {POSITIONS} select pos_key, entity_id, balance_usd::double as balance_usd from positions where as_of_date = date '1997-03-14'")(
    lambda s, d: adapters.scan_as_of(positions(s, d), DAY).select("pos_key", "entity_id", F.col("balance_usd").cast("double").alias("balance_usd"))
)
query("series_trailing", f"with {ACTIVITY} select as_of_date, event_type, sum(value)::double as value from activity where as_of_date > date '2024-01-20' - 7 and as_of_date <= date '2024-01-20' group by 1, 2")(
    lambda s, d: adapters.scan_trailing(activity(s, d), 7, "2024-01-20").groupBy("as_of_date", "event_type").agg(F.sum("value").cast("double").alias("value"))
)


@query("publish_view", f"with {ACTIVITY} select as_of_date, sum(value)::double as total, count(*) as n, sum(value)::double / nullif(count(*), 0)::double as mean_value from activity group by 1")
def publish_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = series(activity(spark, sf_dir), [Measure("total", "sum", "value"), Measure("n", "count")])
    shown = derive(made.withColumn("total", F.col("total").cast("double")), {"mean_value": (("total", "n"), "try_divide(total, cast(n as double))")})
    return sinks.publish(shown, "activity_daily")


@query(
    "snapshot_read",
    """with log as (select o_orderkey as k, o_totalprice as v, o_orderdate as loaded_at from orders
  union all select o_orderkey, o_totalprice * 2, o_orderdate + interval 400 day from orders where o_orderkey % 3 = 0),
r as (select *, row_number() over (partition by k order by loaded_at desc) as n from log where loaded_at <= timestamp '1998-06-01')
select k, v, loaded_at from r where n = 1""",
)
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("loaded_at"))
    again = first.where("k % 3 = 0").select("k", (F.col("v") * 2).alias("v"), (F.col("loaded_at") + F.expr("interval 400 days")).alias("loaded_at"))
    return adapters.read_snapshot(first.unionByName(again), ["k"], "1998-06-01")


@query(
    "type_profile",
    """select 'o_day' as "column", 'DATE' as type, count(*) as non_empty from orders union all select 'o_total', 'DOUBLE', count(*) from orders
union all select 'o_urgent', 'BOOLEAN', count(*) from orders union all select 'o_status', 'VARCHAR', count(*) from orders union all select 'o_blank', 'VARCHAR', 0 from (select 1)""",
)
def type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_total"), (F.col("o_orderpriority") == "1-URGENT").cast("string").alias("o_urgent"), F.col("o_orderstatus").alias("o_status"), F.lit("").alias("o_blank"))
    return adapters.profile_types(text)


@query("typed_load", "select o_orderkey, case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as o_day, o_totalprice, o_orderpriority = '1-URGENT' as urgent from orders")
def typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = scratch(spark, "csv")
    o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("o_day"), "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("urgent")).write.option("header", True).csv(path)
    return adapters.load_typed(spark, path, "o_orderkey long, o_day date, o_totalprice double, urgent boolean")


query("adapter", f"with {POSITIONS} select segment, direction, collateral_class, count(*) as records, sum(balance_usd)::double as balance from positions group by all")(
    lambda s, d: adapters.adapt(foreign_positions(s, d), BINDING).groupBy("segment", "direction", "collateral_class").agg(F.count("*").alias("records"), F.sum("balance_usd").cast("double").alias("balance"))
)


@query(
    "partition_overwrite",
    f"""with {FILED} select product_id, maturity_bucket, currency, entity_id, as_of_date, case when as_of_date = date '1997-03-14' then gross_outflow::double + 1 else gross_outflow::double end as gross_outflow
from filed""",
)
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File all days, file one day again with other numbers, read all of it back."""
    path = scratch(spark, "filed")
    days = filed(spark, sf_dir).select("product_id", "maturity_bucket", "currency", "entity_id", "as_of_date", F.col("gross_outflow").cast("double").alias("gross_outflow"))
    sinks.write_partitions(days, path, ["as_of_date"])
    table = FiledTable(spark, path, days.schema)
    one = sinks.stored(table.read([date.fromisoformat(DAY)]), "day")  # a folder cannot be read while it is written over
    sinks.write_partitions(one.withColumn("gross_outflow", F.col("gross_outflow") + 1), path, ["as_of_date"])
    return spark.read.schema(days.schema).parquet(path)


@query("append_sink", "select event_type, count(*) * 2 as n from events group by 1")
def append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "log")
    rows = activity(spark, sf_dir).select("event_type", "event_id")
    sinks.write_whole(rows.limit(0), path)
    sinks.write_append(rows, path)
    sinks.write_append(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


query("capped_read", "select c_custkey, c_name, (select count(*) from customer) > 25 as truncated from customer order by c_custkey limit 25")(
    lambda s, d: adapters.capped(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name"), 25, ["c_custkey"])
)


def _count(name: str, where: str, sql_where: str | None = None) -> None:
    """A filter over positions: records and balance that it keeps."""
    query(name, f"with {POSITIONS} select entity_id, count(*) as records, coalesce(sum(balance_usd), 0)::double as balance from positions where {sql_where or where} group by 1")(
        lambda s, d: positions(s, d).where(F.expr(where)).groupBy("entity_id").agg(F.count("*").alias("records"), F.coalesce(F.sum("balance_usd"), F.lit(0)).cast("double").alias("balance"))
    )


_count("filter_cmp", "balance_usd >= 1000 and balance_usd < 50000 and segment <> 'RETAIL' and currency = 'USD' and as_of_date > date'1996-01-01' and as_of_date <= date'1999-01-01'", "balance_usd >= 1000 and balance_usd < 50000 and segment <> 'RETAIL' and currency = 'USD' and as_of_date > date '1996-01-01' and as_of_date <= date '1999-01-01'")
_count("filter_bool", "not (direction = 'OUTFLOW' or is_secured) and insured_flag or account_type = 'TIME'")
_count("filter_in", "segment in ('RETAIL', 'WHOLESALE') and account_type not in ('TIME')")
_count("filter_null", "segment is null and maturity_date is not null")

query("expr_arith", f"with {POSITIONS} select pos_key, -(balance_usd * 2 + 10.5)::double as a, (balance_usd - 3)::double / nullif((case when insured_flag then 0 else 4 end)::double, 0) as b from positions")(
    lambda s, d: positions(s, d).select("pos_key", (-(F.col("balance_usd") * 2 + F.lit(10.5).cast("decimal(4,1)"))).cast("double").alias("a"), X.safe_div(F.col("balance_usd") - 3, F.when(F.col("insured_flag"), 0).otherwise(4)).alias("b"))
)

# every line gives two operands: amounts of its own, zero, one or both missing, equal ones
OPERANDS = """operands as (select concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) as line,
  case when l_linenumber % 5 = 0 then null when l_linenumber % 5 = 1 then 0 else l_discount - 0.05 end as x,
  case when l_partkey % 4 = 0 then null when l_partkey % 4 = 1 then l_discount - 0.05 else l_tax end as y, l_quantity as n from lineitem)"""


def _operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = F.col("l_linenumber") % 5, F.col("l_partkey") % 4
    own = F.col("l_discount") - 0.05
    x = F.when(line == 0, None).when(line == 1, F.lit(0.0)).otherwise(own)
    y = F.when(part == 0, None).when(part == 1, own).otherwise(F.col("l_tax"))
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(key, x.alias("x"), y.alias("y"), F.col("l_quantity").alias("n"))


_extreme = "case when x is null or y is null then null else {}(x, y, n) end"
query("expr_minmax", f"with {OPERANDS} select line, {_extreme.format('greatest')} as hi, {_extreme.format('least')} as lo from operands")(
    lambda s, d: _operands(s, d).select("line", X.nmax(F.col("x"), F.col("y"), F.col("n")).alias("hi"), X.nmin(F.col("x"), F.col("y"), F.col("n")).alias("lo"))
)
query("expr_nulls", f"with {OPERANDS} select line, nullif(x, y) as a, coalesce(x, y, n) as b, abs(x) as c from operands")(
    lambda s, d: _operands(s, d).select("line", F.nullif("x", "y").alias("a"), F.coalesce("x", "y", "n").alias("b"), F.abs("x").alias("c"))
)
query("expr_round", f"with {POSITIONS} select pos_key, round(balance_usd, 1)::double as r, floor(balance_usd)::bigint as f, ceil(balance_usd)::bigint as c from positions")(
    lambda s, d: positions(s, d).select("pos_key", F.round("balance_usd", 1).cast("double").alias("r"), F.floor("balance_usd").cast("long").alias("f"), F.ceil("balance_usd").cast("long").alias("c"))
)
CASES = [("balance_usd > 50000 and direction = 'OUTFLOW'", "3"), ("segment = 'RETAIL'", "2"), ("insured_flag", "1")]
_case_sql = "case when balance_usd > 50000 and direction = 'OUTFLOW' then {0} when segment = 'RETAIL' then {1} when insured_flag then {2} "
query("expr_case", f"with {POSITIONS} select {_case_sql.format(3, 2, 1)} else 0 end::int as v, {_case_sql.format(3, 2, 1)} end::int as w, count(*) as n from positions group by all")(
    lambda s, d: positions(s, d).select(X.case_value([(F.expr(c), F.lit(int(v))) for c, v in CASES], F.lit(0)).alias("v"), X.case_value([(F.expr(c), F.lit(int(v))) for c, v in CASES]).alias("w")).groupBy("v", "w").agg(F.count("*").alias("n"))
)
_branches = _case_sql.format("'branch 1'", "'branch 2'", "'branch 3'")
query("case_branch", f"with {POSITIONS} select {_branches} else 'else' end as a, {_branches} else 'no branch matched' end as b, count(*) as n from positions group by all")(
    lambda s, d: positions(s, d).select(X.case_branch([F.expr(c) for c, _ in CASES], True).alias("a"), X.case_branch([F.expr(c) for c, _ in CASES], False).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
)
query("expr_bool", f"with {POSITIONS} select entity_id, sum((balance_usd > 20000)::int)::bigint as big, sum((is_secured and not insured_flag)::int)::bigint as odd from positions group by 1")(
    lambda s, d: positions(s, d).select("entity_id", X.truth(F.col("balance_usd") > 20000).alias("a"), X.truth(F.col("is_secured") & ~F.col("insured_flag")).alias("b")).groupBy("entity_id").agg(F.sum("a").alias("big"), F.sum("b").alias("odd"))
)
query("days_between", f"with {POSITIONS} select pos_key, coalesce(maturity_date - as_of_date, 0)::int as days from positions")(
    lambda s, d: positions(s, d).select("pos_key", X.days_between(F.col("as_of_date"), F.col("maturity_date")).alias("days"))
)
query("date_bucket", f"with {POSITIONS} select {BUCKET} as bucket, count(*) as records, min(maturity_date - as_of_date)::int as lo, max(maturity_date - as_of_date)::int as hi from positions group by 1")(
    lambda s, d: positions(s, d).groupBy(X.date_bucket(F.col("as_of_date"), F.col("maturity_date"), LADDER).alias("bucket")).agg(F.count("*").alias("records"), F.min(F.datediff("maturity_date", "as_of_date")).alias("lo"), F.max(F.datediff("maturity_date", "as_of_date")).alias("hi"))
)


@query(
    "cent_rounding",
    """with v as (select cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(9,4)) * cast(0.125 as decimal(4,3)) as x, l_linenumber from lineitem
  union all select * from (values (1.005::decimal(18,9), 1), (-1.005, 2), (0.015, 3), (-0.015, 4), (2.675, 5)) e(x, l_linenumber))
select l_linenumber, round(x, 2)::decimal(38,2)::double as amount, count(*) as n from v group by 1, 2""",
)
def cent_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = li.select((F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(9,4)") * F.lit("0.125").cast("decimal(4,3)")).cast("decimal(30,9)").alias("x"), F.col("l_linenumber"))
    edge = values(spark, [("1.005", 1), ("-1.005", 2), ("0.015", 3), ("-0.015", 4), ("2.675", 5)], "x string, l_linenumber int").select(F.col("x").cast("decimal(30,9)").alias("x"), "l_linenumber")
    return x.unionByName(edge).groupBy("l_linenumber", X.amount(F.col("x")).alias("amount")).agg(F.count("*").alias("n"))


@query(
    "format_values",
    """with v as (select s_suppkey, cast(s_acctbal as decimal(18,2)) as x from supplier union all select -1, 1234567.89 union all select -2, null union all select -3, -0.05),
r as (select *, round(x, 1)::decimal(38,1)::varchar as d1, round(x, 2)::decimal(38,2)::varchar as d2, round(x, 0)::bigint::varchar as d0 from v)
select s_suppkey, coalesce(d1 || '%', '-') as percent_1dp, coalesce(d2 || '%', '-') as percent_2dp, coalesce((case when x < 0 then '-' else '' end) || '$' || format('{:,}', round(abs(x), 0)::bigint), '-') as usd,
  coalesce((case when x < 0 then '-' else '' end) || '$' || round(abs(x)::decimal(38,8) / 1000000::decimal(38,8), 1)::decimal(38,1)::varchar || 'mm', '-') as usd_mm, coalesce(d0 || ' bps', '-') as bps,
  coalesce((case when x > 0 then '+' else '' end) || d2, '-') as delta from r""",
)
def format_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_acctbal").cast("decimal(18,2)").alias("x"))
    edge = values(spark, [(-1, "1234567.89"), (-2, None), (-3, "-0.05")], "s_suppkey long, x string").select("s_suppkey", F.col("x").cast("decimal(18,2)").alias("x"))
    return x.unionByName(edge).select("s_suppkey", *[X.formatted(F.col("x"), f).alias(f) for f in ("percent_1dp", "percent_2dp", "usd", "usd_mm", "bps", "delta")])


DOMAIN = ["BUILDING", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE", "MACHINE"]


@query(
    "nearest_code",
    """with d(code) as (values ('BUILDING'), ('HOUSEHOLD'), ('FURNITURE'), ('AUTOMOBILE'), ('MACHINE')), u as (select c_mktsegment as unknown, count(*) as records from customer where c_mktsegment not in (select code from d) group by 1
  union all select 'HOUSHOLD', 1), r as (select unknown, records, code as suggestion, levenshtein(unknown, code)::int as distance, row_number() over (partition by unknown order by levenshtein(unknown, code), code) as n from u, d)
select unknown, records, suggestion, distance from r where n = 1""",
)
def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each code that the domain lacks the nearest one that it has; only distinct codes meet the domain."""
    domain = values(spark, [(c,) for c in DOMAIN], "code string")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("unknown")).agg(F.count("*").alias("records"))
    unknown = c.unionByName(values(spark, [("HOUSHOLD", 1)], "unknown string, records long")).join(F.broadcast(domain), F.col("unknown") == F.col("code"), "left_anti")
    near = unknown.crossJoin(F.broadcast(domain)).withColumn("distance", F.levenshtein("unknown", "code"))
    return near.groupBy("unknown", "records").agg(F.min(F.struct("distance", "code")).alias("m")).select("unknown", "records", F.col("m.code").alias("suggestion"), F.col("m.distance").alias("distance"))


VOCAB_SQL = "select * from (values ('segment', 'unreachable', 'PUBLIC_SECTOR', 0::bigint), ('direction', 'unreachable', 'SIDEWAYS', 0)) union all select 'segment', 'unmapped', c_mktsegment, count(*) from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY' group by 1, 2, 3"
query("vocab_gaps", f"select field, gap, value, records from ({VOCAB_SQL}) t(field, gap, value, records)")(
    lambda s, d: adapters.vocab_gaps(foreign_positions(s, d), BINDING, {"segment": ["RETAIL", "WHOLESALE", "PUBLIC_SECTOR"], "direction": ["OUTFLOW", "INFLOW", "SIDEWAYS"]})
)
