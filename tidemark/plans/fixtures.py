"""The tables that queries run on: positions, filed, activity, and the definitions that go with them; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import date_bucket, days_between
from ..operators.measures import Measure
from ..operators.report import ReportSpec, report
from ..operators.rules import Rule, classify, param_lookup
from ..sources.adapters import Binding, adapt

LADDER = [("0-1", 1), ("2-7", 7), ("8-30", 30), ("31-90", 90), ("91-365", 365), ("over-365", None)]
BINDING = Binding(
    columns={
        "as_of_date": "cob_date", "entity_id": "legal_ent", "currency": "ccy", "segment": "cust_seg", "direction": "flow_dir", "is_secured": "secured_flg", "insured_flag": "ins_flg",
        "collateral_class": "coll_class", "account_type": "acct_type", "balance_usd": "bal_amt", "maturity_date": "mat_date", "pos_key": "pos_key",
    },
    values={
        "segment": {"BUILDING": "RETAIL", "HOUSEHOLD": "RETAIL", "FURNITURE": "SMALL_BUSINESS", "AUTOMOBILE": "WHOLESALE"},
        "direction": {"A": "OUTFLOW", "N": "OUTFLOW", "R": "INFLOW"},
        "collateral_class": {"1-URGENT": "L1", "2-HIGH": "L2A", "3-MEDIUM": "L2B", "4-NOT SPECIFIED": "NON_HQLA", "5-LOW": "UNSECURED"},
    },
)
RULES = [
    Rule("r1", "direction = 'OUTFLOW' and segment = 'RETAIL' and insured_flag", "O.D.1"),
    Rule("r2", "direction = 'OUTFLOW' and segment = 'RETAIL'", "O.D.2"),
    Rule("r3", "direction = 'OUTFLOW' and segment = 'SMALL_BUSINESS' and account_type in ('OPERATIONAL', 'TRANSACTIONAL')", "O.W.1"),
    Rule("r4", "direction = 'OUTFLOW' and segment in ('SMALL_BUSINESS', 'WHOLESALE')", "O.W.2"),
    Rule("r5", "direction = 'INFLOW' and is_secured and collateral_class in ('L1', 'L2A')", "I.S.1"),
    Rule("r6", "direction = 'INFLOW' and segment is not null", "I.U.1"),
    Rule("r7", "direction = 'SIDEWAYS'", "X.X.1"),
    Rule("r8", "direction = 'INFLOW' and is_secured and collateral_class = 'L1' and segment is not null", "I.S.2"),
]
RULES_AFTER = [
    Rule("r1", "direction = 'OUTFLOW' and segment = 'RETAIL' and insured_flag and account_type <> 'TIME'", "O.D.1"),
    Rule("r2", "direction = 'OUTFLOW' and segment = 'RETAIL'", "O.D.2"),
    Rule("r4", "direction = 'OUTFLOW' and segment in ('SMALL_BUSINESS', 'WHOLESALE')", "O.W.2"),
    Rule("r5", "direction = 'INFLOW' and is_secured and collateral_class = 'L1'", "I.S.1"),
    Rule("r6", "direction = 'INFLOW' and segment = 'RETAIL'", "I.U.1"),
]
RATES = [("O.D.1", "0.0300"), ("O.D.2", "0.1000"), ("O.W.1", "0.2500"), ("I.S.1", "0.5000")]
RATES_2 = [("O.D.1", "USD", "0.0300"), ("O.D.1", "EUR", "0.0500"), ("O.D.2", "USD", "0.1000"), ("O.W.2", "EUR", "0.4000")]
#: Half-open ranges with a gap (from 1998-01-01 to 1998-07-01) and an overlap (1999-06-01 to 2000-01-01).
VERSIONS = [(1, "1995-01-01", "1996-01-01", "0.1000"), (2, "1996-01-01", "1998-01-01", "0.1500"), (3, "1998-07-01", "2000-01-01", "0.2000"), (4, "1999-06-01", None, "0.2500")]
PLAIN_VERSIONS = [(1, "1990-01-01", "1996-01-01", "0.1000"), (2, "1996-01-01", "1998-01-01", "0.1500"), (3, "1998-01-01", None, "0.2000")]

# --- the same in SQL ---------------------------------------------------------------------------------------------

POSITIONS = """positions as (
  select cast(o_orderdate as date) as as_of_date, r_name as entity_id, case when r_name = 'EUROPE' then 'EUR' else 'USD' end as currency,
    case c_mktsegment when 'BUILDING' then 'RETAIL' when 'HOUSEHOLD' then 'RETAIL' when 'FURNITURE' then 'SMALL_BUSINESS' when 'AUTOMOBILE' then 'WHOLESALE' end as segment,
    case l_returnflag when 'A' then 'OUTFLOW' when 'N' then 'OUTFLOW' when 'R' then 'INFLOW' end as direction,
    l_linestatus = 'F' as is_secured, l_discount <= 0.04 as insured_flag,
    case o_orderpriority when '1-URGENT' then 'L1' when '2-HIGH' then 'L2A' when '3-MEDIUM' then 'L2B' when '4-NOT SPECIFIED' then 'NON_HQLA' when '5-LOW' then 'UNSECURED' end as collateral_class,
    case when l_quantity <= 10 then 'TRANSACTIONAL' when l_quantity <= 25 then 'SAVINGS' when l_quantity <= 40 then 'OPERATIONAL' else 'TIME' end as account_type,
    cast(l_extendedprice as decimal(18,2)) as balance_usd,
    case when l_linestatus = 'O' and l_quantity >= 46 then null else cast(l_shipdate as date) end as maturity_date,
    concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) as pos_key
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
RULE_SQL = {
    "r1": "direction = 'OUTFLOW' and segment = 'RETAIL' and insured_flag", "r2": "direction = 'OUTFLOW' and segment = 'RETAIL'",
    "r3": "direction = 'OUTFLOW' and segment = 'SMALL_BUSINESS' and account_type in ('OPERATIONAL', 'TRANSACTIONAL')", "r4": "direction = 'OUTFLOW' and segment in ('SMALL_BUSINESS', 'WHOLESALE')",
    "r5": "direction = 'INFLOW' and is_secured and collateral_class in ('L1', 'L2A')", "r6": "direction = 'INFLOW' and segment is not null", "r7": "direction = 'SIDEWAYS'",
    "r8": "direction = 'INFLOW' and is_secured and collateral_class = 'L1' and segment is not null",
}
PRODUCT = f"""case when {RULE_SQL['r1']} then 'O.D.1' when {RULE_SQL['r2']} then 'O.D.2' when {RULE_SQL['r3']} then 'O.W.1' when {RULE_SQL['r4']} then 'O.W.2'
  when {RULE_SQL['r5']} then 'I.S.1' when {RULE_SQL['r6']} then 'I.U.1' end"""
WINNER = f"""case when {RULE_SQL['r1']} then 'r1' when {RULE_SQL['r2']} then 'r2' when {RULE_SQL['r3']} then 'r3' when {RULE_SQL['r4']} then 'r4'
  when {RULE_SQL['r5']} then 'r5' when {RULE_SQL['r6']} then 'r6' end"""
BUCKET = """case when maturity_date is null then 'open' when maturity_date - as_of_date <= 1 then '0-1' when maturity_date - as_of_date <= 7 then '2-7' when maturity_date - as_of_date <= 30 then '8-30'
  when maturity_date - as_of_date <= 90 then '31-90' when maturity_date - as_of_date <= 365 then '91-365' else 'over-365' end"""
RATE_SQL = "rates(product_id, rate) as (values ('O.D.1', 0.0300::decimal(9,4)), ('O.D.2', 0.1000), ('O.W.1', 0.2500), ('I.S.1', 0.5000))"
STAGED = f"""{POSITIONS}, {RATE_SQL}, staged0 as (select *, coalesce(maturity_date - as_of_date, 0)::int as days_to_maturity, {BUCKET} as maturity_bucket, {PRODUCT} as product_id, {WINNER} as rule_id from positions),
staged as (select s.*, r.rate from staged0 s left join rates r using (product_id))"""
FILED = f"""{STAGED}, filed as (select product_id, maturity_bucket, currency, entity_id, as_of_date,
  cast(round(coalesce(sum(balance_usd) filter (where direction = 'OUTFLOW'), 0), 2) as decimal(38,2)) as gross_outflow,
  cast(round(coalesce(sum(balance_usd * rate) filter (where direction = 'OUTFLOW' and days_to_maturity <= 30), 0), 2) as decimal(38,2)) as weighted_outflow_30d,
  cast(round(coalesce(sum(balance_usd) filter (where direction = 'INFLOW'), 0), 2) as decimal(38,2)) as gross_inflow, count(*) as records
  from staged group by all)"""
ACTIVITY = "activity as (select cast(ts as date) as as_of_date, event_type, cast(value as decimal(18,4)) as value, user_id, event_id from events)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def foreign_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as a client system names and codes them."""
    t = lambda n: _read(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    q = F.col("l_quantity")
    return rows.select(
        F.col("o_orderdate").cast("date").alias("cob_date"), F.col("r_name").alias("legal_ent"), F.when(F.col("r_name") == "EUROPE", "EUR").otherwise("USD").alias("ccy"), F.col("c_mktsegment").alias("cust_seg"), F.col("l_returnflag").alias("flow_dir"),
        (F.col("l_linestatus") == "F").alias("secured_flg"), (F.col("l_discount") <= 0.04).alias("ins_flg"), F.col("o_orderpriority").alias("coll_class"),
        F.when(q <= 10, "TRANSACTIONAL").when(q <= 25, "SAVINGS").when(q <= 40, "OPERATIONAL").otherwise("TIME").alias("acct_type"), F.col("l_extendedprice").cast("decimal(18,2)").alias("bal_amt"),
        F.when((F.col("l_linestatus") == "O") & (q >= 46), None).otherwise(F.col("l_shipdate").cast("date")).alias("mat_date"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos_key"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt(foreign_positions(spark, sf_dir), BINDING)


def rates(spark: SparkSession, rows=RATES) -> DataFrame:
    return spark.createDataFrame(rows, "product_id string, rate string").withColumn("rate", F.col("rate").cast("decimal(9,4)"))


def prepared(df: DataFrame) -> DataFrame:
    """The row stage that several views share: days and bucket."""
    return df.withColumns({"days_to_maturity": days_between(F.col("as_of_date"), F.col("maturity_date")), "maturity_bucket": date_bucket(F.col("as_of_date"), F.col("maturity_date"), LADDER)})


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with days, bucket, product, winning rule and rate."""
    return param_lookup(classify(prepared(positions(spark, sf_dir)), RULES, "product_id", "rule_id"), rates(spark), ["product_id"], "rate", "rate")


REPORT = ReportSpec(
    grouping=("product_id", "maturity_bucket", "currency", "entity_id"),
    measures=(
        Measure("gross_outflow", "sum", "balance_usd", "direction = 'OUTFLOW'", money=True),
        Measure("weighted_outflow_30d", "sum", "balance_usd * rate", "direction = 'OUTFLOW' and days_to_maturity <= 30", money=True),
        Measure("gross_inflow", "sum", "balance_usd", "direction = 'INFLOW'", money=True),
    ),
)


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(staged(spark, sf_dir), REPORT)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("date").alias("as_of_date"), "event_type", F.col("value").cast("decimal(18,4)").alias("value"), "user_id", "event_id")
