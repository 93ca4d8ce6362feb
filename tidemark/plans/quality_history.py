"""Queries of reconciliation, profiling, sampling, definition history and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import history as H
from ..operators import quality as K
from ..operators import rules as C
from ..sources.sinks import scratch, stored
from ..streaming import restate as S
from .fixtures import ACTIVITY, BUCKET, FILED, POSITIONS, PRODUCT, RULES, activity, filed, positions, prepared, rates
from .registry import query, values

KEYS = ["product_id", "maturity_bucket", "currency", "entity_id", "as_of_date"]


def _other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filed table as another system has it: some amounts off by little or much, some rows missing, blank for null."""
    return shifted(filed(spark, sf_dir))


def shifted(made: DataFrame) -> DataFrame:
    day = F.dayofmonth("as_of_date")
    f = made.where(day != 7)
    moved = F.col("gross_outflow") + F.when(day == 1, F.lit("0.0005").cast("decimal(10,4)")).when(day == 2, F.lit("0.0500").cast("decimal(10,4)")).otherwise(F.lit("0").cast("decimal(10,4)"))
    return f.withColumns({"gross_outflow": moved, "product_id": F.coalesce("product_id", F.lit(""))})


_other_sql = "other as (select coalesce(product_id, '') as product_id, maturity_bucket, currency, entity_id, as_of_date, gross_outflow + case day(as_of_date) when 1 then 0.0005::decimal(10,4) when 2 then 0.0500::decimal(10,4) else 0::decimal(10,4) end as gross_outflow, records from filed where day(as_of_date) <> 7)"
_join = "filed f join other o on coalesce(f.product_id, '') = o.product_id and f.maturity_bucket = o.maturity_bucket and f.currency = o.currency and f.entity_id = o.entity_id and f.as_of_date = o.as_of_date"
query("reconcile", f"with {FILED}, {_other_sql} select o.product_id, o.maturity_bucket, o.currency, o.entity_id, o.as_of_date::varchar as as_of_date, 'gross_outflow' as measure, f.gross_outflow::double as expected, o.gross_outflow::double as actual from {_join} where abs(f.gross_outflow::double - o.gross_outflow::double) > 0.001")(
    lambda s, d: (lambda f: K.reconcile(f, shifted(f), KEYS, {"gross_outflow": K.CURRENCY, "records": K.EXACT}, "as_of_date"))(stored(filed(s, d), "filed"))
)
query("reconcile_missing", f"with {FILED} select coalesce(product_id, '') as product_id, maturity_bucket, currency, entity_id, as_of_date::varchar as as_of_date, 'expected' as side from filed where day(as_of_date) = 7")(lambda s, d: K.reconcile_missing(filed(s, d), _other(s, d), KEYS))
query("mass_check", f"with {POSITIONS}, h as (select sum(balance_usd)::double as headline from positions) select dim, group_sum, headline, abs(group_sum - headline) <= 1e-9 * abs(headline) as ties from (select 'entity_id' as dim, sum(v)::double as group_sum from (select sum(balance_usd) as v from positions group by entity_id) union all select 'segment', sum(v)::double from (select sum(balance_usd) as v from positions group by segment)), h")(
    lambda s, d: K.mass_check(positions(s, d), ["entity_id", "segment"], "balance_usd")
)
query("asof_coherence", "select 'orders' as result, max(cast(o_orderdate as date)) as day, false as coherent from orders union all select 'events', max(cast(ts as date)), false from events")(
    lambda s, d: K.asof_coherence([("orders", s.read.parquet(f"{d}/orders.parquet").agg(F.max("o_orderdate").cast("date").alias("as_of_date"))), ("events", activity(s, d).agg(F.max("as_of_date").alias("as_of_date")))])
)


@query(
    "finite_check",
    f"""with {POSITIONS}, v as (select pos_key, case account_type when 'TIME' then 'nan'::double else 1 end as a, case when maturity_date is null then null when collateral_class = 'L1' then 'infinity'::double else balance_usd::double end as b from positions)
select pos_key, 'a' as "column", 'nan' as problem from v where isnan(a) union all select pos_key, 'b', case when b is null then 'null' else 'infinite' end from v where b is null or isinf(b)""",
)
def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    a = F.when(F.col("account_type") == "TIME", float("nan")).otherwise(1.0)
    b = F.when(F.col("maturity_date").isNull(), None).when(F.col("collateral_class") == "L1", float("inf")).otherwise(F.col("balance_usd").cast("double"))
    return K.finite_check(p.select("pos_key", a.alias("a"), b.alias("b")), ["pos_key"], ["a", "b"])


query("empty_filters", f"with {POSITIONS} select name, records from (select 'sideways' as name, count(*) filter (where direction = 'SIDEWAYS') as records from positions union all select 'secured', count(*) filter (where is_secured) from positions union all select 'negative', count(*) filter (where balance_usd < 0) from positions) where records = 0")(
    lambda s, d: K.empty_filters(positions(s, d), {"sideways": "direction = 'SIDEWAYS'", "secured": "is_secured", "negative": "balance_usd < 0"})
)


@query("dup_rates", f"with {POSITIONS}, {'{}'} select product_id, 2::bigint as entries, records from (select product_id, count(*) as records from p group by 1) where product_id in ('O.D.1', 'I.U.1')".format(f"p as (select {PRODUCT} as product_id from positions)"))
def dup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates listed twice, with the records that they would multiply."""
    twice = rates(spark, [("O.D.1", "0.03"), ("O.D.1", "0.04"), ("O.D.2", "0.1"), ("I.U.1", "0.2"), ("I.U.1", "0.2"), ("X.X.1", "0.5")])
    used = C.classify(positions(spark, sf_dir), RULES, "product_id").groupBy("product_id").agg(F.count("*").alias("records"))
    return C.duplicate_keys(twice, ["product_id"]).join(used, "product_id")


@query("dup_measures", "select 'sum' as agg, 'l_extendedprice' as field, '' as filter, string_agg(distinct l_returnflag, ',' order by l_returnflag) as names, count(distinct l_returnflag) as n from lineitem")
def dup_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures named after each flag of the data that all have one shape, and one that differs."""
    names = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("name")).distinct()
    same = names.select("name", F.lit("sum").alias("agg"), F.lit("l_extendedprice").alias("field"), F.lit(None).cast("string").alias("filter"))
    return K.dup_measures(same.unionByName(values(spark, [("other", "sum", "l_extendedprice", "l_tax > 0")], "name string, agg string, field string, filter string")))


query("stratified_sample", f"with {POSITIONS}, r as (select *, row_number() over (partition by segment, direction order by md5(concat_ws('|', pos_key, balance_usd::varchar)), pos_key, balance_usd) as n from positions) select pos_key, segment, direction, balance_usd::double as balance from r where n <= 5")(
    lambda s, d: K.stratified_sample(positions(s, d), ["segment", "direction"], 5, ["pos_key", "balance_usd"]).select("pos_key", "segment", "direction", F.col("balance_usd").cast("double").alias("balance"))
)
_strata = ["direction", "segment", "insured_flag", "account_type"]
query("strata_sample", f"with {POSITIONS}, r as (select *, row_number() over (partition by {', '.join(_strata)} order by md5(concat_ws('|', pos_key, balance_usd::varchar)), pos_key, balance_usd) as n from positions) select pos_key, {', '.join(_strata)}, balance_usd::double as balance from r where n <= 3")(
    lambda s, d: (lambda p: K.stratified_sample(p, C.rule_columns(RULES, p.columns), 3, ["pos_key", "balance_usd"]).select("pos_key", *_strata, F.col("balance_usd").cast("double").alias("balance")))(positions(s, d))
)

_FORMATS = "case o_orderstatus when 'F' then 'percent_2dp' when 'O' then 'currency_usd_mm' when 'P' then 'bps' end"
_EXPRESSIONS = "case when o_orderkey % 3 = 0 then '100 * total / nullif(base_' || o_custkey || ', 0)' when o_orderkey % 3 = 1 then 'sum_a /  Base_' || o_custkey else 'sum_a - sum_b' end"
query("metric_contract", f"""with m as (select o_orderkey as metric, {_FORMATS} as format, {_EXPRESSIONS} as expression from orders)
select metric, case when format like 'percent%' then 'percent' when format like 'currency_usd%' then 'USD' else 'number' end as unit,
  case when format like 'percent%' then 2 else 0 end::int as "precision", nullif(regexp_extract(expression, '/[ ]*(?:nullif[(])?([A-Za-z_][A-Za-z0-9_]*)', 1), '') as denominator from m""")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("metric"), F.expr(_FORMATS).alias("format"), F.expr(_EXPRESSIONS).alias("expression")).select(
        "metric", X.unit_of(F.col("format")).alias("unit"), X.precision_of(F.col("format")).alias("precision"), X.denominator_of(F.col("expression")).alias("denominator")
    )
)
_dim = lambda c, kind, ordered: f"select '{c}' as name, '{kind}' as type, {ordered} as is_ordered, case when count(distinct {c}) <= 8 then count(distinct {c}) end as n_values, case when count(distinct {c}) <= 8 then string_agg(distinct {c}::varchar, ',' order by {c}::varchar) end as value_list from p"
query("dim_profile", f"with {POSITIONS}, p as (select entity_id, is_secured, {BUCKET} as maturity_bucket, as_of_date, balance_usd from positions) " + " union all ".join(_dim(*x) for x in (("entity_id", "text", "false"), ("is_secured", "boolean", "false"), ("maturity_bucket", "text", "true"), ("as_of_date", "date", "false"), ("balance_usd", "number", "false"))))(
    lambda s, d: K.dim_profile(prepared(positions(s, d)).select("entity_id", "is_secured", "maturity_bucket", "as_of_date", "balance_usd"), 8, ["maturity_bucket"])
)

# --- definition history: orders as revisions of an artifact for each customer ------------------------------------

AT, ON = "1998-06-01 00:00:00", "1997-06-15"
REV = """rev as (select 'artifact-' || o_custkey::varchar as name, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as revision_no, o_orderpriority || '/' || o_orderstatus as body, o_orderdate as created_at,
  cast(o_orderdate as date) as effective_from, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) + 700 end as effective_to from orders),
latest as (select * from (select *, row_number() over (partition by name order by revision_no desc) as n from rev) where n = 1)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.concat(F.lit("artifact-"), F.col("o_custkey").cast("string")).alias("name"), F.row_number().over(w).alias("revision_no"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("body"), F.col("o_orderdate").alias("created_at"), day.alias("effective_from"), F.when(F.col("o_orderkey") % 2 == 0, F.date_add(day, 700)).alias("effective_to"))


query("latest_revision", f"with {REV} select name, revision_no, body, effective_from from latest")(lambda s, d: H.latest_revision(revisions(s, d)).select("name", "revision_no", "body", "effective_from"))
_known = f"with {REV}, known as (select * from (select *, row_number() over (partition by name order by revision_no desc) as k from rev where created_at <= timestamp '{AT}') where k = 1)"
query("as_known_at", f"{_known} select name, revision_no, body from known")(lambda s, d: H.as_known_at(revisions(s, d), AT).select("name", "revision_no", "body"))
query("bitemporal", f"{_known} select name, revision_no, effective_from, effective_to from known where effective_from <= date '{ON}' and (effective_to is null or effective_to > date '{ON}')")(lambda s, d: H.bitemporal(revisions(s, d), AT, ON).select("name", "revision_no", "effective_from", "effective_to"))
query("revision_history", f"with {REV} select name, revision_no, length(body)::int as size, cast(created_at as date) as created_on from rev")(lambda s, d: H.revision_history(revisions(s, d)).select("name", "revision_no", "size", F.col("created_at").cast("date").alias("created_on")))


@query(
    "append_dedup",
    f"""with {REV}, batch as (select name, 1 as seq, body from latest union all select name, 2, body || case when revision_no % 2 = 0 then '' else '!' end from latest union all select name, 3, body || case when revision_no % 2 = 0 then '?' else '!' end from latest union all select 'artifact-new', 1, 'x'),
b as (select b.*, l.revision_no as no, coalesce(lag(b.body) over (partition by b.name order by seq), l.body) as was from batch b left join latest l using (name))
select name, seq, sha256(body) as content_hash, (coalesce(no, 0) + row_number() over (partition by name order by seq))::int as revision_no from b where body is distinct from was""",
)
def append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = revisions(spark, sf_dir)
    last = H.latest_revision(rev)
    even = F.col("revision_no") % 2 == 0
    tails = [F.lit(""), F.when(even, "").otherwise("!"), F.when(even, "?").otherwise("!")]
    batch = last.select("name", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("seq"), F.concat("body", t).alias("body")) for i, t in enumerate(tails)])).alias("b")).select("name", "b.*")
    return H.append_revisions(rev, batch.unionByName(values(spark, [("artifact-new", 1, "x")], "name string, seq int, body string")))


PINS = "pins as (select name, max(revision_no) filter (where created_at <= timestamp '1997-01-01') as revision_no from rev group by 1 having count(*) filter (where created_at <= timestamp '1997-01-01') > 0)"


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.as_known_at(revisions(spark, sf_dir), "1997-01-01").select("name", "revision_no")


query("release_contents", f"with {REV}, {PINS} select name, revision_no, body from pins join rev using (name, revision_no)")(lambda s, d: H.release_contents(_pins(s, d), revisions(s, d)).select("name", "revision_no", "body"))
query("channel_at", f"with p as (select o_orderpriority as channel, o_orderkey as version, o_orderdate as created_at from orders where o_orderdate <= timestamp '{AT}'), r as (select *, row_number() over (partition by channel order by created_at desc, version desc) as n from p) select channel, version from r where n = 1")(
    lambda s, d: H.channel_at(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("channel"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at")), AT)
)
query("ahead_of_release", f"with {REV}, {PINS}, dep as (select name, body from pins join rev using (name, revision_no)) select l.name, l.revision_no, case when dep.name is null then 'new' else 'changed' end as status from latest l left join dep on dep.name = l.name where dep.body is distinct from l.body")(
    lambda s, d: H.ahead_of_release(revisions(s, d), H.release_contents(_pins(s, d), revisions(s, d)).select("name", F.sha2("body", 256).alias("content_hash")))
)
query("stale_pins", f"with {REV}, {PINS}, b as (select right(name, 1) as board, 'i' || t.i::varchar as item, name, revision_no from pins, (values (1), (2)) t(i)) select board, b.name, l.revision_no as latest_no, string_agg(distinct item, ',' order by item) as items from b join latest l on l.name = b.name where b.revision_no < l.revision_no group by all")(
    lambda s, d: H.stale_pins(_pins(s, d).select(F.substring("name", -1, 1).alias("board"), F.explode(F.array(F.lit("i1"), F.lit("i2"))).alias("item"), "name", "revision_no"), revisions(s, d))
)
query("lineage_closure", "with recursive e as (select distinct 's' || c_custkey::varchar as source, 's' || (c_custkey * 3 + 1)::varchar as target from customer), r as (select source, target, 1 as depth from e union select r.source, e.target, depth + 1 from r join e on r.target = e.source where depth < 40) select source, target, min(depth)::int as depth from r group by 1, 2")(
    lambda s, d: (lambda n: H.closure(s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("s"), n.cast("string")).alias("source"), F.concat(F.lit("s"), (n * 3 + 1).cast("string")).alias("target"))))(F.col("c_custkey"))
)
query(
    "activity_metrics",
    """with a as (select o_orderpriority as board, o_orderstatus = 'F' as approved, (o_orderkey % 97)::double as wait_hours, o_orderkey % 13 as version from orders), s as (select board, list_sort(list(wait_hours)) as w from a group by 1)
select board, count(*) as decisions, count(*) filter (where approved)::double / count(*)::double as approval_rate, any_value(w[len(w) // 2 + 1]) as median_wait, count(distinct version) as versions from a join s using (board) group by 1""",
)(
    lambda s, d: H.activity_metrics(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("board"), (F.col("o_orderstatus") == "F").alias("approved"), (F.col("o_orderkey") % 97).cast("double").alias("wait_hours"), (F.col("o_orderkey") % 13).alias("version")))
)

# --- streams -----------------------------------------------------------------------------------------------------


def _stream_source(spark: SparkSession, sf_dir: str) -> tuple[str, object, int]:
    """Activity in files of even and then of odd events, so that every day has rows that come late; and how many files the first half has."""
    path = scratch(spark, "arrivals")
    rows = activity(spark, sf_dir)
    rows.where(F.col("event_id") % 2 == 0).write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    rows.where(F.col("event_id") % 2 == 1).write.mode("append").parquet(path)
    return path, rows.schema, max(files, 1)


@query("stream_row_stage", f"with {ACTIVITY} select event_type, case when value >= 20 then 'large' when value >= 5 then 'medium' end as size, count(*) as n from activity group by 1, 2")
def stream_row_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema, files = _stream_source(spark, sf_dir)
    sizes = [C.Rule("a", "value >= 20", "large"), C.Rule("b", "value >= 5", "medium")]
    stream = S.staged_stream(spark, path, schema, [lambda d: C.classify(d, sizes, "size")], files)
    out = scratch(spark, "staged")
    S.drain(stream.select("event_type", "size"), out, scratch(spark, "state"))
    return spark.read.schema("event_type string, size string").parquet(out).groupBy("event_type", "size").agg(F.count("*").alias("n"))


@query("stream_restate", f"with {ACTIVITY} select event_type, as_of_date, sum(value)::double as value, count(*) as records from activity group by 1, 2")
def stream_restate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema, files = _stream_source(spark, sf_dir)
    table = scratch(spark, "restated")
    S.restate(S.staged_stream(spark, path, schema, [], files), scratch(spark, "log"), table, scratch(spark, "state"), ["event_type"], ["value"])
    return spark.read.schema("event_type string, value decimal(38,4), records long, as_of_date date").parquet(table).select("event_type", "as_of_date", F.col("value").cast("double").alias("value"), "records")


