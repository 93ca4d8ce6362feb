"""Refusals, edge inputs and invariants of the metrics engine."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import history, impact, measures, quality, report, rules, variance
from tidemark.operators import query as Q
from tidemark.operators.measures import Measure
from tidemark.sources import adapters, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cents_round_half_away_from_zero(spark):
    for text, want in (("1.005", 1.01), ("-1.005", -1.01), ("0.004", 0.0), ("2.675", 2.68)):
        assert one(spark, X.amount(F.lit(text).cast("decimal(18,9)")))[0] == want


def test_extremes_are_null_strict(spark):
    assert one(spark, X.nmax(F.lit(None).cast("double"), F.lit(0.0)))[0] is None
    assert one(spark, X.nmin(F.lit(3.0), F.lit(5.0)))[0] == 3.0


def test_division_by_zero_has_no_value(spark):
    assert one(spark, X.safe_div(F.lit(1.0), F.lit(0.0)))[0] is None


def test_formats(spark):
    d = lambda t: F.lit(t).cast("decimal(18,4)")
    assert one(spark, X.formatted(d("12.345"), "percent_1dp"))[0] == "12.3%"
    assert one(spark, X.formatted(d("-1234567.5"), "usd"))[0] == "-$1,234,568"
    assert one(spark, X.formatted(d("1500"), "tick"))[0] == "2k"
    assert one(spark, X.formatted(F.lit(None).cast("decimal(18,4)"), "usd"))[0] == "-"


def test_report_refuses_columns_it_cannot_make(spark):
    df = spark.range(1).withColumn("as_of_date", F.current_date())
    spec = report.ReportSpec(("entity",), (Measure("n", "count"),))
    with pytest.raises(ValueError, match="entity"):
        report.report(df, spec)


def test_lookup_refuses_duplicate_keys(spark):
    rates = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, r double")
    with pytest.raises(ValueError, match="more than once"):
        rules.param_lookup(spark.createDataFrame([("a",)], "k string"), rates, ["k"], "r", "rate")


def test_group_cap(spark):
    with pytest.raises(ValueError, match="more than 3"):
        Q.check_groups(spark.range(10), ["id"], 3)
    Q.check_groups(spark.range(3), ["id"], 3)


def test_export_needs_permission(spark):
    with pytest.raises(PermissionError):
        quality.export_rows("secret", spark.range(1), ["open"])


def test_promotion_gate(spark):
    weak = spark.createDataFrame([("silenced", 1, 3, True)], "kind string, rank int, findings long, weakens boolean")
    with pytest.raises(ValueError, match="silenced"):
        impact.promote(weak, False)
    impact.promote(weak, True)
    impact.promote(weak.where("false"), False)


def test_binding_issues():
    b = adapters.Binding({"a": "x", "b": "y"})
    assert adapters.binding_issues(["x"], b, ["a", "c"]) == ["c: needed, not mapped", "b: mapped, not read", "y: not a column of the source"]


def test_derived_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        measures.dependency_order({"a": (("b",), "b"), "b": (("a",), "a")})


def test_many_rules_match_as_an_array(spark):
    many = [rules.Rule(f"r{i}", f"id = {i}", f"e{i}") for i in range(150)]
    got = {r["id"]: (r["v"], r["rule"]) for r in rules.classify(spark.range(200), many, "v", "rule").collect()}
    assert got[0] == ("e0", "r0") and got[149] == ("e149", "r149") and got[150] == (None, None)


def test_verdicts_at_9_10_and_11_changes(spark):
    rows = [(k, f"2024-01-{d:02d}", float(100 + (d % 2) * (1 if d < n + 2 else 50))) for k, n in (("nine", 9), ("ten", 10), ("eleven", 11)) for d in range(1, n + 3)]
    df = spark.createDataFrame(rows, "key string, as_of_date string, v double").withColumns({"as_of_date": F.col("as_of_date").cast("date"), "v": F.col("v").cast("decimal(18,2)")})
    judged = variance.judge(variance.points(variance.rollup(df, "v", ["key"]), ["key"]), [variance.Threshold("s", "stddev_30d", 3.0)])
    last = {r["key"]: (r["observations"], r["verdict"]) for r in judged.orderBy("as_of_date").collect()}
    assert last["nine"] == (9, "insufficient") and last["ten"][0] == 10 and last["ten"][1] != "insufficient" and last["eleven"][0] == 11


def test_flat_series_has_no_threshold(spark):
    df = spark.sql("select 'k' as key, date_add(date'2024-01-01', cast(id as int)) as as_of_date, cast(5 as decimal(18,2)) as v from range(20)")
    judged = variance.judge(variance.points(variance.rollup(df, "v", ["key"]), ["key"]), [variance.Threshold("s", "stddev_30d", 3.0)])
    assert {r[0] for r in judged.select("verdict").distinct().collect()} == {"insufficient"}


def test_appeared_and_disappeared(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-02"), ("b", "2024-01-03")], "key string, d string").select("key", F.col("d").cast("date").alias("as_of_date"), F.lit(1).cast("decimal(18,2)").alias("value"))
    assert {(r["key"], str(r["as_of_date"]), r["event"]) for r in variance.appeared(df, ["key"]).collect()} == {("a", "2024-01-02", "disappeared"), ("b", "2024-01-02", "appeared")}


def test_silenced_and_kept_are_what_was_before(spark):
    before = spark.createDataFrame([("t", "k", "2024-01-01", 5.0), ("t", "j", "2024-01-01", 7.0)], "threshold_id string, key string, as_of_date string, delta double")
    after = before.where("key = 'k'")
    got = impact.impact_breaches(before, after, ["key"]).collect()
    assert [(r["change"], r["breaches"], r["largest_move"]) for r in got] == [("silenced", 1, 7.0)]


def test_partition_overwrite_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string")
    sinks.write_partitions(rows, path, ["day"])
    sinks.write_partitions(spark.createDataFrame([(9, "b")], "v int, day string"), path, ["day"])
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "day").collect()} == {(1, "a"), (9, "b")}
    with pytest.raises(ValueError):
        sinks.write_partitions(rows, path, ["nothing"])


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert history.closure(edges).count() == 9


def test_closure_has_no_bound_of_steps(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)], "source string, target string")
    got = history.closure(edges)
    assert got.count() == 24 * 25 // 2 and got.agg(F.max("depth")).first()[0] == 24
    assert history.closure(edges, max_depth=3).agg(F.max("depth")).first()[0] == 3


def test_arrivals_are_written_by_many_tasks_in_two_halves(spark, sf_dir, monkeypatch):
    from tidemark.plans import quality_history as P

    plain = P.activity
    monkeypatch.setattr(P, "activity", lambda s, d: plain(s, d).repartition(3))
    path, schema, files = P._stream_source(spark, sf_dir)
    assert files == 3 and len(spark.read.schema(schema).parquet(path).inputFiles()) == 6


def test_null_and_blank_keys_agree(spark):
    a = spark.createDataFrame([(None, 1.0)], "k string, m double")
    b = spark.createDataFrame([("", 1.0)], "k string, m double")
    assert quality.reconcile(a, b, ["k"], {"m": quality.EXACT}).count() == 0
    assert quality.reconcile_missing(a, b, ["k"]).count() == 0


def test_null_keys_keep_their_partner(spark):
    """A group with a null key has its sum on every day, and is no finding when a table is compared with itself."""
    from tidemark.operators import impact, measures, query

    rows = spark.createDataFrame([("a", "2024-01-01", 5.0), (None, "2024-01-01", 7.0), ("a", "2024-01-02", 1.0)], "k string, d string, v double").select("k", F.to_date("d").alias("as_of_date"), "v")
    made = measures.series(rows, [measures.Measure("total", "sum", "v")], ["k"])
    assert {(r["k"], r["as_of_date"].day): r["total"] for r in made.collect()} == {("a", 1): 5, ("a", 2): 1, (None, 1): 7, (None, 2): 0}
    breaches = rows.select(F.lit("t").alias("threshold_id"), "k", "as_of_date", F.col("v").alias("delta"))
    assert impact.impact_breaches(breaches, breaches, ["k"]).collect() == []
    rates = rows.select("k", F.col("v").alias("rate"), F.lit("c").alias("citation")).where("rate > 2")
    assert impact.impact_rates(rates, rates, ["k"]).collect() == []
    one = rows.groupBy("k").agg(F.sum("v").alias("value"))
    assert {r["k"]: r["other"] for r in query.compare(one, one, ["k"]).collect()} == {"a": 6.0, None: 7.0}


def test_overlapping_versions_are_refused(spark):
    from tidemark.operators import rules

    versions = lambda last: spark.createDataFrame([(1, "2024-01-01", last), (2, "2024-03-01", None)], "version int, f string, t string").select("version", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"))
    rows = spark.createDataFrame([("2024-03-02",)], "d string").select(F.to_date("d").alias("d"))
    assert rules.join_in_force(rows, versions("2024-03-01"), "d").first()["version"] == 2
    for last in ("2024-03-02", None):
        with pytest.raises(ValueError):
            rules.join_in_force(rows, versions(last), "d")


def test_a_long_chain_of_dependents(spark):
    n = 1000
    edges = spark.range(n).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    got = history.closure(edges)
    assert got.count() == n * (n + 1) // 2
    assert got.where("depth <> cast(target as int) - cast(source as int)").isEmpty()


def test_columns_that_rules_branch_on():
    from tidemark.operators.rules import Rule, rule_columns

    rules = [Rule("a", "x = 'y' and z > 1", "1"), Rule("b", "y is null or x in ('z', 'it''s w')", "2"), Rule("c", "w", "3")]
    assert rule_columns(rules, ["w", "x", "y", "z"]) == ["x", "z", "y", "w"]
    assert rule_columns(rules, ["w", "x", "y", "z"], 2) == ["x", "z"]


def test_entries_that_are_no_numbers(spark):
    from tidemark.operators.rules import unreadable_rates

    rates = spark.createDataFrame([("a", "0.5"), ("b", "half"), ("c", None)], "k string, rate string")
    assert sorted(r["k"] for r in unreadable_rates(rates, "rate").collect()) == ["b", "c"]
