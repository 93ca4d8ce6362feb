"""Operators that carry state, skip what is equal or unread, or spread out what one task would hold."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.operators import effective, history, lineage, monitor_state, nearest, query, ranks, reconcile, rules, variance
from tidemark.operators.measures import Measure
from tidemark.sources import adapters, filed, sinks
from tidemark.streaming import restate

D = datetime.date


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.selectExpr(*columns) if columns else df).collect()), key=str)


# --- effective dates ---------------------------------------------------------------------------------------------


def _versions(spark, rows, keyed=True):
    df = spark.createDataFrame(rows, "k string, version int, effective_from date, effective_to date, k2 string")
    return df.drop("k2") if keyed else df.drop("k", "k2")


def _plain_in_force(rows, versions):
    out = []
    for k, day in rows:
        hit = [v for vk, v, a, b, _ in versions if k is not None and day and vk == k and a and a <= day and (b is None or day < b)]
        out.append((k, day, hit[0] if hit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [0, 1 << 24])
def test_in_force_like_a_plain_search(spark, small):
    """Edges of half-open ranges, gaps, open ends, empty ranges, null days, keys and starts; merged and sent to every task."""
    r = random.Random(1)
    versions, number = [], 0
    for k in ("a", "b", "c"):
        at = D(2020, 1, 1) + datetime.timedelta(days=r.randint(0, 40))
        for _ in range(30):
            end = at + datetime.timedelta(days=r.randint(1, 25))
            number += 1
            versions.append((k, number, at, end, "z"))
            at = end + datetime.timedelta(days=r.choice([0, 0, 3]))
        versions.append((k, number + 1000, at, None if k != "c" else at + datetime.timedelta(days=1), "z"))
    versions += [("d", 5000, None, None, "z"), ("e", 5001, D(2020, 5, 1), D(2020, 5, 1), "z"), (None, 5002, D(2020, 1, 1), None, "z")]
    days = [D(2019, 12, 1) + datetime.timedelta(days=i) for i in range(0, 1200, 5)] + [v[2] for v in versions if v[2]] + [v[3] for v in versions if v[3]]
    rows = [(k, day) for k in ("a", "b", "c", "d", "e", "f", None) for day in [*days, None]]
    rows += [("a", D(2020, 6, 1))] * 500
    df = spark.createDataFrame(rows, "k string, day date").repartition(6)
    got = effective.join_in_force(df, _versions(spark, versions), "day", ["k"], small_bytes=small)
    assert rows_of(got, "k", "day", "version") == _plain_in_force(rows, versions)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ("Window" in plan) == (small == 0)


@pytest.mark.parametrize("small", [0, 1 << 24])
def test_in_force_without_keys(spark, small):
    versions = [("x", i, D(2021, 1, 1) + datetime.timedelta(days=10 * i), D(2021, 1, 1) + datetime.timedelta(days=10 * i + 8), "z") for i in range(200)]
    rows = [("x", D(2020, 12, 1) + datetime.timedelta(days=i)) for i in range(2300)]
    df = spark.createDataFrame(rows, "k string, day date")
    got = effective.join_in_force(df, _versions(spark, versions, keyed=False), "day", small_bytes=small)
    assert rows_of(got, "k", "day", "version") == _plain_in_force(rows, versions)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_versions_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1))], "k string, day date")
    none = _versions(spark, [("a", 1, D(2020, 1, 1), None, "z")]).where("false")
    assert rows_of(effective.join_in_force(df, none, "day", ["k"]), "k", "version") == [("a", None)]
    with pytest.raises(ValueError, match="both sides"):
        effective.join_in_force(df, none.withColumn("day", F.current_date()), "day", ["k"])


def test_stretches_like_counting_days(spark):
    r = random.Random(2)
    versions = []
    for k in "abc":
        for i in range(12):
            at = D(2020, 1, 1) + datetime.timedelta(days=r.randint(-50, 400))
            versions.append((k, i, at, r.choice([None, at, at + datetime.timedelta(days=r.randint(1, 60))]) if i else at + datetime.timedelta(days=30), "z"))
    days = [D(2020, 1, 1) + datetime.timedelta(days=i) for i in range(366)]
    live = lambda v, day: v[2] <= day and (v[3] is None or day < v[3])
    for keyed in (True, False):
        want = []
        for k in "abc" if keyed else "*":
            own = [v for v in versions if not keyed or v[0] == k]
            for day in days:
                n = sum(live(v, day) for v in own)
                if n != 1 and (not keyed or any(live(v, d) for v in own for d in days)):
                    want.append((*([k] if keyed else []), day, n, "overlap" if n else "gap"))
        keys = ["k"] if keyed else []
        got = effective.effective_problems(_versions(spark, versions, keyed), "2020-01-01", "2020-12-31", keys)
        assert rows_of(got, *keys, "day", "versions", "problem") == sorted(want, key=str)
    stretches = effective.effective_stretches(_versions(spark, versions), "2020-01-01", "2020-12-31", ["k"]).collect()
    for s in stretches:  # none goes on in another
        assert not any(s["k"] == o["k"] and s["to_day"] == o["from_day"] and s["versions"] == o["versions"] for o in stretches)


# --- carried state -----------------------------------------------------------------------------------------------


def _series(spark, days):
    """A key on all days, one with gaps, one that comes late, one that goes, a flat one, and one of null."""
    r, rows = random.Random(3), []
    for i in range(days):
        day = D(2024, 1, 1) + datetime.timedelta(days=i)
        rows += [("all", day, r.randint(-9000, 9000) / 100), ("flat", day, 5.0), (None, day, r.randint(0, 900) / 100)]
        rows += [("gaps", day, r.randint(0, 9000) / 100)] * (r.random() < 0.6) + [("late", day, 1.0 * i)] * (i > 20) + [("gone", day, 2.0 * i)] * (i < 15)
    return spark.createDataFrame(rows, "key string, as_of_date date, v double").select("key", "as_of_date", F.col("v").cast("decimal(38,2)").alias("value"))


SHOWN = ["key", "as_of_date", "value", "prior", "prior_date", "delta", "round(pct, 8)", "round(sigma_30, 8)", "n_30", "round(sigma_60, 8)", "n_60"]


def test_ninety_daily_runs_give_one_full_run(spark, tmp_path):
    """A run sees its own day and the state alone; the points and verdicts are those of all days at once."""
    n = 90
    series = _series(spark, n).cache()
    states, points = str(tmp_path / "states"), str(tmp_path / "points")
    for i in range(n):
        day = D(2024, 1, 1) + datetime.timedelta(days=i)
        monitor_state.run_period(series.where(F.col("as_of_date") == F.lit(day)), day, day, states, points, ["key"])
    filed_points = spark.read.parquet(points)
    whole = variance.points(series, ["key"])
    assert rows_of(filed_points, *SHOWN) == rows_of(whole, *SHOWN)
    thresholds = [variance.Threshold("s", "stddev_30d", 1.5), variance.Threshold("p", "static_pct", 40.0)]
    judged = lambda df: rows_of(variance.judge(df, thresholds), "key", "as_of_date", "threshold_id", "verdict")
    assert judged(filed_points) == judged(whole)
    assert len(filed.folders(spark, states)) == n
    state = spark.read.parquet(monitor_state.last_state(spark, states))
    assert state.agg(F.max(F.size("changes"))).first()[0] == 60 and state.count() == 6


def test_a_period_that_runs_again_replaces_its_own(spark, tmp_path):
    series = _series(spark, 30)
    states, points = str(tmp_path / "states"), str(tmp_path / "points")
    cuts = [0, 7, 8, 21, 30]
    period = lambda i, df: monitor_state.run_period(
        df.where(F.col("as_of_date").between(*[D(2024, 1, 1) + datetime.timedelta(days=x) for x in (cuts[i], cuts[i + 1] - 1)])),
        *[D(2024, 1, 1) + datetime.timedelta(days=x) for x in (cuts[i], cuts[i + 1] - 1)], states, points, ["key"],
    )
    for i in range(4):
        period(i, series)
    mended = series.withColumn("value", F.when(F.col("as_of_date") == F.lit("2024-01-08").cast("date"), F.col("value") + 1).otherwise(F.col("value")))
    period(1, mended)
    stale = monitor_state.stale_states(spark, states, D(2024, 1, 8))
    assert stale == [D(2024, 1, 21), D(2024, 1, 30)]
    for i in (2, 3):
        period(i, mended)
    assert rows_of(spark.read.parquet(points), *SHOWN) == rows_of(variance.points(mended, ["key"]), *SHOWN)


def _arrivals(spark, rows):
    return spark.createDataFrame([(k, D.fromisoformat(d) if d else None, v) for k, d, v in rows], "k string, day date, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))


def test_late_rows_add_to_totals(spark, tmp_path):
    """Null days and keys are filed too, a batch that runs again counts once, and totals of other days are not even read."""
    totals, table = str(tmp_path / "totals"), str(tmp_path / "table")
    batches = [
        [("a", "2024-01-01", 1.5), ("b", "2024-01-01", 2.0), ("a", None, 7.0), (None, "2024-01-02", 3.0)],
        [("a", "2024-01-02", 4.0), ("a", "2024-01-01", 0.25)],
        [("c", "2024-01-01", 1.0), ("a", None, 1.0)],
        [("b", "2024-01-01", 1.0)],
    ]
    add = lambda i: restate.add_batch(_arrivals(spark, batches[i]), i, totals, table, ["k"], ["v"], "day")
    done = []
    for i, batch in enumerate(batches):
        if i == 3:  # a day that this batch does not touch
            for f in (tmp_path / "totals" / "day=2024-01-02").rglob("*.parquet"):
                f.write_bytes(b"broken")
        for _ in range(2 if i in (1, 2, 3) else 1):
            add(i)
        done += batch
        want = {}
        for k, d, v in done:
            s, n = want.get((k, d), (0, 0))
            want[k, d] = s + v, n + 1
        got = {(r["k"], r["day"] and r["day"].isoformat()): (float(r["v"]), r["records"]) for r in spark.read.parquet(table).collect()}
        assert got == want
    for day in filed.folders(spark, totals):
        assert len(filed.folders(spark, f"{totals}/{day}")) <= 2


def test_a_filed_table_reads_two_days(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [D(2024, 1, 1) + datetime.timedelta(days=i) for i in range(0, 40, 2)]
    df = spark.createDataFrame([(k, float(i + j), d) for i, d in enumerate(days) for j, k in enumerate("ab")], "k string, value double, as_of_date date")
    sinks.write_partitions(df, path, ["as_of_date"])
    table = filed.FiledTable(spark, path, df.schema)
    assert table.days() == days
    m = Measure("total", "sum", "value")
    for as_of in ("2024-01-31", "2024-02-05", "2031-01-01", "2024-01-01", None):
        for basis in ("prior_day", "prior_week", "month_end"):
            view = query._two_days(table, as_of, basis)
            assert len(view.inputFiles()) <= 4 and all("as_of_date=" in f for f in view.inputFiles())
            assert {f.split("as_of_date=")[1].split("/")[0] for f in view.inputFiles()} <= {d.isoformat() for d in query.days_for(days, as_of, basis) if d}
            assert rows_of(query.query_scalar(table, m, as_of=as_of, basis=basis)) == rows_of(query.query_scalar(df, m, as_of=as_of, basis=basis))
            assert rows_of(query.query_groups(table, m, ["k"], as_of=as_of, basis=basis)) == rows_of(query.query_groups(df, m, ["k"], as_of=as_of, basis=basis))
    new = df.limit(1).withColumn("as_of_date", F.lit("2024-03-01").cast("date"))
    sinks.write_partitions(new, path, ["as_of_date"])  # a day that is filed is known at once
    assert table.days()[-1] == D(2024, 3, 1)
    assert filed.filed_days(spark, str(tmp_path / "nothing")) == []


def test_loads_at_one_time_are_told_apart(spark):
    log = spark.createDataFrame([("k", 1, "2024-01-01", "a"), ("k", 2, "2024-01-01", "b"), ("j", 5, "2024-01-02", "c")], "k string, v int, t string, load_id string")
    log = log.select("k", "v", F.col("t").cast("timestamp").alias("loaded_at"), "load_id")
    at = lambda **x: rows_of(adapters.read_snapshot(log, ["k"], **x), "k", "v")
    assert at(load_id="a") == [("k", 1)] and at(load_id="b") == [("k", 2)] and at(at="2024-01-01") == [("k", 2)] and at(load_id="c") == [("j", 5), ("k", 2)]
    with pytest.raises(ValueError, match="no load"):
        at(load_id="x")


# --- reconciliation ----------------------------------------------------------------------------------------------


def _sides(spark):
    r, rows = random.Random(4), []
    for i in range(400):
        rows.append((f"k{i % 57}", i, D(2024, 1, 1) + datetime.timedelta(days=i % 20), r.choice([None, float("nan"), 0.0, 1.5, r.random() * 100]), r.randint(0, 9)))
    schema = "k string, i int, day date, m double, n int"
    a = spark.createDataFrame(rows + [(None, 900, None, 1.0, 1), ("", 901, None, None, 2)], schema)
    changed = [(k, i, d, (m + 0.0005 if i % 40 == 3 else m + 5 if i % 40 == 7 else None if i % 40 == 11 else m) if m is not None else (2.0 if i % 40 == 15 else None), n) for k, i, d, m, n in rows if i % 40 != 19]
    b = spark.createDataFrame(changed + [("", 900, None, 1.0, 1), (None, 901, None, None, 3), ("new", 7000, D(2024, 1, 3), 1.0, 1)], schema)
    return a, b


def test_findings_like_a_plain_comparison(spark):
    a, b = _sides(spark)
    tolerances = {"m": reconcile.CURRENCY, "n": reconcile.EXACT}
    plain = lambda df: {(r["k"] or "", str(r["i"]), str(r["day"] or "")): (r["m"], float(r["n"])) for r in df.collect()}
    x, y = plain(a), plain(b)
    want = [(*k, "expected", "*", None, None) for k in x.keys() - y.keys()] + [(*k, "actual", "*", None, None) for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        for name, e, f, allowed in zip(("m", "n"), x[k], y[k], (0.001, 0.0), strict=True):
            if (e is None) != (f is None) or (e is not None and not abs(e - f) <= allowed):
                want.append((*k, "differs", name, e, f))
    for day in (None, "day"):
        got = rows_of(reconcile.findings(a, b, ["k", "i", "day"], tolerances, day))
        # nan is not within any tolerance of nan, but a stretch whose rows are all equal is not looked at
        tidy = lambda rows: sorted((r for r in rows if not (r[3] == "differs" and r[5] != r[5] and r[6] != r[6])), key=str)
        assert [*map(str, tidy(got))] == [*map(str, tidy(want))]


def test_equal_stretches_do_not_meet(spark):
    a, b = _sides(spark)
    keys, measures = ["k", "i", "day"], ["m", "n"]
    e, f = (reconcile._keyed(df, keys, measures, "day", 64) for df in (a, b))
    assert reconcile.stretches_that_differ(e, e.repartition(7), keys, measures).count() == 0
    differ = {(r["_day"], r["_range"]) for r in reconcile.stretches_that_differ(e, f, keys, measures).collect()}
    assert 0 < len(differ) < e.select("_day", "_range").distinct().count() / 2
    same = a.where("day = date'2024-01-02'")
    assert reconcile.findings(same, same, keys, dict.fromkeys(measures, reconcile.EXACT), "day").collect() == []


# --- order statistics --------------------------------------------------------------------------------------------


def test_ranks_of_ties_and_one_huge_value(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 2, 3]), r.choice([0.0, 5.0, 5.0, 1e308, r.random()]), f"id{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "severity_rank int, size double, id string").repartition(7)
    got = ranks.ranked(df, [F.col("severity_rank").asc(), F.col("size").desc(), F.col("id").asc()])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = {x[2]: i for i, x in enumerate(sorted(rows, key=lambda x: (x[0], -x[1], x[2])), 1)}
    assert {x["id"]: x["rank"] for x in got.collect()} == want
    assert ranks.ranked(df.where("false"), [F.col("id")]).collect() == []


def test_median_by_refining_bins(spark):
    r = random.Random(6)
    inf = float("inf")
    lists = [[1.0], [1.0, 2.0], [5.0] * 999 + [1.0], [r.gauss(0, 1) for _ in range(2001)], [r.gauss(0, 1e300) for _ in range(1000)], [-inf, inf, 0.0, 1.0], [-1.7e308, 1.7e308, 3.0],
             [5e-324, 0.0, -5e-324, 1e-323], [1.0 + k * 2.0**-52 for k in range(50)] * 3, [10.0**k for k in range(-300, 300)]]
    for values in lists:
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        s = sorted(values)
        places = sorted({0, len(s) // 3, len(s) // 2, len(s) - 1})
        assert ranks.values_at(df, places, few=5) == [s[p] for p in places]
        if all(abs(v) < 1e307 for v in values):
            assert ranks.median(df) == pytest.approx(statistics.median(values), rel=1e-15)
    assert ranks.median(spark.createDataFrame([], "x double")) is None
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert ranks.values_at(df, [1]) == [2.0]
    with pytest.raises(IndexError):
        ranks.values_at(df, [3])


def test_upper_middle_of_a_hot_group(spark):
    r = random.Random(7)
    rows = [("hot", r.choice([1.0, 2.0, 2.0, 9.0, None])) for _ in range(4000)] + [("one", 4.0), ("two", 1.0), ("two", 3.0), ("none", None), (None, 6.0)]
    got = dict(rows_of(history.upper_middle(spark.createDataFrame(rows, "b string, w double"), "b", "w")))
    hot = sorted(w for b, w in rows if b == "hot" and w is not None)
    assert got == {"hot": hot[len(hot) // 2], "one": 4.0, "two": 3.0, None: 6.0}


def test_versions_of_keys_with_few_rows_are_merged_once(spark, monkeypatch):
    """only a key of many rows is dealt out over stretches of time; the rows are the same either way."""
    dealt, pieces = [], effective._pieces

    def noted(versions, *more):
        dealt.append(pieces(versions, *more))
        return dealt[-1]

    monkeypatch.setattr(effective, "_pieces", noted)
    monkeypatch.setattr(effective, "HOT_ROWS", 50)
    versions = spark.range(40).selectExpr("id % 20 as k", "date_add(date'2024-01-01', cast(300 * (id div 20) as int)) as effective_from", "if(id < 20, date'2024-10-01', null) as effective_to", "id as v")
    rows = spark.range(400).selectExpr("if(id < 100, 0, if(id % 40 = 7, null, id % 20)) as k", "date_add(date'2023-12-01', cast(id * 2 as int)) as day", "id")
    got = sorted(rows_of(effective.join_in_force(rows, versions, "day", ["k"], small_bytes=0), "id", "v"))
    assert {r[0] for r in dealt[0].select("_k_k").distinct().collect()} == {0}
    day = lambda n: datetime.date(2023, 12, 1) + datetime.timedelta(2 * n)
    key = lambda n: 0 if n < 100 else None if n % 40 == 7 else n % 20
    second = datetime.date(2024, 1, 1) + datetime.timedelta(300)
    at = lambda n: None if key(n) is None else key(n) + 20 if day(n) >= second else key(n) if datetime.date(2024, 1, 1) <= day(n) < datetime.date(2024, 10, 1) else None
    assert got == [(n, at(n)) for n in range(400)]


# --- graphs, rules, codes ----------------------------------------------------------------------------------------


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def test_levels_of_a_graph_with_merges_and_cycles(spark):
    r = random.Random(8)
    pairs = [(f"n{r.randrange(i)}", f"n{i}") for i in range(1, 60) for _ in range(r.choice([1, 1, 2]))]
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "after"), ("after", "later"), ("n3", "later"), ("self", "self"), ("p", "q"), ("q", "p"), ("n5", "c1"), ("p", None)]
    reads = {}
    for a, b in pairs:
        if b:
            reads.setdefault(b, set()).add(a)
            reads.setdefault(a, set())
    reads["alone"] = set()
    cyclic = {"c1", "c2", "c3", "self", "p", "q"}
    want = dict.fromkeys(cyclic, (None, lineage.ON_CYCLE)) | dict.fromkeys(("after", "later"), (None, lineage.BEHIND_CYCLE))

    def level(x):
        return max((level(y) + 1 for y in reads[x]), default=0)

    want |= {x: (level(x), None) for x in reads if x not in want}
    docs = spark.createDataFrame([("alone",), ("n1",)], "name string")
    got = {x["name"]: (x["level"], x["problem"]) for x in lineage.levels(_edges(spark, pairs), docs).collect()}
    assert got == want


def test_levels_of_a_deep_chain(spark):
    edges = spark.range(1000).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    got = lineage.levels(edges)
    assert got.count() == 1001 and got.where("level <> cast(name as long) or problem is not null").isEmpty()
    assert lineage.levels(edges.where("false")).collect() == []


def test_levels_send_no_table_to_the_driver(spark, monkeypatch):
    """a join that comes with each round is never a broadcast, which goes through the driver."""
    plans, kept = [], lineage.stored

    def noted(df, name, by=()):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name, by)

    monkeypatch.setattr(lineage, "stored", noted)
    pairs = [(f"n{k}", f"n{3 * k + 1}") for k in range(40)] + [(f"n{k}", f"n{2 * k + 1}") for k in range(0, 40, 2)] + [("n9", "n5")]
    plans.append(lineage.levels(_edges(spark, pairs))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_stages(spark):
    docs = spark.createDataFrame([("v1", "metrics_view"), ("v2", "metrics_view"), ("r", "report"), ("m", "variance_monitor"), ("b", "source_binding"), ("x", None)], "name string, kind string")
    edges = _edges(spark, [("v1", "r"), ("v1", "r"), ("v2", "m"), ("r", "m"), ("b", "v1"), ("gone", "r")])
    got = dict(rows_of(lineage.stages(docs, edges), "name", "stage"))
    assert got == {"v1": "prepare", "v2": "publish", "r": "file", "m": "watch", "b": "prepare", "x": "publish"}


def test_atoms_of_a_condition():
    split = rules.atoms_of
    assert split("a = 1 and b is not null AND not c") == ["a = 1", "b is not null", "not c"]
    assert split("a = 'x and y' and (b or c and d)") == ["a = 'x and y'", "(b or c and d)"]
    assert split("a between 1 and 2 and b") == ["a between 1 and 2 and b"]
    assert split("a or b and c") == ["a or b and c"]
    assert split("case when a and b then c end and d") == ["case when a and b then c end and d"]
    assert split("a = 'or' and `band and` = 2") == ["a = 'or'", "`band and` = 2"]
    assert split("a = 'it''s' and f(x, 'and') and band") == ["a = 'it''s'", "f(x, 'and')", "band"]


def test_a_thousand_rules_by_bitmap(spark):
    """Null conditions do not match; overlaps are those of matching every rule on every row."""
    r = random.Random(9)
    many = [rules.Rule(f"r{i}", f"a {r.choice(['<', '>='])} {r.randrange(20)} and b = '{r.choice('xyz')}'" + (" and c is not null" if i % 3 else ""), "e") for i in range(1000)]
    rows = [(r.choice([None, *range(20)]), r.choice(["x", "y", "z", None]), r.choice([None, 1])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    want = {}
    for a, b, c in rows:
        hits = []
        for rule in many:
            parts = rule.when.split()
            ok = a is not None and (a < int(parts[2]) if parts[1] == "<" else a >= int(parts[2])) and parts[6].strip("'") == b
            if ok and ("not null" not in rule.when or c is not None):
                hits.append(rule.id)
        for other in hits[1:]:
            want[hits[0], other] = want.get((hits[0], other), 0) + 1
    got = {(x["winner"], x["other"]): x["records"] for x in rules.rule_overlaps(df, many).collect()}
    assert got == want


def test_nearest_codes_like_all_pairs(spark):
    r = random.Random(10)
    known = ["".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(120)]
    unknown = ["".join(r.choice("abcde") for _ in range(r.randint(0, 14))) for _ in range(150)] + known[:10] + ["zzzzzzzzzzzzzzzzzzzzzzzz", "é漢字"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {u: min((distance(u, k), k) for k in known) for u in unknown}
    df = lambda values, name: spark.createDataFrame([(v,) for v in [*values, None]], f"{name} string")
    got = nearest.nearest_codes(df(unknown, "unknown"), df(known, "code"))
    assert {x["unknown"]: (x["distance"], x["code"]) for x in got.collect()} == want
    assert nearest.nearest_codes(df(unknown, "unknown"), df([], "code")).collect() == []


def test_far_codes_meet_in_blocks(spark, monkeypatch):
    """codes with nothing within two edits, in several blocks on both sides, one of them longer than a machine word has bits; the work is dealt out and beginnings in common are compared once."""
    r = random.Random(11)
    known = [f"Brand#{r.randint(1, 25)}-{t}-{r.randint(1, 50)}" for t in ("LARGE", "ECONOMY", "SMALL") for _ in range(40)] + ["", "q" * 90, "\U0001f600x"]
    unknown = [k[::-1] for k in known] + ["w" * 70 + "q" * 30, "nothing like it", "\U0001f600\U0001f601\U0001f602yy"]
    steps = list(nearest._beginnings(sorted(set(known))))
    assert len(steps) < sum(map(len, set(known))) / 2 and len({at for *_, at in steps if at >= 0}) == len(set(known)) - 1

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {u: min((distance(u, k), k) for k in known) for u in unknown}
    monkeypatch.setattr(nearest, "KNOWN", 50)
    monkeypatch.setattr(nearest, "FAR", 40)
    df = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    assert {x["unknown"]: (x["distance"], x["code"]) for x in nearest.nearest_codes(df(unknown, "unknown"), df(known, "code")).collect()} == want


def test_contract_of_a_measure(spark):
    of = lambda text: spark.range(1).select(exprs.denominator_of(F.lit(text))).first()[0]
    assert [of(t) for t in ("a / b", "a /  NULLIF ( c_1 , 0)", "100*a/b/c", "a / 2 / d", "a - b", "a / (b + c)", "x/\t_y2 + 1", "a / 3")] == ["b", "c_1", "b", "d", None, None, "_y2", None]
    row = spark.range(1).select(*[f(F.lit(t)) for t in ("percent_3dp", "currency_usd_mm", "bps", "percent_xdp") for f in (exprs.unit_of, exprs.precision_of)]).first()
    assert tuple(row) == ("percent", 3, "USD", 0, "number", 0, "number", 0)
