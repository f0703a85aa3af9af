"""Drift halves, toggles, attachments, rankings and roll-ups on small frames."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from uwspark.ml import heads
from uwspark.operators import features, gst, monitor, rules, warehouse


def test_halves_split_at_the_middle(spark):
    rows = [(i, 100 - i, float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "day int, id int, x double").repartition(6)
    out = {r.day: r.half for r in monitor.halves(df, ["day"], ["day", "id"]).collect()}
    assert [out[i] for i in (0, 49, 50, 51, 100)] == ["reference", "reference", None, "recent", "recent"]


def test_drift_by_halves(spark):
    rnd = random.Random(2)
    rows = [(i // 7, i, rnd.gauss(0 if i < 200 else 3, 1), rnd.gauss(5, 1), 600.0 + (i >= 200) * 80 + rnd.random(), None) for i in range(400)]
    df = spark.createDataFrame(rows, "day int, id int, a double, b double, score double, none double")
    out = {r.metric: r for r in monitor.drift_by_halves(df, ["a", "b", "none"], "score", ["day"], ["day", "id"]).collect()}
    assert out["a"].band == out["a"].status == out["b"].status == "alert" and out["b"].psi < 0.2
    assert out["score"].kind == "prediction" and out["score"].band == "alert"
    assert (out["none"].psi, out["none"].reference_mean, out["a"].reference_n, out["a"].recent_n) == (0.0, None, 200, 200)
    calm = monitor.drift_by_halves(df.select("day", "id", "b", "score"), ["b"], "score", ["day"], ["day", "id"])
    assert {r.status for r in calm.collect()} <= {"stable", "warn"}  # the score does not decide the status
    short = monitor.drift_by_halves(df.limit(39), ["a"], "score", ["day"], ["day", "id"]).collect()
    assert [(r.status, r.metric) for r in short] == [("insufficient-data", None)]
    assert monitor.drift_by_halves(df.limit(0), ["a"], "score", ["day"], ["day", "id"]).first().status == "insufficient-data"


def test_most_specific_setting_wins(spark):
    listed = spark.createDataFrame([(p, s, r) for p in "PQ" for s in "AB" for r in ("r1", "r2")], "product string, source string, rule_id string")
    settings = [
        (None, None, "r1", False, 9), (None, "A", "r1", True, 1), ("P", None, "r1", False, 1), ("P", "A", "r1", True, 0),
        ("P", "A", "r1", False, 5), (None, None, "r9", False, 1), ("Q", "B", "r1", True, 2), ("Q", "B", "r1", False, 1),
    ]
    t = spark.createDataFrame(settings, "product string, source string, rule_id string, enabled boolean, seq long")
    got = {(r.product, r.source, r.rule_id): r.enabled for r in rules.resolved_toggles(listed, t).collect()}
    assert got == {
        ("P", "A", "r1"): False, ("P", "B", "r1"): False, ("Q", "A", "r1"): True, ("Q", "B", "r1"): True,
        ("P", "A", "r2"): True, ("P", "B", "r2"): True, ("Q", "A", "r2"): True, ("Q", "B", "r2"): True,
    }
    off = rules.resolved_toggles(listed, t.limit(0), default=False)
    assert {r.enabled for r in off.collect()} == {False} and off.count() == 8


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_attached_evaluations(spark):
    rnd = random.Random(4)
    statements = [(i, rnd.randrange(4), day(rnd.randrange(200))) for i in range(30)]
    runs = [(i, rnd.choice([None, *range(30)]), rnd.choice(["UPLOADED_STATEMENT", "SIMULATED"]), day(rnd.randrange(30, 200))) for i in range(60)]
    evaluations = [(i, rnd.choice([None, 0, 0, 0, 1, 2, 7]), day(rnd.randrange(220)), f"d{i}") for i in range(80)]
    want = {}
    for i, source, at, _ in evaluations:
        own = [s for s, of, t in statements if of == source and t <= at and source is not None]
        found = max((r for r, s, _, t in runs if own and s == max(own) and t <= at), default=None)
        if found is None:
            found = max((r for r, _, kind, t in runs if kind == "UPLOADED_STATEMENT" and t <= at), default=None)
        if found is not None:
            want[found] = i
    got = warehouse.attached_evaluations(
        spark.createDataFrame(evaluations, "id long, source_id long, at date, decision string"),
        spark.createDataFrame(statements, "id long, source_id long, at date"),
        spark.createDataFrame(runs, "id long, statement_id long, data_source string, at date"),
    ).collect()
    assert {r.run_id: (r.id, r.decision) for r in got} == {k: (v, f"d{v}") for k, v in want.items()} and len(got) == len(want)


def test_recent_activity_names(spark):
    runs = spark.createDataFrame(
        [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4), (5, 9, 5), (6, 9, None)], "id long, applicant_id long, statement_id long"
    ).withColumns({"created_at": F.lit(day(0)), "transaction_count": F.lit(1), "credit_score": F.lit(700), "risk_grade": F.lit("LOW")})
    people = spark.createDataFrame([(1, "REF", "Ann", "B1"), (2, "", "Bob", ""), (3, None, None, None), (4, None, "", "B4")], "id long, ref_id string, name string, bank_name string")
    files = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3"), (4, None), (5, None)], "id long, file_name string")
    got = {r.id: (r.label, r.bank) for r in warehouse.recent_activity(runs, people, files, keep=6).collect()}
    assert got == {1: ("REF", "B1"), 2: ("Bob", "f2"), 3: ("f3", "f3"), 4: ("Statement #4", "B4"), 5: ("Statement #5", "-"), 6: ("RUN-6", "-")}
    assert {r.id for r in warehouse.recent_activity(runs, people, files, keep=2).collect()} == {5, 6}


def test_range_ranking(spark):
    rows = [(1.0, 5.0, "x", None), (2.0, 5.0, "y", 1.0), (4.0, 5.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, flat double, kind string, gap double")
    out = {r.feature: r for r in features.range_ranking(df, ["a", "flat", "gap"], {"kind": ["X", "Y"]}).collect()}
    assert out["a"].variance == round(statistics.variance([0, 1 / 3, 1]), 6) and out["flat"].variance == 0.0
    assert out["gap"].variance == out["kind_X"].variance == round(1 / 3, 6) and out["gap"].rank < out["kind_X"].rank
    assert [r.feature for r in sorted(out.values(), key=lambda r: r.rank) if r.selected] == ["gap", "kind_X", "kind_Y"]


def test_head_summary_ties(spark):
    rows = [("h", None, "B"), ("h", None, "A"), ("h", None, "B"), ("h", None, "A"), ("h", None, "C"), ("v", 1.0, None), ("v", 2.0, None), ("v", None, None)]
    out = {r.head: r for r in heads.head_summary(spark.createDataFrame(rows, "head string, value double, label string")).collect()}
    assert (out["h"].label, out["h"].distribution, out["h"].value, out["h"].n) == ("A", {"A": 2, "B": 2, "C": 1}, None, 5)
    assert (out["v"].label, out["v"].distribution, out["v"].value, out["v"].n) == (None, {}, 1.5, 3)


def test_source_rollup(spark):
    rows = [(1, 2, 60.0, 1, 1, 0, 3, 2, 0, 1), (1, 1, None, 0, 0, 1, 1, 1, 1, 0), (2, 4, 80.0, 4, 0, 0, 9, 9, 0, None)]
    df = spark.createDataFrame(rows, "source_id int, businesses int, avg_score double, low int, medium int, high int, gstr1 int, gstr3b int, gstr2a int, gstr2b int")
    out = {r.source_id: r.asDict() for r in gst.source_rollup(df).collect()}
    assert out[1] == {"source_id": 1, "statements": 2, "avg_score": 60.0, "businesses": 3, "low": 1, "medium": 1, "high": 1, "gstr1": 4, "gstr3b": 3, "gstr2a": 1, "gstr2b": 1}
    assert out[2]["gstr2b"] == 0
