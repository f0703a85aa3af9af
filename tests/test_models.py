"""Folds, importance, pattern models and the registry on small frames."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from uwspark.ml import evaluation, heads, registry, signatures
from uwspark.ml.heads import Head


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random(), rnd.random(), rnd.random()) for i in range(600)]
    return spark.createDataFrame(
        [(i, a, b, c, "1" if a > 0.9 else "0", 100 * a + 10 * b) for i, a, b, c in rows],
        "account_id long, a double, b double, useless double, risk string, score double",
    ).cache()


def test_folds_of_a_class_differ_by_one_row(spark):
    rows = [(i, "big" if i % 10 else ("small" if i % 20 else None)) for i in range(1003)]
    out = evaluation.stratified_folds(spark.createDataFrame(rows, "k long, label string"), "k", "label", 5)
    assert out.count() == 1003 and out.columns == ["k", "label", "fold"]
    for label in ("big", "small", None):
        sizes = [r["count"] for r in out.where(F.col("label").eqNullSafe(F.lit(label))).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = evaluation.stratified_folds(spark.createDataFrame(rows[::-1], "k long, label string").repartition(7), "k", "label", 5)
    assert sorted(map(tuple, out.select("k", "fold").collect())) == sorted(map(tuple, again.select("k", "fold").collect()))


def test_every_row_is_predicted_once(data):
    head = Head("r", "risk", "classifier", ("a", "b"), classes=("0", "1"))
    pred = evaluation.cross_validated(data, head, "account_id", 3, "logistic_regression").collect()
    assert sorted(r.account_id for r in pred) == list(range(600))
    rows = evaluation.evaluated(data, head, "account_id", 3, "random_forest").collect()
    assert [r.fold for r in sorted(rows)] == [0, 1, 2] and all(r.brier < 0.05 and r.accuracy > 0.95 and r.r2 is None for r in rows)


def test_brier(spark):
    pred = spark.createDataFrame([(0, 1.0, 0.8), (0, 0.0, 0.4), (1, 1.0, 0.1)], "fold int, y double, p double")
    got = {r.fold: r.brier for r in evaluation.brier(pred).collect()}
    assert got[0] == pytest.approx((0.04 + 0.16) / 2) and got[1] == 0.0


def test_permutation_keeps_the_values(data):
    out = evaluation.permuted(data, "account_id", ["a", "b"], 4)
    rows = out.select("a", "b", F.col("_other.a").alias("oa"), F.col("_other.b").alias("ob")).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted((r.oa, r.ob) for r in rows)
    assert sum(r.a == r.oa for r in rows) < 20


def test_useless_feature_has_no_importance(data):
    head = Head("s", "score", "regressor", ("a", "b", "useless"))
    model = heads.fit(data, head, "gradient_boosting")
    got = {r.feature: r for r in evaluation.permutation_importance(model, data, head, "account_id", 2).collect()}
    assert got["a"].importance > 1.0 > 0.005 > got["useless"].importance >= 0.0
    assert sum(r.share for r in got.values()) == pytest.approx(1.0)
    only = Head("s", "score", "regressor", ("useless",))
    flat = evaluation.permutation_importance(heads.fit(data.withColumn("useless", F.lit(1.0)), only, "linear_regression"), data.withColumn("useless", F.lit(1.0)), only, "account_id", 1)
    assert [(r.importance, r.share) for r in flat.collect()] == [(0.0, 0.0)]


def upi_metrics(spark, rows):
    names = ["rapid_pass_through_count", "high_risk_mcc_spend_pct", "structuring_count", "single_counterparty_dominance_pct"]
    names += ["sudden_spike_ratio", "failed_ratio", "round_amount_ratio"]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "account_id long, " + ", ".join(f"{n} double" for n in names))


def test_pattern_models_separate_and_escalate(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.0, 6.0]), rnd.uniform(0, 5), 0.0, 30.0, rnd.choice([1.0, 5.0]), 0.01, None) for _ in range(300)]
    m = upi_metrics(spark, rows)
    train = signatures.training_rows(m, "upi", "account_id").cache()
    models = signatures.fit(train, "upi", "random_forest")
    out = signatures.scored(models, train, "account_id").join(train, "account_id").collect()
    assert all(r.fraud_flag == (r.fraud_label == 1) and r.anomaly_flag == (r.anomaly_label == 1) for r in out)
    paths = signatures.save(models, str(tmp_path), "upi", 1)
    again = signatures.scored(signatures.load("upi", paths), train, "account_id").collect()
    assert {(r.account_id, r.fraud_p) for r in again} == {(r.account_id, r.fraud_p) for r in out}
    # a probability of 0.6 alone makes a clear account match
    clear = m.where("rapid_pass_through_count = 0 and sudden_spike_ratio = 1")
    worst = clear.select("account_id", F.lit(0.5).alias("worst_z"), F.lit("within").alias("worst_band"))
    for p, verdict in ((0.59, "CONSISTENT WITH TRAINING"), (0.6, "MATCHES FRAUD TYPOLOGY")):
        scores = clear.select("account_id", F.lit(p).alias("fraud_p"), F.lit(0.0).alias("anomaly_p"))
        got = signatures.verdicts(clear, worst, scores, "upi", "account_id").select("verdict").distinct().collect()
        assert [r.verdict for r in got] == [verdict]


def test_pattern_model_of_one_label(spark):
    train = signatures.training_rows(upi_metrics(spark, [(0.0, 1.0, 0.0, 10.0, 1.0, 0.0, 0.0)] * 20), "upi", "account_id")
    models = signatures.fit(train, "upi")
    assert all(f.model is None for f in models.values())
    assert {(r.fraud_p, r.anomaly_p) for r in signatures.scored(models, train, "account_id").collect()} == {(0.0, 0.0)}
    nothing = signatures.fit(train.limit(0), "upi")
    assert signatures.scored(nothing, train.limit(0), "account_id").count() == 0


def brute_replay(log):
    active, held, seen, out = None, None, [], []
    for version, quality, golden in log:
        seen.append((version, quality, golden))
        promote = held is None or golden is None or not held - golden > registry.MAX_REGRESSION
        best = max(seen, key=lambda v: v[1])
        if promote or active is None:
            active, held = best[0], best[2]
        out.append((version, promote, active))
    return out


def test_replay(spark):
    rnd = random.Random(7)
    logs = {d: [(v, rnd.choice([0.2, 0.5, 0.5, 0.9]), rnd.choice([0.9, 0.95, 0.99])) for v in range(1, rnd.randrange(2, 9))] for d in range(40)}
    rows = [(d, v, q / 0.5, 0.0, 0.0, g) for d, log in logs.items() for v, q, g in log]
    rnd.shuffle(rows)
    got = registry.replay(spark.createDataFrame(rows, "domain long, version long, accuracy double, f1 double, r2 double, golden double"))
    assert sorted(map(tuple, got.collect())) == sorted((d, *r) for d, log in logs.items() for r in brute_replay(log))


@pytest.fixture(scope="module")
def fitted(data):
    return heads.fit(data, Head("m", "risk", "classifier", ("a", "b"), classes=("0", "1")), "logistic_regression")


def quality(spark, q):
    return spark.createDataFrame([(q, q)], "accuracy double, f1 double")


def test_registry_gate_and_pointer(spark, data, fitted, tmp_path):
    store = registry.Registry(spark, str(tmp_path))
    assert store.versions("upi") is None and store.active("upi") is None and store.reevaluate("upi", data, [], "account_id") is None
    save = lambda q, g: store.save("upi", {"m": fitted}, quality(spark, q), algorithm="logistic_regression", samples=600, golden=g)
    assert save(0.8, 0.95) == {"version": 1, "promote": True, "active": 1}
    assert save(0.9, 0.90) == {"version": 2, "promote": False, "active": 1}  # better, but worse on the golden set
    assert save(0.7, 0.94) == {"version": 3, "promote": True, "active": 2}  # allowed, and the best one so far is version 2
    assert not store.activate("upi", 9) and store.activate("upi", 3) and store.active("upi") == 3
    rows = {r.version: r for r in store.versions("upi").collect()}
    assert [v for v, r in rows.items() if r.active] == [3] and rows[2].golden == 0.90
    head = Head("m", "risk", "classifier", ("a", "b"), classes=("0", "1"))
    folds = store.reevaluate("upi", data, [head], "account_id")
    after = {r.version: r for r in store.versions("upi").collect()}
    assert after[3].accuracy == pytest.approx(folds.agg(F.avg("accuracy")).first()[0]) and after[1].accuracy == rows[1].accuracy
    p = store.load("upi", "m").transform(data).agg(F.sum("prediction")).first()[0]
    assert p == fitted.transform(data).agg(F.sum("prediction")).first()[0]


def test_two_writers_and_a_reader(spark, tmp_path):
    store = registry.Registry(spark, str(tmp_path))
    taken, read, stop, errors = [], [], threading.Event(), []

    def write():
        try:
            for _ in range(15):
                n = store.claim("aa")
                taken.append(n)
                assert store.activate("aa", n)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def watch():
        while not stop.is_set():
            try:
                read.append(store.active("aa"))
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    watcher = threading.Thread(target=watch)
    writers = [threading.Thread(target=write) for _ in range(2)]
    watcher.start()
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    stop.set()
    watcher.join()
    assert not errors and sorted(taken) == list(range(1, 31))
    assert set(read) <= {None, *range(1, 31)} and store.versions("aa") is None  # claimed, none stored yet


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["k08_upi_fitted_decision", "k07_bbps_fitted_decision"])
def test_decision_follows_the_fitted_heads(spark, name):
    import __spark_entry__ as entry

    rows = entry.queries()[name](spark, SF).collect()
    assert rows and all(r.risk_label in ("LOW", "MEDIUM", "HIGH") and 0 <= r.stability <= 100 for r in rows)
    for r in rows:
        if r.serious_fails > 0:
            want = "REJECTED"
        elif r.failed > 0 or r.risk_label == "HIGH":
            want = "CONDITIONAL APPROVAL"
        elif r.risk_label == "LOW" and r.stability >= 70:
            want = "APPROVED"
        else:
            want = "APPROVED WITH NOTES"
        assert r.decision == want


def test_tax_decision_follows_the_fitted_score(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["k06_gst_fitted_decision"](spark, SF).collect()
    assert rows and all(0 <= r.head_score <= 100 for r in rows)
    for r in rows:
        if r.serious_fails > 0:
            want = "REJECTED"
        elif r.failed > 0 or r.head_score < 55:
            want = "CONDITIONAL APPROVAL"
        else:
            want = "APPROVED" if r.head_score >= 75 else "APPROVED WITH NOTES"
        assert r.decision == want
