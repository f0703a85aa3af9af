"""Model heads, registry paths and sinks on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from uwspark.ml import heads, isolation
from uwspark.ml.heads import Head
from uwspark.sources import sinks


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random(), rnd.random()) for i in range(200)]
    return spark.createDataFrame(
        [(i, a, b, "HIGH" if a > 0.6 else "LOW", 100 * a + b) for i, a, b in rows],
        "account_id long, a double, b double, band string, score double",
    ).cache()


def test_classifier_head_and_unseen_class(data):
    h = Head("m", "band", "classifier", ("a", "b"), classes=("LOW", "MEDIUM", "HIGH"))
    model = heads.fit(data, h, "random_forest")
    out = heads.predict(model, data, h, "account_id").collect()
    assert {r.label for r in out} <= {"LOW", "HIGH"} and all(r.probabilities["MEDIUM"] < 0.05 for r in out)
    assert heads.accuracy(model, data, h) > 0.95


def test_regressor_is_clipped_and_scored(data):
    h = Head("s", "score", "regressor", ("a", "b"), 0.0, 50.0)
    model = heads.fit(data, h, "linear_regression")
    assert heads.predict(model, data, h, "account_id").agg(F.max("value")).first()[0] == 50.0
    top = heads.importances(model, h)
    assert top[0][0] == "a" and sum(v for _, v in top) == pytest.approx(1.0)
    cv = heads.regression_metrics(heads.cross_validate(data, h, "account_id", 3, "linear_regression"), 50.0)
    row = heads.evaluation_row(heads.fold_status(cv, "r2", 0.08), h).first()
    assert row.folds == 3 and row.r2 > 0.95


def test_golden_slice_is_stable_and_written_once(spark, data, tmp_path):
    g = heads.golden_slice(data, "account_id", 200)
    n = g.count()
    assert 30 <= n <= 70  # a quarter of 200 keys by a hash threshold
    first = sinks.write_once(g, str(tmp_path / "g"))
    again = sinks.write_once(data.limit(1), str(tmp_path / "g"))
    assert first.count() == again.count() == n


def test_model_round_trip(data, tmp_path):
    h = Head("s", "score", "regressor", ("a", "b"))
    model = heads.fit(data, h, "linear_regression")
    again = sinks.load_model(sinks.save_model(model, str(tmp_path), "upi", h.id, 1))
    a = heads.registry_score(model, data, h, 1).orderBy("account_id").collect()
    assert a == heads.registry_score(again, data, h, 1).orderBy("account_id").collect()
    assert all(300 <= r.model_score <= 900 for r in a)


def test_isolation_forest_finds_the_far_point(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(400)] + [(999, 50.0, -50.0)]
    df = spark.createDataFrame(rows, "account_id long, x double, y double")
    scored = isolation.flag(isolation.score(df, isolation.fit(df, ["x", "y"], "account_id", trees=10), ["x", "y"]), 0.01)
    assert scored.orderBy(F.col("anomaly").desc()).first().account_id == 999
    assert scored.where("is_anomaly").count() <= 6


def test_profile_sink_keeps_other_domains(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.0)], "metric string, median double")
    path = str(tmp_path / "p")
    sinks.save_profile(df, path, "aa")
    sinks.save_profile(df.withColumn("median", F.lit(2.0)), path, "upi")
    sinks.save_profile(df.withColumn("median", F.lit(3.0)), path, "aa")
    assert sinks.load_profile(spark, path, "aa").first().median == 3.0
    assert sinks.load_profile(spark, path, "upi").first().median == 2.0
