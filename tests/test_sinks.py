"""Sinks written and read back, and small helpers around models."""

from pyspark.sql import functions as F

from uwspark.ml import heads, labels
from uwspark.sources import files, sinks


def test_feature_vectors_keep_the_selection(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 2.0)], "account_id long, a double, b double")
    sinks.write_feature_vectors(df, ["a", "b"], f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").first().selected_by_variance == "a,b"


def test_children_of_other_partitions_stay(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "run_date string, n long")
    sinks.replace_children(rows(("d1", 1), ("d2", 2)), f"{tmp_path}/c")
    sinks.replace_children(rows(("d2", 5), ("d2", 6)), f"{tmp_path}/c")
    assert {(r.run_date, r.n) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {("d1", 1), ("d2", 5), ("d2", 6)}


def test_events_are_appended(spark, tmp_path):
    for n in (1, 2):
        sinks.append_events(spark.createDataFrame([(n,)], "n long"), f"{tmp_path}/e")
    got = spark.read.parquet(f"{tmp_path}/e")
    assert sorted(r.n for r in got.collect()) == [1, 2] and got.where("written_at is null").count() == 0


def test_corpus_versions(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    batch = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v long")
    got = sinks.write_corpus_version(base, batch, ["k"], str(tmp_path), 2)
    assert {(r.k, r.v) for r in got.collect()} == {("a", 1), ("b", 9), ("c", 3)}
    assert spark.read.parquet(f"{tmp_path}/v2").count() == 3


def test_warehouse_appends_table_by_table(spark, tmp_path):
    t = {"x": spark.createDataFrame([(1,)], "n long"), "y": spark.createDataFrame([(2,)], "n long")}
    sinks.write_warehouse(t, str(tmp_path))
    sinks.write_warehouse({"x": t["x"]}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/x").count() == 2 and spark.read.parquet(f"{tmp_path}/y").count() == 1


def test_only_deployed_heads(spark):
    p = spark.createDataFrame([("risk", 1), ("loan", 2)], "head string, n long")
    on = spark.createDataFrame([("risk", True), ("loan", False)], "head string, deployed boolean")
    assert [r.n for r in heads.deployed_only(p, on).collect()] == [1]


def test_session_score_of_a_risk_head(spark):
    rows = [(i, float(i), float(i % 7), "1" if i > 50 else "0") for i in range(100)]
    df = spark.createDataFrame(rows, "account_id long, a double, b double, y string")
    h = heads.Head("r", "y", "classifier", ("a", "b"), classes=("0", "1"))
    got = heads.session_score(heads.fit(df, h, "random_forest"), df, h).collect()
    assert all(300 <= r.model_score <= 900 for r in got) and len({r.model_score > 600 for r in got}) == 2


def test_missing_columns_come_from_the_means(spark):
    row = spark.createDataFrame([(7, None, 2.0)], "account_id long, a double, b double")
    means = spark.createDataFrame([(1.5, 9.0, 4.0)], "a double, b double, c double")
    assert tuple(labels.filled_from_means(row, means).first()) == (7, 1.5, 2.0, 4.0)


def test_json_scan_counts_empty_fields(spark):
    t = spark.createDataFrame([("f", '[{"a": "1", "b": ""}, {"a": null, "b": "2"}]')], "file string, text string")
    got = files.json_scan(files.json_records(t, ["data"])).first()
    assert (got.records, got.fields, got.empty_fields) == (2, 4, 2) and got.cleanliness == 50


def test_lines_of_admitted_files(spark, tmp_path):
    for name, text in (("a.txt", "x\n\ny"), ("b.txt", "z")):
        (tmp_path / name).write_text(text)
    lines = files.line_table(files.read_lines(spark, str(tmp_path)))
    assert sorted(r.line for r in lines.collect()) == ["x", "y", "z"] and lines.where(F.col("line_no") > 1).count() == 0
