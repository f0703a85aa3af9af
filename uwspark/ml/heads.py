"""Training, evaluation and scoring of model heads with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import half_even


@dataclass(frozen=True)
class Head:
    id: str
    target: str
    kind: str
    features: tuple[str, ...]
    low: float | None = None
    high: float | None = None
    classes: tuple[str, ...] = field(default=())


def heads_of(domain: str, features: list[str]) -> list[Head]:
    """Heads of a domain; a head never sees its own target or the columns it is made of."""
    keep = lambda *out: tuple(f for f in features if f not in out)
    bands = ("LOW", "MEDIUM", "HIGH")
    if domain == "upi":
        return [
            Head("upi_transaction_risk_model", "risk_band", "classifier", keep(), classes=bands),
            Head("upi_payment_reliability_model", "reliability", "regressor", keep(), 0.0, 100.0),
            Head("upi_spend_behaviour_model", "behaviour", "classifier", keep(), classes=("IRREGULAR", "REGULAR")),
            Head("upi_network_stability_model", "stability", "regressor", keep(), 0.0, 100.0),
        ]
    if domain == "bbps":
        return [
            Head("bbps_utility_payment_risk_model", "risk_band", "classifier", keep(), classes=bands),
            Head("bbps_payment_discipline_model", "discipline", "regressor", keep(), 0.0, 100.0),
            Head("bbps_bill_behaviour_model", "behaviour", "classifier", keep(), classes=("IRREGULAR", "REGULAR")),
            Head("bbps_utility_expense_stability_model", "stability", "regressor", keep(), 0.0, 100.0),
        ]
    if domain == "gst":
        loan = ("maximum_loan_by_gst_rule", "gst_turnover_to_loan_ratio", "proposed_loan_amount")
        return [
            Head("gst_underwriting_score_model", "head_score", "regressor", keep("head_score"), 0.0, 100.0),
            Head("gst_risk_flag_model", "head_risk", "classifier", keep("head_score"), classes=bands),
            Head("gst_loan_eligibility_model", loan[0], "regressor", keep(*loan), 0.0, None),
            Head("gst_filing_compliance_model", "filing_regularity_percentage", "regressor", keep("filing_regularity_percentage"), 0.0, 100.0),
        ]
    return [
        Head("risk_model", "risk_label", "classifier", keep(), classes=("0", "1")),
        Head("cashflow_model", "cashflow_score", "regressor", keep(), 0.0, 100.0),
        Head("money_balance_model", "balance_score", "regressor", keep(), 0.0, 100.0),
    ]


def estimator(algorithm: str, kind: str, n_classes: int, features: str = "scaled", label: str = "y"):
    """Spark ML estimator for an algorithm name.

    `xgboost` maps to gradient boosting and the RBF `svm` to the linear one: neither
    solver exists in Spark ML.  Boosting has no multi-class form there, so more than
    two classes use a random forest, and a linear SVM goes through one-vs-rest.
    """
    cols = {"featuresCol": features, "labelCol": label}
    if kind == "regressor":
        if algorithm in ("gradient_boosting", "xgboost"):
            return GBTRegressor(maxIter=20, maxDepth=4, seed=42, **cols)
        if algorithm == "random_forest":
            return RandomForestRegressor(numTrees=40, seed=42, **cols)
        return LinearRegression(regParam=0.1, **cols)
    if algorithm in ("gradient_boosting", "xgboost") and n_classes <= 2:
        return GBTClassifier(maxIter=20, maxDepth=4, seed=42, **cols)
    if algorithm in ("gradient_boosting", "xgboost", "random_forest"):
        return RandomForestClassifier(numTrees=40, seed=42, **cols)
    if algorithm == "svm":
        svc = LinearSVC(maxIter=50, **cols)
        return svc if n_classes <= 2 else OneVsRest(classifier=svc, **cols)
    return LogisticRegression(regParam=0.01, **cols)


def labelled(df: DataFrame, head: Head) -> DataFrame:
    """Add `y`: the numeric target, or the position of the class in the head's list."""
    t = F.col(head.target)
    if head.kind == "regressor":
        return df.where(t.isNotNull()).withColumn("y", t.cast("double"))
    pos = F.array_position(F.array(*[F.lit(c) for c in head.classes]), F.upper(t.cast("string")))
    return df.withColumn("y", F.greatest(pos - 1, F.lit(0)).cast("double"))


def fit(df: DataFrame, head: Head, algorithm: str = "gradient_boosting") -> PipelineModel:
    ready = labelled(df, head).na.fill(0.0, list(head.features))
    stages = [
        VectorAssembler(inputCols=list(head.features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        estimator(algorithm, head.kind, len(head.classes)),
    ]
    return Pipeline(stages=stages).fit(ready)


def predict(model: PipelineModel, df: DataFrame, head: Head, key: str) -> DataFrame:
    """(key, head, value, label, probabilities): classes never seen keep probability 0."""
    out = model.transform(df.na.fill(0.0, list(head.features)))
    none_v, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    if head.kind == "regressor":
        v = F.col("prediction")
        if head.low is not None:
            v = F.greatest(v, F.lit(head.low))
        if head.high is not None:
            v = F.least(v, F.lit(head.high))
        return out.select(
            key, F.lit(head.id).alias("head"), half_even(v, 2).alias("value"), none_s.alias("label"),
            F.lit(None).cast("map<string,double>").alias("probabilities"),
        )
    names = F.array(*[F.lit(c) for c in head.classes])
    label = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        probs = F.map_from_arrays(
            names, F.transform(F.sequence(F.lit(1), F.lit(len(head.classes))), lambda i: F.coalesce(F.try_element_at(p, i), F.lit(0.0)))
        )
    else:
        probs = F.lit(None).cast("map<string,double>")
    return out.select(key, F.lit(head.id).alias("head"), none_v.alias("value"), label.alias("label"), probs.alias("probabilities"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Deterministic fold by a hash of the key: no ordering of a whole class in one task.

    Hashing keeps every class spread over the folds in expectation.
    """
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, head: Head, key: str, k: int = 3, algorithm: str = "gradient_boosting") -> DataFrame:
    """Refit per fold; predictions of all folds come back as one table (key, fold, y, p)."""
    data = folds(labelled(df, head), key, k)
    parts = None
    for i in range(k):
        m = fit(data.where(F.col("fold") != i).drop("y"), head, algorithm)
        scored = m.transform(data.where(F.col("fold") == i).na.fill(0.0, list(head.features)))
        part = scored.select(key, "fold", "y", F.col("prediction").alias("p"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def regression_metrics(pred: DataFrame, median: float | None = None) -> DataFrame:
    """R2, MSE, MAE and above-threshold precision / recall / F1 per fold."""
    err = F.col("y") - F.col("p")
    n = F.count(F.lit(1))
    thr = F.lit(median if median is not None else 0.0)
    hit = F.count_if((F.col("y") > thr) & (F.col("p") > thr))
    prec = hit / F.nullif(F.count_if(F.col("p") > thr), F.lit(0))
    rec = hit / F.nullif(F.count_if(F.col("y") > thr), F.lit(0))
    return pred.groupBy("fold").agg(
        n.alias("n"),
        (1 - F.sum(err * err) / F.nullif(F.var_pop("y") * n, F.lit(0.0))).alias("r2"),
        (F.sum(err * err) / n).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.coalesce(prec, F.lit(0.0)).alias("precision"),
        F.coalesce(rec, F.lit(0.0)).alias("recall"),
    ).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 per fold from the confusion counts."""
    cm = pred.groupBy("fold", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    by = lambda c, out: cm.groupBy("fold", F.col(c).alias("c")).agg(F.sum("n").alias(out))
    right = cm.where("y = p").select("fold", F.col("y").alias("c"), F.col("n").alias("tp"))
    t = by("y", "support").join(by("p", "claimed"), ["fold", "c"], "left").join(right, ["fold", "c"], "left").na.fill(0)
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("claimed"), F.lit(0)), F.lit(0.0))
    rec = F.col("tp") / F.col("support")
    f1 = F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0))
    w = lambda v: F.sum(v * F.col("support")) / F.sum("support")
    return t.groupBy("fold").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), w(prec).alias("precision"), w(rec).alias("recall"), w(f1).alias("f1")
    )


def fold_status(metrics: DataFrame, column: str, tolerance: float) -> DataFrame:
    """PASSED when a fold is within `tolerance` of the mean, REVIEW otherwise (a handful of folds)."""
    mean = F.avg(column).over(W.partitionBy())
    return metrics.withColumn("status", F.when(F.abs(F.col(column) - mean) <= tolerance, "PASSED").otherwise("REVIEW"))


def importances(model: PipelineModel, head: Head, top: int = 5) -> list[tuple[str, float]]:
    """Normalised importance of the strongest features; absolute weights for linear models."""
    est = model.stages[-1]
    raw = getattr(est, "featureImportances", None)
    values = list(raw.toArray()) if raw is not None else [abs(float(x)) for x in getattr(est, "coefficients", [])]
    total = sum(values) or 1.0
    return sorted(((f, v / total) for f, v in zip(head.features, values)), key=lambda x: -x[1])[:top]


def top_factors(df: DataFrame, key: str, weights: dict[str, float], keep: int = 6) -> DataFrame:
    """Features of each row by |z| x importance, the strongest first.

    Mean and sample deviation are one row; the rank filter is a per-task limit.
    """
    names = list(weights)
    stats = df.agg(
        *[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_samp(n).alias(f"_s_{n}") for n in names]
    ).withColumn("_one", F.lit(1))
    items = ", ".join(
        f"named_struct('ord', {i}, 'feature', '{n}', 'value', cast({n} as double), 'z', "
        f"(cast({n} as double) - _m_{n}) / coalesce(nullif(_s_{n}, 0), 1.0D), 'weight', {w!r}D)"
        for i, (n, w) in enumerate(weights.items())
    )
    long = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").selectExpr(key, f"inline(array({items}))")
    order = W.partitionBy(key).orderBy((F.abs("z") * (F.col("weight") + 1e-9)).desc(), "ord")
    return (
        long.where("value is not null")
        .withColumn("rk", F.row_number().over(order).cast("bigint"))
        .where(F.col("rk") <= keep)
        .select(key, "rk", "feature", half_even("value", 4).alias("value"), half_even("z", 2).alias("z"))
    )


def zero_filled(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Zero or missing features replaced by the training mean, as the payment and utility scorers do."""
    means = df.agg(*[F.avg(n).alias(f"_m_{n}") for n in names]).withColumn("_one", F.lit(1))
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one")
    return j.select(key, *[F.coalesce(F.nullif(F.col(n).cast("double"), F.lit(0.0)), F.col(f"_m_{n}")).alias(n) for n in names])


def golden_slice(df: DataFrame, key: str, rows: int, frac: float = 0.15, least: int = 50) -> DataFrame:
    """Fixed yardstick: the share `frac` of the rows (about `least` rows at least) whose key hash lies under a threshold."""
    share = min(1.0, max(frac, least / max(rows, 1)))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(42)), F.lit(1_000_000))
    return df.where(place < int(share * 1_000_000))



def quality(accuracy: float, f1: float, r2: float) -> float:
    return 0.5 * accuracy + 0.3 * f1 + 0.2 * r2


def with_active(versions: DataFrame, domain: str = "domain") -> DataFrame:
    """Mark the best version of each domain as active; blocked ones are never picked."""
    q = F.expr("0.5 * accuracy + 0.3 * f1 + 0.2 * r2")
    best = versions.where("may_promote").groupBy(domain).agg(F.max_by("version", F.struct(q, -F.col("version"))).alias("_best"))
    return versions.join(best, domain, "left").withColumn(
        "active", F.coalesce(F.col("version") == F.col("_best"), F.lit(False))
    ).drop("_best")


def session_score(model: PipelineModel, df: DataFrame, head: Head, key: str = "account_id") -> DataFrame:
    """Credit score of a risk classifier: 900 at probability 0, 300 at probability 1."""
    out = model.transform(df.na.fill(0.0, list(head.features)))
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(key, (900.0 - p * 600.0).alias("model_score"), F.lit("session-model").alias("model_source"))


def registry_score(regressor: PipelineModel, df: DataFrame, head: Head, version: int, key: str = "account_id") -> DataFrame:
    """Score of the population regressor, kept inside 300..900."""
    out = regressor.transform(df.na.fill(0.0, list(head.features)))
    return out.select(
        key, F.least(F.greatest("prediction", F.lit(300.0)), F.lit(900.0)).alias("model_score"),
        F.lit(f"dataset-v{version}").alias("model_source"),
    )


def accuracy(model: PipelineModel, golden: DataFrame, head: Head) -> float:
    """Share of right classes on the frozen slice; one number comes back."""
    scored = model.transform(labelled(golden, head).na.fill(0.0, list(head.features)))
    return scored.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]


def evaluation_row(metrics: DataFrame, head: Head) -> DataFrame:
    """One summary row per head: the mean over its folds."""
    names = [c for c, t in metrics.dtypes if c != "fold" and t == "double"]
    return metrics.agg(F.count(F.lit(1)).alias("folds"), *[half_even(F.avg(n), 4).alias(n) for n in names]).withColumn(
        "head", F.lit(head.id)
    )


def deployed_only(predictions: DataFrame, deployments: DataFrame) -> DataFrame:
    """Predictions of the heads switched on; the deployment table has one row per head."""
    return predictions.join(F.broadcast(deployments.where("deployed").select("head")), "head", "left_semi")


def head_summary(predictions: DataFrame) -> DataFrame:
    """(head, n, value, label, distribution) of a batch: mean value of a regressor, counts and mode of a classifier's labels.

    Counts come per (head, label) first, so a head with all rows is a handful of rows before its mode is
    taken.  Of labels equally frequent the first in the alphabet is the mode.
    """
    per = predictions.groupBy("head", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("_s"), F.count("value").alias("_k"))
    best = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("n")).alias("c"), F.col("label").alias("label"))))
    pairs = F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))))
    return per.groupBy("head").agg(
        F.sum("n").alias("n"),
        half_even(F.sum("_s") / F.nullif(F.sum("_k"), F.lit(0)), 2).alias("value"),
        best["label"].alias("label"),
        F.map_from_entries(pairs).alias("distribution"),
    )
