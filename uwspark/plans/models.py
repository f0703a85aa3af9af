"""Evaluation, permutation importance, pattern models and the version registry."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, rulebook
from ..ml import evaluation, heads, labels, registry, signatures
from ..operators import bbps, features, gst, monitor, patterns, rules, upi
from ..sources.adapters import read
from ..staging import shared, shared_dir, stage
from . import oracle
from .cleaning import cleaned
from .learning import _PAYMENT_SQL, _UTILITY_SQL, payment_features, utility_features
from .registry import query
from .signals import compared, metrics_of
from .sources import AS_OF, bank, payments, returns

# ------------------------------------------------------------------ folds and metrics


def payment_rows(spark, sf_dir):
    return shared(spark, sf_dir, "payment_targets", lambda: labels.payment_targets(payment_features(spark, sf_dir)))


def utility_rows(spark, sf_dir):
    return shared(spark, sf_dir, "utility_targets", lambda: labels.utility_targets(utility_features(spark, sf_dir)))


def _folds_sql(rows: str, label: str, k: int) -> str:
    return f"""SELECT account_id, {label}, CAST((row_number() OVER (PARTITION BY {label} ORDER BY md5(account_id || ':42'), account_id) - 1) % {k} AS INTEGER) AS fold FROM ({rows})"""


@query("l08_stratified_folds", _folds_sql(_PAYMENT_SQL, "risk_band", 3))
def payment_folds(spark, sf_dir):
    return evaluation.stratified_folds(payment_rows(spark, sf_dir), "account_id", "risk_band", 3).select("account_id", "risk_band", "fold")


@query("l08_stratified_folds_utility", _folds_sql(_UTILITY_SQL, "behaviour", 5))
def utility_folds(spark, sf_dir):
    return evaluation.stratified_folds(utility_rows(spark, sf_dir), "account_id", "behaviour", 5).select("account_id", "behaviour", "fold")


@query(
    "l08_brier",
    """SELECT fold, CASE WHEN min(y) <> max(y) THEN round(avg((p - y) * (p - y)), 9) ELSE 0.0 END AS brier
    FROM (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(l_discount * 10 AS DOUBLE) AS p FROM lineitem) GROUP BY fold""",
)
def brier(spark, sf_dir):
    pred = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
        (F.col("l_discount") * 10).cast("double").alias("p"),
    )
    return evaluation.brier(pred).withColumn("brier", F.round("brier", 9))


def _features(df, *targets):
    return [c for c in df.columns if c not in ("account_id", *targets)]


TARGETS = {"upi": ("risk_band", "reliability", "behaviour", "stability"), "bbps": ("risk_band", "discipline", "behaviour", "stability")}


def _heads(domain: str, features: DataFrame) -> list[heads.Head]:
    return heads.heads_of(domain, _features(features))


@query("l08_head_evaluation")
def head_evaluation(spark, sf_dir):
    """Three stratified folds of all four payment and all four utility heads: every metric and its status."""
    parts = []
    for domain, rows, feature_rows in (
        ("upi", payment_rows(spark, sf_dir), payment_features(spark, sf_dir)),
        ("bbps", utility_rows(spark, sf_dir), utility_features(spark, sf_dir)),
    ):
        for head in _heads(domain, feature_rows):
            algorithm = "linear_regression" if head.kind == "regressor" else "random_forest"
            parts.append(evaluation.evaluated(rows, head, "account_id", 3, algorithm))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ permutation importance


@query(
    "l10_permuted_column",
    """SELECT a.account_id, a.success_ratio, b.success_ratio AS other FROM
      (SELECT account_id, CAST(success_ratio AS DOUBLE) AS success_ratio, row_number() OVER (ORDER BY md5(account_id || ':0'), account_id) AS i FROM x_upi_analysis) a JOIN
      (SELECT account_id, CAST(success_ratio AS DOUBLE) AS success_ratio, row_number() OVER (ORDER BY md5(account_id || ':1'), account_id) AS i FROM x_upi_analysis) b USING (i)""",
)
def permuted_column(spark, sf_dir):
    out = evaluation.permuted(payment_features(spark, sf_dir), "account_id", ["success_ratio"], 0)
    return out.select("account_id", "success_ratio", F.col("_other.success_ratio").alias("other"))


@query("l10_permutation_importance")
def importance(spark, sf_dir):
    """Permutation importance of every feature of the reliability head."""
    rows, features = payment_rows(spark, sf_dir), payment_features(spark, sf_dir)
    head = _heads("upi", features)[1]
    return evaluation.permutation_importance(heads.fit(rows, head, "linear_regression"), rows, head, "account_id", repeats=2)


# ------------------------------------------------------------------ pattern models

for _d, (_src, _key) in oracle.PATTERN_SOURCES.items():

    @query(f"l18_{_d}_pattern_models")
    def pattern_models(spark, sf_dir, d=_d):
        """Fraud and anomaly model of a domain, fitted on its metric rows, and the verdict they lead to."""
        m, key = metrics_of(spark, sf_dir, d)
        rows = stage(signatures.training_rows(m, d, key))
        scored = stage(signatures.scored(signatures.fit(rows, d), rows, key))
        verdict = signatures.verdicts(m, monitor.worst_z(compared(m, d, key), key), scored, d, key)
        return scored.join(verdict, key)

    # A probability table as an outside scorer stages it: a third per raised typology, a quarter per metric out of its band.
    oracle.block(
        f"x_scored_{_d}",
        f"""SELECT {_key}, least(1.0, raised / 3.0) AS fraud_p, least(1.0, outside / 4.0) AS anomaly_p FROM
          (SELECT {_key}, count(*) FILTER (verdict <> 'none') AS raised FROM x_typ_{_d} GROUP BY 1) JOIN
          (SELECT {_key}, count(*) FILTER (band <> 'within') AS outside FROM x_cmp_{_d} GROUP BY 1) USING ({_key})""",
    )

    @query(
        f"k15_{_d}_with_model",
        f"""SELECT {_key}, CASE WHEN hit THEN 'MATCHES FRAUD TYPOLOGY' WHEN band = 'extreme' OR (soft AND band = 'elevated') THEN 'ELEVATED ANOMALY SIGNATURE'
          WHEN soft OR band = 'elevated' THEN 'SOME ELEVATED SIGNALS' ELSE 'CONSISTENT WITH TRAINING' END AS verdict,
          concern AS concern_score, CASE WHEN concern >= 65 THEN 'concern' WHEN concern >= 35 THEN 'review' ELSE 'good' END AS zone,
          CASE WHEN concern < 35 THEN 'none' WHEN hit THEN 'typology' WHEN fraud_p * 100 = top THEN 'fraud_model' WHEN anomaly_p * 75 = top THEN 'anomaly_model' ELSE 'anomaly_metric' END AS reason,
          least(100.0, round_even(wz / 3.5 * 60.0, 1)) AS pattern_score,
          CASE WHEN hit THEN 'alert' WHEN soft OR fraud_p >= 0.3 THEN 'review' ELSE 'clear' END AS fraud_box,
          CASE WHEN band = 'extreme' OR anomaly_p >= 0.7 THEN 'alert' WHEN band = 'elevated' OR anomaly_p >= 0.4 THEN 'review' ELSE 'clear' END AS anomaly_box
        FROM (SELECT *, CAST(round_even(top, 0) AS BIGINT) AS concern FROM
          (SELECT *, CASE WHEN wz >= 3.5 THEN 'extreme' WHEN wz >= 2.0 THEN 'elevated' ELSE 'within' END AS band,
              greatest(CASE WHEN hit THEN 100.0 ELSE 0.0 END, CAST(fraud_p * 100 AS DOUBLE), CAST(anomaly_p * 75 AS DOUBLE), least(100.0, wz / 3.5 * 60.0)) AS top
            FROM (SELECT {_key}, hard_match OR fraud_p >= 0.6 AS hit, soft, fraud_p, anomaly_p, wz FROM
              (SELECT {_key}, bool_or(hard AND verdict = 'match') AS hard_match, bool_or(verdict <> 'none') AS soft FROM x_typ_{_d} GROUP BY 1)
              JOIN (SELECT {_key}, max(z) AS wz FROM x_cmp_{_d} GROUP BY 1) USING ({_key}) JOIN x_scored_{_d} USING ({_key}))))""",
    )
    def with_model(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        long = stage(compared(m, d, key))
        typ = patterns.typologies(m, d, key)
        raised = typ.groupBy(key).agg(F.count_if(F.col("verdict") != "none").alias("raised"))
        outside = long.groupBy(key).agg(F.count_if(F.col("band") != "within").alias("outside"))
        models = stage(
            raised.join(outside, key).select(
                key,
                F.least(F.lit(1.0), F.col("raised") / 3.0).alias("fraud_p"),
                F.least(F.lit(1.0), F.col("outside") / 4.0).alias("anomaly_p"),
            )
        )
        return signatures.verdicts(m, monitor.worst_z(long, key), models, d, key)


# ------------------------------------------------------------------ decisions and scores from fitted heads


def _predicted(rows: DataFrame, domain_heads: list[heads.Head], key: str) -> DataFrame:
    """Predictions of all heads of a domain, fitted on the rows, as one long table."""
    parts = [heads.predict(heads.fit(rows, h, "random_forest"), rows, h, key) for h in domain_heads]
    return stage(reduce(DataFrame.unionByName, parts))


def tax_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Tax profiles with the targets of their heads, and the feature columns."""
    build = lambda: gst.policy_heads(gst.profiles(returns(spark, sf_dir), AS_OF))
    p = shared(spark, sf_dir, "tax_rows", build)
    numbers = [c for c, t in p.dtypes if t in ("double", "bigint", "int") and c not in ("head_loan", "head_filing")]
    return p, numbers


def tax_predictions(spark, sf_dir) -> DataFrame:
    p, numbers = tax_rows(spark, sf_dir)
    return shared(spark, sf_dir, "tax_predictions", lambda: _predicted(p, heads.heads_of("gst", numbers), "gstin"))


def _long(predictions: DataFrame, key: str) -> DataFrame:
    return predictions.select(key, "head", "value", "label", F.map_values("probabilities").alias("p"))


@query("l09_tax_heads")
def tax_heads(spark, sf_dir):
    """The four tax heads, none of which sees its own target, trained and scored on every business."""
    return _long(tax_predictions(spark, sf_dir), "gstin")


@query("l09_session_heads")
def session_heads(spark, sf_dir):
    """The three heads of bank statements, trained and scored on every account."""
    f = features.session_features(cleaned(spark, sf_dir))
    rows = stage(labels.session_labels(stage(f)))
    return _long(_predicted(rows, heads.heads_of("aa", list(fixed.BASE_FEATURES)), "account_id"), "account_id")


@query("k06_gst_fitted_decision")
def gst_fitted_decision(spark, sf_dir):
    """Tax rules and decision on what the fitted heads say instead of the labels they were trained on."""
    p, _ = tax_rows(spark, sf_dir)
    said = tax_predictions(spark, sf_dir)
    value = lambda h: F.max(F.when(F.col("head") == h, F.col("value")))
    wide = said.groupBy("gstin").agg(
        value("gst_underwriting_score_model").alias("head_score"),
        F.max(F.when(F.col("head") == "gst_risk_flag_model", F.col("label"))).alias("head_risk"),
        value("gst_loan_eligibility_model").alias("head_loan"),
        value("gst_filing_compliance_model").alias("head_filing"),
    )
    judged = stage(p.drop("head_score", "head_risk", "head_loan", "head_filing").join(wide, "gstin"))
    out = rules.gst_decision(rules.evaluate(judged, rulebook.GST_RULES, key="gstin", detail=False), judged)
    return out.select("gstin", "head_score", "passed", "failed", "skipped", "serious_fails", "decision")


def _fitted_decision(analysis, rulelist, final, rows, domain, feature_rows):
    """Rule results with the closing rule, decided on the predicted risk band and stability."""
    risk, _, _, stability = _heads(domain, feature_rows)
    said = _predicted(rows, [risk, stability], "account_id")
    scored = said.groupBy("account_id").agg(
        F.max(F.when(F.col("head") == risk.id, F.col("label"))).alias("risk_label"),
        F.max(F.when(F.col("head") == stability.id, F.col("value"))).alias("stability"),
    )
    results = rules.with_final_signal(rules.evaluate(analysis, rulelist), final)
    return rules.head_decision(results, scored).select("account_id", "risk_label", "stability", "passed", "failed", "skipped", "serious_fails", "decision")


@query("k08_upi_fitted_decision")
def upi_fitted_decision(spark, sf_dir):
    """Payment rules decided on the predictions of the fitted heads."""
    a = upi.analysis(payments(spark, sf_dir))
    return _fitted_decision(a, rulebook.UPI_RULES, rulebook.UPI_FINAL, payment_rows(spark, sf_dir), "upi", payment_features(spark, sf_dir))


@query("k07_bbps_fitted_decision")
def bbps_fitted_decision(spark, sf_dir):
    """Bill rules decided on the predictions of the fitted heads."""
    a = bbps.analysis(bbps.by_type(bank(spark, sf_dir)))
    return _fitted_decision(a, rulebook.BBPS_RULES, rulebook.BBPS_FINAL, utility_rows(spark, sf_dir), "bbps", utility_features(spark, sf_dir))


# ------------------------------------------------------------------ registry


@query(
    "l13_k21_version_replay",
    """WITH RECURSIVE v AS (
      SELECT o_custkey AS domain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
        0.5 * ((o_orderkey % 101) / 100.0) + 0.3 * ((o_orderkey % 97) / 96.0) + 0.2 * ((o_orderkey % 89) / 88.0) AS q,
        CAST(0.9 + (o_orderkey % 11) / 100.0 AS DOUBLE) AS golden FROM orders),
    s AS (
      SELECT domain, version, true AS promote, version AS best, q, golden AS best_golden, version AS active, golden FROM v WHERE version = 1
      UNION ALL
      SELECT domain, version, promote, best, q, best_golden, CASE WHEN promote THEN best ELSE old END, CASE WHEN promote THEN best_golden ELSE old_golden END FROM
        (SELECT v.domain, v.version, NOT (s.golden - v.golden > 0.03) AS promote, s.active AS old, s.golden AS old_golden,
           CASE WHEN v.q > s.q THEN v.version ELSE s.best END AS best, greatest(v.q, s.q) AS q, CASE WHEN v.q > s.q THEN v.golden ELSE s.best_golden END AS best_golden
         FROM s JOIN v ON v.domain = s.domain AND v.version = s.version + 1))
    SELECT domain, version, promote, active FROM s""",
)
def version_replay(spark, sf_dir):
    """Each customer's orders as the version log of one model: gate and active version after every save."""
    logs = labels.version_log(read(spark, sf_dir, "orders"))
    return registry.replay(logs)


@query("l13_l15_registry_round")
def registry_round(spark, sf_dir):
    """Two versions of the payment heads saved, gated and re-evaluated in a registry of their own."""
    rows, features = payment_rows(spark, sf_dir), payment_features(spark, sf_dir)
    domain_heads = _heads("upi", features)
    frozen = stage(heads.golden_slice(rows, "account_id", rows.count()))
    store = registry.Registry(spark, f"{shared_dir(spark).rstrip('/')}/uwspark-{spark.sparkContext.applicationId}/models-{uuid.uuid4().hex}")
    for algorithm in ("random_forest", "logistic_regression"):
        fitted = {h.id: heads.fit(rows, h, algorithm if h.kind == "classifier" else "linear_regression") for h in domain_heads}
        own = heads.classification_metrics(
            fitted[domain_heads[0].id].transform(heads.labelled(rows, domain_heads[0]).na.fill(0.0)).select(F.lit(0).alias("fold"), "y", F.col("prediction").alias("p"))
        )
        golden = heads.accuracy(fitted[domain_heads[0].id], frozen, domain_heads[0])
        store.save("upi", fitted, own, algorithm=algorithm, samples=rows.count(), golden=golden)
    store.reevaluate("upi", rows, domain_heads[:1], "account_id")
    listed = store.versions("upi")
    return listed.select("version", "algorithm", "samples", "golden", "accuracy", "f1", "active", F.size("heads").alias("heads"))
