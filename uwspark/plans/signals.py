"""Anomalies, monthly analytics, fraud patterns, baselines and drift."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import fixed
from ..functions.columns import half_even
from ..operators import bbps, context, features, gst, ledger, monitor, patterns, scoring, upi
from ..sources import adapters
from ..staging import shared, stage
from . import oracle
from .bank import context_of, prepared, scores, staged_txns
from .registry import query
from .sources import AS_OF, bank, payments, returns

# ------------------------------------------------------------------ anomalies and analytics


@query(
    "k10_f01_anomalies",
    """SELECT account_id, seq, amount, score, level, reasons, rank FROM
      (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, seq) AS rank FROM x_anomalies) WHERE rank <= 12""",
)
def anomalies(spark, sf_dir):
    top = scoring.top_anomalies(scoring.anomaly_rows(prepared(spark, sf_dir)))
    return top.select("account_id", "seq", "amount", "score", "level", "reasons", "rank")


@query(
    "c04_e18_amount_fences",
    """SELECT account_id, txn_type, round(greatest(50000.0, 4.0 * quantile_cont(amount, 0.9)), 4) AS fence FROM x_bank
      JOIN (SELECT account_id, txn_type, quantile_cont(amount, 0.95) AS cut, count(*) AS m FROM x_bank WHERE amount > 0 GROUP BY ALL)
      USING (account_id, txn_type) WHERE m >= 4 AND amount > 0 AND amount <= cut GROUP BY ALL""",
)
def fences(spark, sf_dir):
    rows = adapters.bank_txn(spark, sf_dir).where("amount > 0")
    return scoring.amount_fence(rows, ["account_id", "txn_type"]).withColumn("fence", F.round("fence", 4))


@query("k18_e12_monthly_analytics", "SELECT * FROM x_month_analytics")
def analytics(spark, sf_dir):
    return scoring.monthly_view(staged_txns(spark, sf_dir), adapters.accounts(spark, sf_dir))


@query(
    "e09_score_trajectory",
    """SELECT account_id, bucket, t.score, t.pd, CASE WHEN t.score >= 700 THEN 'LOW' WHEN t.score >= 550 THEN 'MEDIUM' ELSE 'HIGH' END AS grade
      FROM (SELECT account_id, bucket, CASE WHEN last THEN s.score ELSE t.score END AS score, CASE WHEN last THEN s.pd ELSE t.pd END AS pd
        FROM (SELECT *, bucket = max(bucket) OVER (PARTITION BY account_id) AS last FROM x_traj_score) t JOIN x_score s USING (account_id)) t""",
)
def trajectory(spark, sf_dir):
    txns = staged_txns(spark, sf_dir)
    final = scores(stage(ledger.prepare(txns, adapters.accounts(spark, sf_dir))))
    return scoring.trajectory(txns, final)


# ------------------------------------------------------------------ patterns per domain


def metrics_of(spark, sf_dir, domain):
    """(metric table, key) of a domain, staged."""
    if domain == "aa":
        return context_of(spark, sf_dir)[1].select("account_id", *fixed.PATTERN_METRICS["aa"]), "account_id"
    if domain == "upi":
        build = lambda: upi.fraud_metrics(payments(spark, sf_dir))
        return shared(spark, sf_dir, "upi_metrics", build), "account_id"
    if domain == "bbps":
        txns = bank(spark, sf_dir)
        types = shared(spark, sf_dir, "bill_types", lambda: bbps.by_type(txns))
        build = lambda: bbps.fraud_metrics(txns, types, bbps.analysis(types))
        return shared(spark, sf_dir, "bill_metrics", build), "account_id"
    build = lambda: gst.fraud_metrics(gst.profiles(returns(spark, sf_dir), AS_OF))
    return shared(spark, sf_dir, "gst_metrics", build), "gstin"


def compared(metrics, domain, key):
    long = monitor.long_metrics(metrics, list(fixed.PATTERN_METRICS[domain]), [key])
    trained = monitor.robust_profile(long)
    return monitor.compare_to_baseline(long, monitor.metric_table(metrics.sparkSession, domain), trained)


ID = {"aa": "k11", "gst": "k12", "bbps": "k13", "upi": "k14"}

# Limits of the twins, written apart from the implementation.
UNUSUAL_FIGURES = {
    "aa": "neg_points > 0 OR bounce_count > 0 OR reversal_count > 3 OR largest_credit_pct > 1 OR inflow_cv > 0.6 OR cash_deposit_ratio > 0.4",
    "upi": "sudden_spike_ratio > 3 OR failed_ratio > 0.08 OR round_amount_ratio > 0.25 OR single_counterparty_dominance_pct > 60",
    "bbps": "missed_payment_count >= 2 OR bill_spike_ratio > 2.5 OR single_utility_dominance_pct > 75 OR vague_narration_ratio > 0.2",
    "gst": "late_return_count >= 2 OR consecutive_declining_quarters >= 2 OR turnover_decline_percentage > 20",
}

for _d, (_src, _key) in oracle.PATTERN_SOURCES.items():

    @query(f"{ID[_d]}_{_d}_typologies", f"SELECT {_key}, typology, hard, verdict, evidence FROM x_typ_{_d}")
    def typologies(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        return patterns.typologies(m, d, key).select(key, "typology", "hard", "verdict", "evidence")

    @query(
        f"c07_{_d}_baseline_compare",
        f"SELECT {_key}, metric, round(value, 4) AS value, baseline, z, band, basis FROM x_cmp_{_d}",
    )
    def compare(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        out = compared(m, d, key)
        return out.select(key, "metric", F.round("value", 4).alias("value"), "baseline", "z", "band", "basis")

    @query(f"k15_k17_{_d}_verdict", f"SELECT * FROM x_verdict_{_d}")
    def verdict(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        flags = patterns.typology_flags(patterns.typologies(m, d, key), key)
        return patterns.verdicts(flags, monitor.worst_z(compared(m, d, key), key), key=key)

    @query(
        f"d26_f04_{_d}_corpus_typologies",
        f"""SELECT CAST(row_number() OVER (ORDER BY matched DESC, elevated DESC, ord) AS BIGINT) AS position, typology, matched, elevated, clear, worst_evidence FROM
          (SELECT ord, typology, coalesce(arg_min(evidence, {_key}) FILTER (verdict = 'match'), arg_min(evidence, {_key}) FILTER (verdict = 'elevated'), '') AS worst_evidence, CAST(count(*) FILTER (verdict = 'match') AS BIGINT) AS matched, CAST(count(*) FILTER (verdict = 'elevated') AS BIGINT) AS elevated,
             CAST(count(*) FILTER (verdict = 'none') AS BIGINT) AS clear FROM x_typ_{_d} GROUP BY ord, typology)""",
    )
    def corpus(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        t = patterns.corpus_typologies(patterns.typologies(m, d, key), key)
        out = patterns.ranked(t, F.col("matched").desc(), F.col("elevated").desc(), F.col("ord"))
        return out.select("position", "typology", "matched", "elevated", "clear", "worst_evidence")

    @query(
        f"d27_{_d}_corpus_metrics",
        f"""SELECT metric, round_even(list_sort(list(value))[CAST(count(*) // 2 + 1 AS INTEGER)], 3) AS median, round_even(max(value), 3) AS max,
          CAST(count(*) FILTER (value > f_med + f_mad / 0.6745 * 2.0) AS BIGINT) AS flagged
        FROM x_long_{_d} JOIN x_decl_{_d} USING (metric) WHERE value IS NOT NULL GROUP BY metric""",
    )
    def corpus_metrics(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        return patterns.corpus_metrics(m, d, key).select("metric", "median", "max", "flagged")

    @query(
        f"l05_{_d}_pattern_labels",
        f"""SELECT {_key}, CAST(coalesce({' OR '.join(f'({match})' for _, hard, match, *_ in oracle.SIGNATURES[_d] if hard)}, false) AS INTEGER) AS fraud_label,
          CAST(coalesce({UNUSUAL_FIGURES[_d]}, false) AS INTEGER) AS anomaly_label FROM {_src}""",
    )
    def labels(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        return patterns.weak_labels(m, d, key)


UNUSUAL = {"aa": "account", "gst": "GST", "bbps": "utility-payment", "upi": "UPI"}
NOUN = {"aa": "bank account", "gst": "tax filings", "bbps": "bill payments", "upi": "payments"}

for _d, (_src, _key) in oracle.PATTERN_SOURCES.items():

    @query(
        f"k17_{_d}_status_boxes",
        f"""SELECT {_key}, box, status,
          CASE WHEN status = 'clear' THEN if(box = 'fraud', 'No fraud detected', 'Nothing unusual')
               WHEN status = 'review' THEN if(box = 'fraud', 'Worth a closer look', 'Slightly unusual activity')
               ELSE if(box = 'fraud', 'Possible fraud pattern', 'Unusual {UNUSUAL[_d]} activity') END AS headline,
          CASE WHEN box = 'fraud' AND status = 'clear' THEN 'No known fraud typology matches the {NOUN[_d]}.'
               WHEN box = 'fraud' AND status = 'review' THEN 'A soft typology or a raised model probability concerns the {NOUN[_d]}; read them by hand.'
               WHEN box = 'fraud' THEN 'A hard fraud typology matches the {NOUN[_d]}, or the model is confident of one.'
               WHEN status = 'clear' THEN 'All metrics of the {NOUN[_d]} lie within their usual bands.'
               WHEN status = 'review' THEN 'At least one metric of the {NOUN[_d]} lies above its usual band.'
               ELSE 'At least one metric of the {NOUN[_d]} lies far outside its usual band.' END AS detail
        FROM (SELECT {_key}, 'fraud' AS box, fraud_box AS status FROM x_verdict_{_d}
              UNION ALL SELECT {_key}, 'anomaly', anomaly_box FROM x_verdict_{_d})""",
    )
    def boxes(spark, sf_dir, d=_d):
        m, key = metrics_of(spark, sf_dir, d)
        flags = patterns.typology_flags(patterns.typologies(m, d, key), key)
        v = patterns.verdicts(flags, monitor.worst_z(compared(m, d, key), key), key=key)
        return patterns.status_boxes(v, d, key).select(key, "box", "status", "headline", "detail")


# ------------------------------------------------------------------ monitoring


def vector_of(spark, sf_dir):
    return shared(spark, sf_dir, "vector", lambda: features.underwriting_vector(prepared(spark, sf_dir)))


@query("d19_outlier_profile", "SELECT * FROM x_vprof")
def outlier_profile(spark, sf_dir):
    long = monitor.long_metrics(vector_of(spark, sf_dir), list(fixed.OUTLIER_FALLBACK))
    return monitor.robust_profile(long, 30, {"p1": 0.01, "p99": 0.99}, 4)


_FALL = ", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, (a, b) in fixed.OUTLIER_FALLBACK.items())


@query(
    "k20_outlier_scores",
    f"""SELECT account_id, least(100.0, round_even(max(z) / 3.5 * 60.0, 1)) AS outlier_score, max(z) >= 3.5 AS is_outlier,
      coalesce(string_agg(CASE WHEN z >= 3.5 THEN metric END, ',' ORDER BY metric), '') AS flags FROM
      (SELECT account_id, metric, 0.6745 * abs(value - coalesce(median, f_med)) / CASE WHEN median IS NOT NULL THEN greatest(mad, 1e-9) ELSE f_mad END AS z
       FROM x_vlong JOIN (VALUES {_FALL}) AS t(metric, f_med, f_mad) USING (metric) LEFT JOIN x_vprof USING (metric) WHERE value IS NOT NULL) GROUP BY 1""",
)
def outliers(spark, sf_dir):
    v = vector_of(spark, sf_dir)
    prof = monitor.robust_profile(monitor.long_metrics(v, list(fixed.OUTLIER_FALLBACK)), 30, {"p1": 0.01, "p99": 0.99}, 4)
    return monitor.outlier_scores(v, prof)


_CL = ", ".join(
    f"coalesce(greatest({lo}, least({hi}, CAST({f} AS DOUBLE))), {lo}) AS {f}"
    for f, (lo, hi) in fixed.GUARD_BOUNDS.items() if f != "account_age_days"
)


@query(
    "b11_clamped_vector",
    f"""SELECT account_id, {_CL}, CAST({' + '.join(f"CASE WHEN {f} < {lo} OR {f} > {hi} THEN 1 ELSE 0 END" for f, (lo, hi) in fixed.GUARD_BOUNDS.items() if f != 'account_age_days')} AS INTEGER) AS clamped
    FROM x_vector""",
)
def clamped(spark, sf_dir):
    out = monitor.clamped(features.underwriting_vector(prepared(spark, sf_dir)).drop("account_age_days"))
    keep = [f for f in fixed.GUARD_BOUNDS if f != "account_age_days"]
    return out.select("account_id", *keep, F.size(F.filter("warnings", lambda w: w.endswith("clamped"))).alias("clamped"))


YEAR_METRICS = ["amount_sum", "txn_count", "credit_share"]


def yearly(spark, sf_dir):
    """Per account and year figures, the population the drift check compares."""
    t = adapters.bank_txn(spark, sf_dir).where("amount > 0")
    y = t.groupBy("account_id", F.year("txn_date").alias("year")).agg(
        F.sum("amount").alias("amount_sum"), F.count(F.lit(1)).cast("double").alias("txn_count"),
        (F.sum(F.when(F.col("txn_type") == "CREDIT", F.col("amount")).otherwise(0.0)) / F.sum("amount")).alias("credit_share"),
    )
    return monitor.long_metrics(y, YEAR_METRICS, ["account_id", "year"])


oracle.block(
    "x_year",
    """SELECT account_id, year(txn_date) AS year, sum(amount) AS amount_sum, CAST(count(*) AS DOUBLE) AS txn_count,
      sum(CASE WHEN txn_type = 'CREDIT' THEN amount ELSE 0.0 END) / sum(amount) AS credit_share FROM x_bank WHERE amount > 0 GROUP BY ALL""",
)
oracle.block("x_year_long", oracle.long_sql("x_year", YEAR_METRICS, "account_id, year"))
oracle.block("x_year_ref", "SELECT * FROM x_year_long WHERE year <= 1995")
oracle.block("x_year_rec", "SELECT * FROM x_year_long WHERE year > 1995")
oracle.block("x_psi", oracle.psi_sql("x_year_ref", "x_year_rec"))


@query(
    "d20_d21_drift_report",
    """SELECT metric, round_even(psi, 3) AS psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'stable' END AS band,
      CASE WHEN max(psi) OVER () >= 0.25 THEN 'alert' WHEN max(psi) OVER () >= 0.1 THEN 'warn' ELSE 'stable' END AS status,
      (SELECT round_even(round_even(sum(value), 6) / count(value), 3) FROM x_year_ref r WHERE r.metric = p.metric) AS reference_mean,
      (SELECT round_even(round_even(sum(value), 6) / count(value), 3) FROM x_year_rec r WHERE r.metric = p.metric) AS recent_mean FROM x_psi p""",
)
def drift(spark, sf_dir):
    long = stage(yearly(spark, sf_dir))
    return monitor.drift_report(long.where("year <= 1995"), long.where("year > 1995"))


@query(
    "d22_batch_shift",
    """SELECT metric, round_even(psi, 3) AS psi FROM x_psi WHERE psi >= 0.1""",
)
def shift(spark, sf_dir):
    long = stage(yearly(spark, sf_dir))
    out = monitor.psi(long.where("year <= 1995"), long.where("year > 1995"), min_ref=30)
    return out.where("psi >= 0.1").select("metric", half_even("psi", 3).alias("psi"))


@query(
    "b10_guard_report",
    """SELECT account_id, CAST(count(*) FILTER (amount < 0 OR amount > 60000) AS BIGINT) AS dropped,
      round_even(cs, 2) AS total_credit, round_even(ds, 2) AS total_debit, abs(tc - cs) > 0.02 * cs AS credit_drift, abs(td - ds) > 0.02 * ds AS debit_drift,
      abs(ob + cs - ds - cb) > greatest(1.0, 0.02 * abs(cb)) AS closing_mismatch
    FROM (SELECT *, coalesce(sum(amount) FILTER (txn_type = 'CREDIT' AND amount <= 60000) OVER w, 0.0) AS cs,
       coalesce(sum(amount) FILTER (txn_type = 'DEBIT' AND amount <= 60000) OVER w, 0.0) AS ds,
       sum(amount) FILTER (txn_type = 'CREDIT') OVER w AS tc, sum(amount) FILTER (txn_type = 'DEBIT') OVER w AS td,
       arg_min(balance, seq) FILTER (balance IS NOT NULL) OVER w AS ob, arg_max(balance, seq) FILTER (balance IS NOT NULL) OVER w AS cb
      FROM x_bank WINDOW w AS (PARTITION BY account_id)) GROUP BY account_id, cs, ds, tc, td, ob, cb""",
)
def guard(spark, sf_dir):
    txns = staged_txns(spark, sf_dir)
    rep = features.statement_summary(txns)
    return monitor.guard_report(txns, rep, max_amount=60000.0)
