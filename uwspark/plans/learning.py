"""Weak labels, features, heads and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import fixed, rulebook
from ..ml import heads, isolation, labels
from ..operators import bbps, features, rules, upi
from ..sources.adapters import read
from ..staging import shared, stage
from . import oracle
from .cleaning import cleaned
from .registry import query
from .signals import vector_of
from .sources import bank, payments

oracle.block(
    "x_population",
    """SELECT account_id, least(1.0, nach_bounce_count_90d / 3.0) AS bounce_count, CASE WHEN minimum_balance < 0 THEN 1.0 ELSE 0.0 END AS overdraft_count,
      CASE WHEN minimum_balance < 0 THEN 1.0 WHEN minimum_balance < 10000 THEN greatest(0.0, least(1.0, (10000 - minimum_balance) / 10000)) ELSE 0.0 END AS negative_balance_days,
      income_stability AS income_consistency_score, 0.5 + 0.5 * income_stability AS credit_regularity_score,
      greatest(0.0, least(1.0, 0.55 - balance_volatility * 0.4)) AS cash_flow_stability_score,
      greatest(0.0, least(1.0, (avg_monthly_inflow - avg_monthly_debit) / greatest(avg_monthly_inflow, 1.0) + 0.15)) AS monthly_net_cash_flow,
      greatest(0.0, least(0.30, (foir_ratio / 100 - 1.0) * 0.3 + 0.15)) AS emi_to_credit_ratio, greatest(0.05, least(0.48, foir_ratio / 250)) AS existing_debt_burden,
      least(1.0, cash_withdrawal_ratio * 3) AS cash_withdrawal_amount, CASE WHEN dscr_ratio < 1 THEN greatest(0.95, least(1.0, dscr_ratio)) ELSE 1.0 END AS credit_debit_ratio
    FROM x_vector""",
)
_POP = """bounce_count overdraft_count negative_balance_days income_consistency_score credit_regularity_score cash_flow_stability_score
  monthly_net_cash_flow emi_to_credit_ratio existing_debt_burden cash_withdrawal_amount credit_debit_ratio""".split()


@query("b26_population_row", "SELECT account_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _POP) + " FROM x_population")
def population(spark, sf_dir):
    p = labels.statement_to_population(vector_of(spark, sf_dir))
    return p.select("account_id", *[F.round(c, 6).alias(c) for c in _POP])


@query(
    "l01_policy_labels",
    """SELECT account_id, round(risk, 6) AS risk, CAST(risk > (SELECT quantile_cont(risk, 0.55) FROM r) AS INTEGER) AS label,
      round_even(greatest(300.0, least(900.0, 900 - risk * 620)), 0) AS score FROM r""".replace(
        "FROM r", """FROM (SELECT account_id, round_even(greatest(0.0, least(1.0, 0.24 * bounce_count + 0.18 * overdraft_count + 0.18 * negative_balance_days
        + 0.12 * greatest(0.0, least(1.0, emi_to_credit_ratio / 0.30)) + 0.10 * greatest(0.0, least(1.0, existing_debt_burden / 0.50)) + 0.10 * (1 - income_consistency_score)
        + 0.08 * (1 - greatest(0.0, least(1.0, (cash_flow_stability_score - 0.39) / 0.27))) - 0.12 * greatest(0.0, least(1.0, monthly_net_cash_flow / 0.30)))), 9) AS risk FROM x_population)"""
    ),
)
def policy(spark, sf_dir):
    out = labels.policy_labels(labels.statement_to_population(vector_of(spark, sf_dir)))
    return out.select("account_id", F.round("risk", 6).alias("risk"), "label", "score")


@query(
    "l02_session_labels",
    """SELECT account_id, CAST(CASE WHEN avg_daily_balance < p33 THEN 0.4 ELSE 0.0 END + CASE WHEN max_drawdown_pct > 0.3 THEN 0.3 ELSE 0.0 END
        + CASE WHEN credit_debit_ratio < 0.8 THEN 0.2 ELSE 0.0 END + CASE WHEN large_tx_pct > 0.3 THEN 0.1 ELSE 0.0 END > 0.35 AS INTEGER) AS risk_label,
      round(greatest(20.0, least(99.0, 50 + greatest(-1.0, least(1.0, (monthly_credit - monthly_debit) / greatest(monthly_credit, 1.0))) * 40)), 6) AS cashflow_score,
      round(greatest(20.0, least(99.0, 70 * (1 - balance_volatility / 3.0) * greatest(0.0, least(1.0, avg_daily_balance / CASE WHEN p90 <> 0 THEN p90 ELSE 1 END)) + 20)), 6) AS balance_score
    FROM x_feat, (SELECT quantile_cont(avg_daily_balance, 0.33) AS p33, quantile_cont(avg_daily_balance, 0.9) AS p90 FROM x_feat)""",
)
def session(spark, sf_dir):
    out = labels.session_labels(stage(features.session_features(cleaned(spark, sf_dir))))
    return out.select("account_id", "risk_label", *[F.round(c, 6).alias(c) for c in ("cashflow_score", "balance_score")])


def payment_features(spark, sf_dir):
    return shared(spark, sf_dir, "upi_features", lambda: upi.model_features(upi.analysis(payments(spark, sf_dir))))


_PAYMENT_SQL = """SELECT account_id, CASE WHEN risk < 0.25 THEN 'LOW' WHEN risk < 0.55 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band, round_even(greatest(0.0, least(100.0, success_ratio * 100 - failed_ratio * 30)), 1) AS reliability,
      CASE WHEN share >= 0.4 AND daily_avg_transactions >= 0.1 THEN 'REGULAR' ELSE 'IRREGULAR' END AS behaviour,
      round_even(greatest(0.0, least(100.0, 100 * (0.35 * least(unique_payees + unique_payers, 20) / 20 + 0.35 * least(span_months, 12) / 12 + 0.30 * share))), 1) AS stability
    FROM (SELECT *, 0.30 * failed_ratio + 0.30 * (high_risk_mcc_spend_pct / 100) + CASE WHEN unique_payees < 2 THEN 0.20 ELSE 0.0 END + CASE WHEN span_months < 3 THEN 0.20 ELSE 0.0 END AS risk,
        least(1.0, recurring_payee_count / greatest(unique_payees, 1)) AS share FROM x_upi_analysis)"""


@query(
    "l03_payment_targets",
    _PAYMENT_SQL,
)
def payment_targets(spark, sf_dir):
    return labels.payment_targets(payment_features(spark, sf_dir)).select(
        "account_id", "risk_band", "reliability", "behaviour", "stability"
    )


def utility_features(spark, sf_dir):
    build = lambda: bbps.model_features(bbps.analysis(bbps.by_type(bank(spark, sf_dir))))
    return shared(spark, sf_dir, "bbps_features", build)


@query(
    "b28_bbps_model_features",
    "SELECT account_id, CAST(utility_accounts AS DOUBLE) AS utility_accounts, CAST(payments_last_12m AS DOUBLE) AS payments_count, CAST(span_months AS DOUBLE) AS span_months, "
    "on_time_payment_ratio, CAST(missed_payment_count AS DOUBLE) AS missed_payment_count, average_bill_amount, "
    + ", ".join(f"CAST(has_{k.lower()} AS DOUBLE) AS has_{k.lower()}" for k in fixed.UTILITY_PATTERNS)
    + ", CAST(recurring_types AS DOUBLE) AS recurring_type_count FROM x_bill_analysis",
)
def bbps_features(spark, sf_dir):
    return utility_features(spark, sf_dir)


_UTILITY_SQL = """SELECT account_id, CASE WHEN risk < 0.25 THEN 'LOW' WHEN risk < 0.55 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band,
      round_even(greatest(0.0, least(100.0, 100 - (0.7 * (1 - on_time_payment_ratio) + 0.3 * missed) * 100)), 1) AS discipline,
      CASE WHEN share >= 0.5 AND least(2.0, payments_last_12m / greatest(span_months * greatest(recurring_types, 1), 1)) >= 0.5 THEN 'REGULAR' ELSE 'IRREGULAR' END AS behaviour,
      round_even(greatest(0.0, least(100.0, 100 * (0.5 * least(utility_accounts, 4) / 4 + 0.3 * least(span_months, 12) / 12 + 0.2 * share))), 1) AS stability
    FROM (SELECT *, greatest(0.0, least(1.0, 0.35 * (1 - on_time_payment_ratio) + 0.25 * missed + CASE WHEN utility_accounts < 2 THEN 0.15 ELSE 0.0 END + 0.15 * (1 - share) + CASE WHEN span_months < 3 THEN 0.10 ELSE 0.0 END)) AS risk
      FROM (SELECT *, least(1.0, missed_payment_count / 5) AS missed, least(1.0, recurring_types / greatest(utility_accounts, 1)) AS share FROM x_bill_analysis))"""


@query(
    "l04_utility_targets",
    _UTILITY_SQL,
)
def utility_targets(spark, sf_dir):
    return labels.utility_targets(utility_features(spark, sf_dir)).select(
        "account_id", "risk_band", "discipline", "behaviour", "stability"
    )


def _decision_sql(domain: str, final, targets: str) -> str:
    oracle.block(
        f"x_{domain}_all",
        f"""SELECT account_id, rule_id, status, serious, false AS gate FROM x_{domain}_rules UNION ALL
        SELECT account_id, '{final[0]}', CASE WHEN passed + failed = 0 THEN 'SKIP' WHEN failed <= 2 THEN 'PASS' ELSE 'FAIL' END, true, false FROM x_{domain}_tally""",
    )
    oracle.block(f"x_{domain}_total", oracle.tally_sql(f"x_{domain}_all"))
    oracle.block(f"x_{domain}_targets", targets)
    return f"""SELECT account_id, passed, failed, skipped, serious_fails, CASE WHEN serious_fails > 0 THEN 'REJECTED' WHEN failed > 0 OR risk_band = 'HIGH' THEN 'CONDITIONAL APPROVAL'
      WHEN risk_band = 'LOW' AND stability >= 70 THEN 'APPROVED' ELSE 'APPROVED WITH NOTES' END AS decision FROM x_{domain}_total JOIN x_{domain}_targets USING (account_id)"""


def _decided(analysis, rulelist, final, targets):
    """Rule results with the closing rule, decided on the risk band and stability targets."""
    results = rules.with_final_signal(rules.evaluate(analysis, rulelist), final)
    scored = targets.select("account_id", F.col("risk_band").alias("risk_label"), "stability")
    out = rules.head_decision(results, scored)
    return out.select("account_id", "passed", "failed", "skipped", "serious_fails", "decision")


@query("k08_upi_decision", _decision_sql("upi", rulebook.UPI_FINAL, _PAYMENT_SQL))
def upi_decision(spark, sf_dir):
    a = upi.analysis(payments(spark, sf_dir))
    return _decided(a, rulebook.UPI_RULES, rulebook.UPI_FINAL, labels.payment_targets(payment_features(spark, sf_dir)))


@query("k07_bbps_decision", _decision_sql("bbps", rulebook.BBPS_FINAL, _UTILITY_SQL))
def bbps_decision(spark, sf_dir):
    a = bbps.analysis(bbps.by_type(bank(spark, sf_dir)))
    return _decided(a, rulebook.BBPS_RULES, rulebook.BBPS_FINAL, labels.utility_targets(utility_features(spark, sf_dir)))


#: All model features of a payment row with an importance each, as a fitted head would give it.
_WEIGHTS = {
    "total_transactions": 0.04, "span_months": 0.08, "p2p_ratio": 0.03, "p2m_ratio": 0.02, "success_ratio": 0.18,
    "failed_ratio": 0.14, "unique_payees": 0.12, "unique_payers": 0.06, "recurring_payee_count": 0.05, "daily_avg_transactions": 0.07,
    "weekend_spend_pct": 0.01, "avg_ticket_size": 0.09, "high_risk_mcc_spend_pct": 0.06, "p2p_debit_velocity": 0.03, "p2p_credit_velocity": 0.02,
}


@query(
    "e15_f02_top_factors",
    """SELECT account_id, rk, feature, round_even(value, 4) AS value, round_even(z, 2) AS z FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(z) * (w + 1e-9) DESC, ord) AS rk FROM (
      """
    + " UNION ALL ".join(
        f"""SELECT account_id, {i} AS ord, '{n}' AS feature, x AS value, (x - avg(x) OVER ()) / coalesce(nullif(stddev_samp(x) OVER (), 0), 1) AS z, {w} AS w
            FROM (SELECT account_id, coalesce(CAST({n} AS DOUBLE), 0) AS x FROM x_upi_analysis)"""
        for i, (n, w) in enumerate(_WEIGHTS.items())
    )
    + ")) WHERE rk <= 6",
)
def factors(spark, sf_dir):
    return heads.top_factors(payment_features(spark, sf_dir), "account_id", _WEIGHTS)


@query(
    "c15_zero_filled_features",
    "SELECT account_id, "
    + ", ".join(f"round(coalesce(nullif({n}, 0), avg({n}) OVER ()), 6) AS {n}" for n in _WEIGHTS)
    + " FROM (SELECT account_id, "
    + ", ".join(f"coalesce(CAST({n} AS DOUBLE), 0) AS {n}" for n in _WEIGHTS)
    + " FROM x_upi_analysis)",
)
def zero_filled(spark, sf_dir):
    names = list(_WEIGHTS)
    out = heads.zero_filled(payment_features(spark, sf_dir), "account_id", names)
    return out.select("account_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "l08_regression_metrics",
    """SELECT fold, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg((y - p) * (y - p)), 2) AS mse, round(avg(abs(y - p)), 4) AS mae,
      round(count(*) FILTER (y > 30000 AND p > 30000) / count(*) FILTER (p > 30000), 6) AS "precision", round(count(*) FILTER (y > 30000 AND p > 30000) / count(*) FILTER (y > 30000), 6) AS recall,
      round(2 * count(*) FILTER (y > 30000 AND p > 30000) / (count(*) FILTER (y > 30000) + count(*) FILTER (p > 30000)), 6) AS f1
    FROM (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p FROM lineitem) GROUP BY fold""",
)
def regression_metrics(spark, sf_dir):
    pred = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_extendedprice").alias("y"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"),
    )
    m = heads.regression_metrics(pred, 30000.0)
    digits = {"r2": 6, "mse": 2, "mae": 4, "precision": 6, "recall": 6, "f1": 6}
    return m.select("fold", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "l08_classification_metrics",
    """SELECT fold, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(coalesce(tp / nullif(claimed, 0), 0) * support) / sum(support), 6) AS "precision", round(sum(tp / support * support) / sum(support), 6) AS recall,
      round(sum(coalesce(2 * tp / (support + claimed), 0) * support) / sum(support), 6) AS f1 FROM
      (SELECT fold, y, count(*) AS support, count(*) FILTER (p = y) AS tp, any_value(c) AS claimed FROM
        (SELECT CAST(l_orderkey % 5 AS INTEGER) AS fold, CAST(l_quantity % 3 AS DOUBLE) AS y, CAST(l_linenumber % 3 AS DOUBLE) AS p FROM lineitem) t
        LEFT JOIN (SELECT CAST(l_orderkey % 5 AS INTEGER) AS f2, CAST(l_linenumber % 3 AS DOUBLE) AS p2, count(*) AS c FROM lineitem GROUP BY ALL) ON f2 = fold AND p2 = y GROUP BY fold, y) GROUP BY fold""",
)
def classification_metrics(spark, sf_dir):
    pred = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.col("l_quantity") % 3).cast("double").alias("y"),
        (F.col("l_linenumber") % 3).cast("double").alias("p"),
    )
    m = heads.classification_metrics(pred)
    return m.select("fold", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("l09_l11_payment_heads")
def payment_heads(spark, sf_dir):
    """Train the four payment heads and score every account with them."""
    f = payment_features(spark, sf_dir)
    t = stage(labels.payment_targets(f))
    parts = []
    for h in heads.heads_of("upi", [c for c in f.columns if c != "account_id"]):
        parts.append(heads.predict(heads.fit(t, h, "random_forest"), t, h, "account_id"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("l08_utility_cross_validation")
def utility_cv(spark, sf_dir):
    """Three-fold refit of the discipline head and its per-fold metrics."""
    t = stage(labels.utility_targets(utility_features(spark, sf_dir)))
    h = heads.heads_of("bbps", [c for c in utility_features(spark, sf_dir).columns if c != "account_id"])[1]
    pred = heads.cross_validate(t, h, "account_id", 3, "linear_regression")
    return heads.fold_status(heads.regression_metrics(pred, 50.0), "r2", 0.08)


@query("l07_isolation_forest")
def isolation_forest(spark, sf_dir):
    f = stage(features.session_features(cleaned(spark, sf_dir)))
    names = fixed.BASE_FEATURES
    model = isolation.fit(f, names, "account_id", trees=20)
    return isolation.flag(isolation.score(f, model, names)).select("account_id", "anomaly", "is_anomaly")
