"""Bank-statement queries: balances, vector, score, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import half_even
from ..operators import features, ledger, scoring
from ..sources import adapters
from ..staging import shared
from .registry import query


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged ledger with running balances, staged once for all its readers."""
    return shared(
        spark, sf_dir, "ledger", lambda: ledger.prepare(staged_txns(spark, sf_dir), adapters.accounts(spark, sf_dir))
    )


def staged_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "bank", lambda: adapters.bank_txn(spark, sf_dir))


@query(
    "e01_running_balance",
    "SELECT account_id, seq, round(running, 2) AS running FROM x_ledger",
)
def running(spark, sf_dir):
    led = ledger.running_balance(staged_txns(spark, sf_dir), adapters.accounts(spark, sf_dir))
    return led.select("account_id", "seq", F.round("running", 2).alias("running"))


@query(
    "e02_forward_fill",
    """SELECT account_id, seq, coalesce(balance, prev_balance) AS filled,
      balance IS NULL AND prev_balance IS NOT NULL AS imputed FROM x_anchored""",
)
def forward_fill(spark, sf_dir):
    rows = ledger.last_known(adapters.bank_txn(spark, sf_dir), "balance", before="p", upto="u")
    return rows.select(
        "account_id", "seq", F.coalesce("balance", "p").alias("filled"),
        (F.col("balance").isNull() & F.col("p").isNotNull()).alias("imputed"),
    )


@query(
    "d01_statement_summary",
    """SELECT account_id, count(*) AS transaction_count,
      round_even(coalesce(sum(amount) FILTER (txn_type = 'DEBIT'), 0.0), 2) AS total_debit,
      round_even(coalesce(sum(amount) FILTER (txn_type = 'CREDIT'), 0.0), 2) AS total_credit,
      arg_min(balance, seq) FILTER (balance IS NOT NULL) AS opening_balance,
      arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closing_balance,
      min(balance) AS min_balance, max(balance) AS max_balance
    FROM x_bank GROUP BY account_id""",
)
def summary(spark, sf_dir):
    return features.statement_summary(adapters.bank_txn(spark, sf_dir))


@query("d04_underwriting_vector", "SELECT * FROM x_vector")
def vector(spark, sf_dir):
    return features.underwriting_vector(prepared(spark, sf_dir)).drop("account_age_days")


@query(
    "d05_statement_months",
    """SELECT account_id, greatest(1.0, CASE WHEN count(txn_date) >= 2
        THEN round_even((datediff('day', min(txn_date), max(txn_date)) + 1) / 30.44, 2)
        ELSE round_even(count(*) / 30.0, 2) END) AS statement_months
    FROM x_bank GROUP BY account_id""",
)
def months(spark, sf_dir):
    return adapters.bank_txn(spark, sf_dir).groupBy("account_id").agg(
        features.statement_months(
            F.min("txn_date"), F.max("txn_date"), F.count("txn_date"), F.count(F.lit(1))
        ).alias("statement_months")
    )


@query(
    "d06_income_stability",
    "SELECT account_id, round(stability, 6) AS stability FROM x_stability",
)
def stability(spark, sf_dir):
    out = features.income_stability(adapters.bank_txn(spark, sf_dir))
    return out.select("account_id", F.round("stability", 6).alias("stability"))


SCORE_COLUMNS = [
    "account_id", "statement_months", "avg_monthly_inflow", "avg_monthly_debit", "nach_bounce_count_90d",
    "minimum_balance", "balance_volatility", "income_stability", "scorecard_score", "score", "pd",
    "grade_raw", "gate_passed", "grade", "decision",
]


def scores(led: DataFrame) -> DataFrame:
    return scoring.gated(scoring.credit_score(features.underwriting_vector(led)))


@query(
    "k01_k03_score_and_gate",
    f"SELECT {', '.join(SCORE_COLUMNS)} FROM x_score",
)
def score(spark, sf_dir):
    return scores(prepared(spark, sf_dir)).select(*SCORE_COLUMNS)


# ------------------------------------------------------------------ rule context


def context_of(spark: SparkSession, sf_dir: str):
    """(staged ledger, staged context) of every account."""
    from ..operators import context

    led = prepared(spark, sf_dir)
    scored = shared(spark, sf_dir, "scores", lambda: scores(led))
    return led, shared(spark, sf_dir, "context", lambda: context.rule_context(led, scored))


@query(
    "d07_monthly_flows",
    """SELECT account_id, month, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, rows,
      round(end_balance, 2) AS end_balance FROM x_monthly""",
)
def monthly(spark, sf_dir):
    from ..operators import context

    m = context.monthly_flows(prepared(spark, sf_dir))
    return m.select(
        "account_id", "month", "rows",
        *[F.round(c, 2).alias(c) for c in ("inflow", "outflow", "end_balance")],
    )


@query(
    "e10_e11_month_shape",
    """SELECT account_id, n_months, round(inflow_mean, 4) AS inflow_mean, round(inflow_cv, 6) AS inflow_cv,
      zero_inflow_months, deficit_months, round(growth, 6) AS growth, balance_declining, dormant,
      active_every_month, activity_spike FROM x_shape""",
)
def shape(spark, sf_dir):
    from ..operators import context

    s = context.month_shape(context.monthly_flows(prepared(spark, sf_dir)))
    return s.withColumns(
        {"inflow_mean": F.round("inflow_mean", 4), "inflow_cv": F.round("inflow_cv", 6), "growth": F.round("growth", 6)}
    )


@query("c01_money_in_out", "SELECT account_id, count(*) AS hits FROM x_inout GROUP BY 1")
def in_out(spark, sf_dir):
    from ..operators import context

    led = prepared(spark, sf_dir)
    hits = context.money_in_out(led, features.underwriting_vector(led))
    return hits.groupBy("account_id").agg(F.count(F.lit(1)).alias("hits"))


@query("c02_rapid_duplicates", "SELECT account_id, count(*) AS hits FROM x_rapid GROUP BY 1")
def rapid(spark, sf_dir):
    from ..operators import context

    hits = context.rapid_duplicates(ledger.tagged(staged_txns(spark, sf_dir)))
    return hits.groupBy("account_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "d09_counterparty_concentration",
    """SELECT account_id, unique_payees, repeat_payees, round(top1, 2) AS top1, round(top3, 2) AS top3,
      round(top5, 2) AS top5, round(top_supplier, 2) AS top_supplier FROM x_conc""",
)
def concentration(spark, sf_dir):
    from ..operators import context

    out = context.counterparties(ledger.tagged(adapters.bank_txn(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 2) for c in ("top1", "top3", "top5", "top_supplier")})


CONTEXT_INTS = [
    "n_txns", "n_credits", "neg_points", "low_bal_points", "emi_txn_count", "gst_count", "tax_count", "rent_count",
    "util_count", "salary_in_count", "upi_credit_count", "cash_wd_count", "reversal_count", "bounce_count",
    "round_credits", "structuring_credits", "emi_lenders", "emi_months", "n_months", "zero_inflow_months",
    "deficit_months", "unique_payees", "repeat_payees", "same_day_inout", "rapid_dup", "balance_declining",
    "dormant", "is_salaried",
]
CONTEXT_DOUBLES = [
    "total_credit", "total_debit", "largest_credit", "avg_bal", "min_bal", "upi_credit_amt", "cash_deposit_amt",
    "inflow_cv", "growth", "monthly_emi", "monthly_gst", "monthly_rent", "fixed_burden", "fixed_burden_ratio",
    "largest_credit_pct", "top1_share", "top3_share", "top5_share", "top_supplier_share", "same_day_ratio",
    "cash_deposit_ratio", "expense_ratio", "tx_per_month", "emi_burden",
]


@query(
    "d08_k09_rule_context",
    f"SELECT account_id, {', '.join(CONTEXT_INTS)}, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in CONTEXT_DOUBLES)
    + " FROM x_context",
)
def rule_context(spark, sf_dir):
    _, ctx = context_of(spark, sf_dir)
    return ctx.select("account_id", *CONTEXT_INTS, *[F.round(c, 4).alias(c) for c in CONTEXT_DOUBLES])
