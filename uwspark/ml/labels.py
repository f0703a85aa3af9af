"""Weak labels: documented formulas over real feature rows, without random noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import clip, half_even
from ..operators import scale


def _val(df: DataFrame, name: str, default: float = 0.5) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).try_cast("double"), F.lit(default))


def statement_to_population(vector: DataFrame) -> DataFrame:
    """Underwriting vector -> the 0..1 columns of the population table."""
    low = F.col("minimum_balance")
    inflow = F.col("avg_monthly_inflow")
    return vector.select(
        "account_id",
        F.least(F.lit(1.0), F.col("nach_bounce_count_90d") / 3.0).alias("bounce_count"),
        F.when(low < 0, 1.0).otherwise(0.0).alias("overdraft_count"),
        F.when(low < 0, 1.0).when(low < 10000, clip((10000 - low) / 10000, 0.0, 1.0)).otherwise(0.0).alias("negative_balance_days"),
        F.col("income_stability").alias("income_consistency_score"),
        (0.5 + 0.5 * F.col("income_stability")).alias("credit_regularity_score"),
        clip(0.55 - F.col("balance_volatility") * 0.4, 0.0, 1.0).alias("cash_flow_stability_score"),
        clip((inflow - F.col("avg_monthly_debit")) / F.greatest(inflow, F.lit(1.0)) + 0.15, 0.0, 1.0).alias("monthly_net_cash_flow"),
        clip((F.col("foir_ratio") / 100 - 1.0) * 0.3 + 0.15, 0.0, 0.30).alias("emi_to_credit_ratio"),
        clip(F.col("foir_ratio") / 250, 0.05, 0.48).alias("existing_debt_burden"),
        F.least(F.lit(1.0), F.col("cash_withdrawal_ratio") * 3).alias("cash_withdrawal_amount"),
        F.when(F.col("dscr_ratio") < 1, clip("dscr_ratio", 0.95, 1.0)).otherwise(1.0).alias("credit_debit_ratio"),
    )


def filled_from_means(row: DataFrame, means: DataFrame) -> DataFrame:
    """Columns the row cannot derive come from the one-row table of training means."""
    have = set(row.columns)
    m = means.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_m_{c}") for c in means.columns])
    j = row.withColumn("_one", F.lit(1)).join(F.broadcast(m), "_one")
    return j.select(
        "account_id",
        *[F.coalesce(c, f"_m_{c}").alias(c) if c in have else F.col(f"_m_{c}").alias(c) for c in means.columns],
    )


def policy_labels(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Risk in 0..1, label 1 above its 55th percentile, score 900 - 620 * risk."""
    v = lambda n, d=0.5: _val(df, n, d)
    risk = (
        0.24 * v("bounce_count") + 0.18 * v("overdraft_count") + 0.18 * v("negative_balance_days")
        + 0.12 * clip(v("emi_to_credit_ratio", 0.15) / 0.30, 0.0, 1.0)
        + 0.10 * clip(v("existing_debt_burden", 0.25) / 0.50, 0.0, 1.0)
        + 0.10 * (1 - v("income_consistency_score", 0.75))
        + 0.08 * (1 - clip((v("cash_flow_stability_score", 0.52) - 0.39) / 0.27, 0.0, 1.0))
        - 0.12 * clip(v("monthly_net_cash_flow", 0.15) / 0.30, 0.0, 1.0)
    )
    if "account_status" in df.columns:
        risk = risk + F.when(F.upper("account_status") == "DORMANT", 0.05).otherwise(0.0)
    t = df.withColumn("risk", half_even(clip(risk, 0.0, 1.0), 9)).withColumn("_all", F.lit(1))
    cut = scale.exact_percentiles(scale.value_counts(t, ["_all"], "risk"), ["_all"], {"cut": 0.55})
    return t.join(F.broadcast(cut), "_all").select(
        *[c for c in df.columns], "risk",
        (F.col("risk") > F.col("cut")).cast("int").alias("label"),
        half_even(clip(900 - F.col("risk") * 620, 300.0, 900.0)).alias("score"),
    )


def session_labels(feats: DataFrame) -> DataFrame:
    """Risk label, cash-flow score and balance score from the nine session features."""
    t = feats.withColumn("_all", F.lit(1))
    cut = scale.exact_percentiles(
        scale.value_counts(t, ["_all"], "avg_daily_balance"), ["_all"], {"p33": 0.33, "p90": 0.90}
    )
    t = t.join(F.broadcast(cut), "_all")
    risk = (
        F.when(F.col("avg_daily_balance") < F.col("p33"), 0.4).otherwise(0.0)
        + F.when(F.col("max_drawdown_pct") > 0.3, 0.3).otherwise(0.0)
        + F.when(F.col("credit_debit_ratio") < 0.8, 0.2).otherwise(0.0)
        + F.when(F.col("large_tx_pct") > 0.3, 0.1).otherwise(0.0)
    )
    surplus = clip((F.col("monthly_credit") - F.col("monthly_debit")) / F.greatest("monthly_credit", F.lit(1.0)), -1.0, 1.0)
    norm = clip(F.col("avg_daily_balance") / F.when(F.col("p90") != 0, F.col("p90")).otherwise(1.0), 0.0, 1.0)
    return t.select(
        *feats.columns,
        (risk > 0.35).cast("int").alias("risk_label"),
        clip(50 + surplus * 40, 20.0, 99.0).alias("cashflow_score"),
        clip(70 * (1 - F.col("balance_volatility") / 3.0) * norm + 20, 20.0, 99.0).alias("balance_score"),
    )


def _band(risk: Column) -> Column:
    return F.when(risk < 0.25, "LOW").when(risk < 0.55, "MEDIUM").otherwise("HIGH")


def payment_targets(f: DataFrame) -> DataFrame:
    """Risk band, reliability, behaviour and stability of a payment feature row."""
    failed = clip(_val(f, "failed_ratio", 0.0), 0.0, 1.0)
    success = clip(_val(f, "success_ratio", 1.0), 0.0, 1.0)
    risky = clip(_val(f, "high_risk_mcc_spend_pct", 0.0), 0.0, 100.0)
    payees, payers = _val(f, "unique_payees", 0.0), _val(f, "unique_payers", 0.0)
    span = F.greatest(_val(f, "span_months", 1.0), F.lit(1.0))
    share = clip(_val(f, "recurring_payee_count", 0.0) / F.greatest(payees, F.lit(1.0)), 0.0, 1.0)
    risk = clip(
        0.30 * failed + 0.30 * (risky / 100) + F.when(payees < 2, 0.20).otherwise(0.0) + F.when(span < 3, 0.20).otherwise(0.0),
        0.0, 1.0,
    )
    stability = 100 * (
        0.35 * F.least(payees + payers, F.lit(20.0)) / 20 + 0.35 * F.least(span, F.lit(12.0)) / 12 + 0.30 * share
    )
    regular = (share >= 0.4) & (_val(f, "daily_avg_transactions", 0.0) >= 0.1)
    return f.withColumns(
        {
            "risk_band": _band(risk),
            "reliability": half_even(clip(success * 100 - failed * 30, 0.0, 100.0), 1),
            "behaviour": F.when(regular, "REGULAR").otherwise("IRREGULAR"),
            "stability": half_even(clip(stability, 0.0, 100.0), 1),
        }
    )


def utility_targets(f: DataFrame) -> DataFrame:
    """Risk band, discipline, behaviour and stability of a utility-bill feature row."""
    on_time = clip(_val(f, "on_time_payment_ratio", 0.5), 0.0, 1.0)
    missed = clip(F.greatest(_val(f, "missed_payment_count", 0.0), F.lit(0.0)) / 5, 0.0, 1.0)
    accounts, recurring = _val(f, "utility_accounts", 0.0), _val(f, "recurring_type_count", 0.0)
    span = F.greatest(_val(f, "span_months", 1.0), F.lit(1.0))
    share = clip(recurring / F.greatest(accounts, F.lit(1.0)), 0.0, 1.0)
    risk = clip(
        0.35 * (1 - on_time) + 0.25 * missed + F.when(accounts < 2, 0.15).otherwise(0.0) + 0.15 * (1 - share)
        + F.when(span < 3, 0.10).otherwise(0.0),
        0.0, 1.0,
    )
    cadence = clip(
        _val(f, "payments_count", 0.0) / F.greatest(span * F.greatest(recurring, F.lit(1.0)), F.lit(1.0)), 0.0, 2.0
    )
    stability = 100 * (0.5 * F.least(accounts, F.lit(4.0)) / 4 + 0.3 * F.least(span, F.lit(12.0)) / 12 + 0.2 * share)
    return f.withColumns(
        {
            "risk_band": _band(risk),
            "discipline": half_even(clip(100 - (0.7 * (1 - on_time) + 0.3 * missed) * 100, 0.0, 100.0), 1),
            "behaviour": F.when((share >= 0.5) & (cadence >= 0.5), "REGULAR").otherwise("IRREGULAR"),
            "stability": half_even(clip(stability, 0.0, 100.0), 1),
        }
    )


def version_log(orders: DataFrame) -> DataFrame:
    """Orders as a log of model versions: the customer is the model, its orders in time are the versions."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    part = lambda n: (F.col("o_orderkey") % (n + 1)) / float(n)
    return orders.select(
        F.col("o_custkey").alias("domain"),
        F.row_number().over(w).cast("bigint").alias("version"),
        part(100).alias("accuracy"),
        part(96).alias("f1"),
        part(88).alias("r2"),
        (0.9 + (F.col("o_orderkey") % 11) / 100.0).alias("golden"),
    )
