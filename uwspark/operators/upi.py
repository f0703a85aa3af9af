"""Mobile-payment signals and fraud metrics per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.columns import count_if, half_even, money_sum, month_of, ratio
from . import scale
from .features import is_credit, is_debit


def dated(txns: DataFrame) -> DataFrame:
    return txns.where("txn_date is not null and amount is not null")


def _p2m() -> "F.Column":
    return F.col("mode") == "P2M"


def _p2p() -> "F.Column":
    return F.col("mode") == "P2P"


def risky_mcc():
    return F.coalesce(F.col("mcc").isin(fixed.HIGH_RISK_MCC), F.lit(False))


def analysis(txns: DataFrame) -> DataFrame:
    """The 19 signals of one account's payment log, one row per account."""
    t = dated(txns).withColumn("month", month_of("txn_date"))
    weekend = F.weekday("txn_date") >= 5
    base = t.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("txn_date").alias("d0"),
        F.max("txn_date").alias("d1"),
        count_if(_p2p()).alias("p2p_count"),
        count_if(_p2m()).alias("p2m_count"),
        count_if(F.col("status") == "SUCCESS").alias("ok"),
        count_if(F.col("status") == "FAILED").alias("failed_count"),
        half_even(F.sum("amount"), 2).alias("amt"),
        money_sum(_p2m() & is_debit()).alias("merchant"),
        money_sum(_p2m() & is_debit() & weekend).alias("weekend"),
        money_sum(_p2m() & is_debit() & risky_mcc()).alias("risky"),
        half_even(money_sum(_p2p() & is_debit()), 2).alias("lent"),
        half_even(money_sum(_p2p() & is_credit()), 2).alias("borrowed"),
    )
    days = (
        t.groupBy("account_id", "month", "txn_date").agg(F.count(F.lit(1)).alias("x"))
        .groupBy("account_id").agg(F.max("x").alias("peak"), F.countDistinct("month").alias("span_months"))
    )
    payee = (
        t.where(is_debit() & (F.coalesce("payee_vpa", F.lit("")) != ""))
        .select("account_id", "payee_vpa", "month").distinct()
        .groupBy("account_id", "payee_vpa").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("unique_payees"), count_if(F.col("m") >= 2).alias("recurring_payee_count"))
    )
    payer = (
        t.where(is_credit() & (F.coalesce("payer_vpa", F.lit("")) != ""))
        .select("account_id", "payer_vpa").distinct()
        .groupBy("account_id").agg(F.count(F.lit(1)).alias("unique_payers"))
    )
    j = (
        base.join(days, "account_id").join(payee, "account_id", "left").join(payer, "account_id", "left")
        .na.fill(0, ["unique_payees", "recurring_payee_count", "unique_payers"])
    )
    n = F.col("n")
    return j.select(
        "account_id",
        F.lit(True).alias("available"),
        "span_months",
        n.alias("total_transactions"),
        "p2p_count", "p2m_count",
        half_even(F.col("p2p_count") / n, 4).alias("p2p_ratio"),
        half_even(F.col("p2m_count") / n, 4).alias("p2m_ratio"),
        half_even(F.col("ok") / n, 4).alias("success_ratio"),
        half_even(F.col("failed_count") / n, 4).alias("failed_ratio"),
        "failed_count", "unique_payees", "unique_payers", "recurring_payee_count",
        half_even(n / (F.datediff("d1", "d0") + 1), 3).alias("daily_avg_transactions"),
        F.col("peak").alias("peak_day_transaction_count"),
        half_even(ratio("weekend", "merchant") * 100, 1).alias("weekend_spend_pct"),
        half_even(F.col("amt") / n, 2).alias("avg_ticket_size"),
        half_even(ratio("risky", "merchant") * 100, 1).alias("high_risk_mcc_spend_pct"),
        half_even(F.col("lent") / F.col("span_months"), 2).alias("p2p_debit_velocity"),
        half_even(F.col("borrowed") / F.col("span_months"), 2).alias("p2p_credit_velocity"),
    )


def spend_by_mcc(txns: DataFrame) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in fixed.MCC_LABELS.items() for x in kv])
    g = dated(txns).where(_p2m()).groupBy("account_id", F.coalesce("mcc", F.lit("OTHER")).alias("mcc")).agg(
        F.count(F.lit(1)).alias("payment_count"), half_even(F.sum("amount"), 2).alias("total_amount")
    )
    return g.select(
        "account_id", "mcc", F.coalesce(F.try_element_at(label, F.col("mcc")), F.lit("Other")).alias("label"),
        "payment_count", "total_amount", risky_mcc().alias("high_risk"),
    )


def pass_through(txns: DataFrame) -> DataFrame:
    """Credits followed within two days by a debit of a similar amount (under 15 % apart)."""
    rows = dated(txns).select("account_id", "seq", "blk", "txn_date", "amount", "txn_type")
    # Amounts in one log bucket are within 14 % of each other; two buckets on each side cover 15 %.
    bucket = F.when(F.col("amount") > 0, F.floor(F.ln("amount") / F.ln(F.lit(1.14)))).otherwise(-1000000)
    return scale.later_partner(
        rows,
        ["account_id"],
        is_query=is_credit() & (F.col("amount") > 0),
        is_provider=is_debit() & (F.col("amount") > 0),
        bucket=bucket,
        reach=2,
        accept=lambda cand, own: F.abs(cand - own) / own < 0.15,
    )


def fraud_metrics(txns: DataFrame) -> DataFrame:
    t = dated(txns)
    amt = F.col("amount")
    just_under = (
        ((amt >= 1800) & (amt < 2000)) | ((amt >= 9000) & (amt < 10000)) | ((amt >= 45000) & (amt < 50000))
    )
    base = t.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"),
        money_sum(_p2m() & is_debit()).alias("merchant"),
        money_sum(_p2m() & is_debit() & risky_mcc()).alias("risky"),
        count_if(_p2p() & is_debit() & just_under).alias("structuring_count"),
        money_sum(_p2p() & is_debit()).alias("p2p"),
        count_if(F.col("status") == "FAILED").alias("failed"),
        count_if((amt != 0) & (amt % 500 == 0)).alias("round_n"),
    )
    top = (
        t.where(_p2p() & is_debit())
        .groupBy("account_id", F.coalesce("payee_vpa", F.lit("unknown")).alias("payee"))
        .agg(F.sum("amount").alias("x")).groupBy("account_id").agg(F.max("x").alias("top"))
    )
    days = (
        t.groupBy("account_id", "txn_date").agg(F.count(F.lit(1)).alias("x"))
        .groupBy("account_id").agg(F.max("x").alias("peak"), F.avg("x").alias("mean"))
    )
    rapid = pass_through(txns).groupBy("account_id").agg(F.count(F.lit(1)).alias("rapid"))
    j = (
        base.join(days, "account_id").join(top, "account_id", "left").join(rapid, "account_id", "left")
        .na.fill(0, ["top", "rapid"])
    )
    or_one = lambda c: F.when(F.col(c) != 0, F.col(c)).otherwise(1.0)
    return j.select(
        "account_id",
        F.col("rapid").cast("double").alias("rapid_pass_through_count"),
        half_even(F.col("risky") / or_one("merchant") * 100, 1).alias("high_risk_mcc_spend_pct"),
        F.col("structuring_count").cast("double").alias("structuring_count"),
        half_even(F.col("top") / or_one("p2p") * 100, 1).alias("single_counterparty_dominance_pct"),
        half_even(F.col("peak") / F.col("mean"), 2).alias("sudden_spike_ratio"),
        half_even(F.col("failed") / F.col("n"), 4).alias("failed_ratio"),
        half_even(F.col("round_n") / F.col("n"), 4).alias("round_amount_ratio"),
    )


def model_features(a: DataFrame) -> DataFrame:
    """The 15 numeric model features of an analysis row."""
    names = [
        "total_transactions", "span_months", "p2p_ratio", "p2m_ratio", "success_ratio", "failed_ratio",
        "unique_payees", "unique_payers", "recurring_payee_count", "daily_avg_transactions", "weekend_spend_pct",
        "avg_ticket_size", "high_risk_mcc_spend_pct", "p2p_debit_velocity", "p2p_credit_velocity",
    ]
    return a.select("account_id", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
