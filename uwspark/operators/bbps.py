"""Utility-bill analysis of bank statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.columns import clip, count_if, half_even, month_of, ratio, utility_type
from .features import is_debit

KINDS = [*fixed.UTILITY_PATTERNS, "OTHER_BBPS"]


def utility_rows(txns: DataFrame) -> DataFrame:
    """Debits that look like a bill payment, with their utility type."""
    return (
        txns.where(is_debit() & F.col("amount").isNotNull())
        .withColumn("utility_type", utility_type("narration"))
        .where("utility_type is not null")
    )


def by_type(txns: DataFrame) -> DataFrame:
    """Per account and type: payments, months paid and missed, averages.

    The span is counted over all dated rows of the account, not only the bills.
    """
    span = (
        txns.where("txn_date is not null").select("account_id", month_of("txn_date").alias("m")).distinct()
        .groupBy("account_id").agg(F.count(F.lit(1)).alias("span"))
    )
    bills = utility_rows(txns)
    months = (
        bills.where("txn_date is not null")
        .select("account_id", "utility_type", month_of("txn_date").alias("m")).distinct()
        .groupBy("account_id", "utility_type").agg(F.count(F.lit(1)).alias("months_paid"))
    )
    g = bills.groupBy("account_id", "utility_type").agg(
        F.count(F.lit(1)).alias("payment_count"), half_even(F.sum("amount"), 2).alias("paid")
    )
    j = (
        g.join(months, ["account_id", "utility_type"], "left").join(span, "account_id", "left")
        .na.fill(0, ["months_paid"]).na.fill(1, ["span"])
    )
    recurring = F.col("months_paid") >= 2
    expected = F.when(recurring, F.col("span")).otherwise(F.col("months_paid"))
    return j.select(
        "account_id", "utility_type", "payment_count", "months_paid",
        F.greatest(F.lit(0), expected - F.col("months_paid")).cast("bigint").alias("missed_months"),
        half_even(F.col("paid") / F.col("payment_count"), 2).alias("average_bill_amount"),
        half_even("paid", 2).alias("total_paid"),
        recurring.alias("recurring"),
        expected.cast("bigint").alias("expected_months"),
        F.col("span").alias("span_months"),
        F.col("paid").alias("_paid"),
    )


def analysis(types: DataFrame) -> DataFrame:
    """One row per account with bills, from the per-type table."""
    g = types.groupBy("account_id").agg(
        F.max("span_months").alias("span_months"),
        F.count(F.lit(1)).alias("utility_accounts"),
        F.sum("payment_count").alias("payments_last_12m"),
        F.sum("months_paid").alias("mp"),
        F.sum("expected_months").alias("me"),
        F.sum("missed_months").alias("missed_payment_count"),
        half_even(F.sum("_paid"), 2).alias("paid"),
        count_if(F.col("recurring")).alias("recurring_types"),
        *[F.max(F.col("utility_type") == k).alias(f"has_{k.lower()}") for k in KINDS],
    )
    on_time = F.when(F.col("me") != 0, half_even(F.col("mp") / F.col("me"), 4)).otherwise(1.0)
    g = g.withColumn("on_time_payment_ratio", on_time)
    index = clip(
        F.col("on_time_payment_ratio") * 100 - F.greatest(F.lit(0), F.col("missed_payment_count") - 1) * 5, 0.0, 100.0
    )
    return g.select(
        "account_id", F.lit(True).alias("available"), "span_months", "utility_accounts", "payments_last_12m",
        "on_time_payment_ratio", "missed_payment_count",
        half_even(F.col("paid") / F.col("payments_last_12m"), 2).alias("average_bill_amount"),
        half_even(index, 1).alias("punctuality_index"), "recurring_types",
        *[f"has_{k.lower()}" for k in KINDS],
    )


def repeats(bills: DataFrame) -> DataFrame:
    """Duplicate payments (same type and rounded amount) and repeats inside five days.

    Equal dates are counted first, so the window runs over distinct days only.
    """
    days = (
        bills.where("txn_date is not null")
        .groupBy("account_id", "utility_type", half_even("amount").alias("a"), "txn_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = W.partitionBy("account_id", "utility_type", "a").orderBy("txn_date")
    near = F.coalesce((F.datediff("txn_date", F.lag("txn_date").over(w)) < 5).cast("int"), F.lit(0))
    return (
        days.withColumn("near", near)
        .groupBy("account_id", "utility_type", "a")
        .agg((F.sum("n") - 1).alias("dup"), F.sum(F.col("n") - 1 + F.col("near")).alias("rapid"))
        .groupBy("account_id")
        .agg(F.sum("dup").alias("dup"), F.sum("rapid").alias("rapid"))
    )


def fraud_metrics(txns: DataFrame, types: DataFrame, summary: DataFrame) -> DataFrame:
    bills = utility_rows(txns)
    # The largest bill per type decides the spike, so no bill is joined to its average.
    per_type = bills.groupBy("account_id", "utility_type").agg(
        F.max("amount").alias("top"), F.count(F.lit(1)).alias("n"),
        count_if((F.col("amount") > 0) & (F.col("amount") % 500 == 0)).alias("round_n"),
    )
    g = (
        per_type.join(types, ["account_id", "utility_type"])
        .groupBy("account_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum("round_n").alias("round_n"),
            F.sum(F.when(F.col("utility_type") == "OTHER_BBPS", F.col("n")).otherwise(0)).alias("other_n"),
            F.max(F.when(F.col("average_bill_amount") > 0, F.col("top") / F.col("average_bill_amount"))).alias("spike"),
            F.sum("total_paid").alias("total"),
            F.max("total_paid").alias("best"),
        )
    )
    j = g.join(repeats(bills), "account_id", "left").join(
        summary.select("account_id", "missed_payment_count"), "account_id"
    ).na.fill(0, ["dup", "rapid", "spike"])
    return j.select(
        "account_id",
        F.col("dup").cast("double").alias("duplicate_payment_count"),
        F.col("rapid").cast("double").alias("rapid_repeat_count"),
        half_even("spike", 2).alias("bill_spike_ratio"),
        half_even(ratio("best", "total") * 100, 1).alias("single_utility_dominance_pct"),
        half_even(F.col("round_n") / F.col("n"), 3).alias("round_amount_ratio"),
        half_even(F.col("other_n") / F.col("n"), 3).alias("vague_narration_ratio"),
        F.col("missed_payment_count").cast("double").alias("missed_payment_count"),
    )


def missing_periods(txns: DataFrame) -> DataFrame:
    """Calendar months of the statement in which a recurring utility was not paid."""
    span = txns.where("txn_date is not null").select("account_id", month_of("txn_date").alias("month")).distinct()
    bills = utility_rows(txns).where("txn_date is not null").select(
        "account_id", "utility_type", month_of("txn_date").alias("month")
    ).distinct()
    recurring = bills.groupBy("account_id", "utility_type").agg(F.count(F.lit(1)).alias("m")).where("m >= 2")
    # Months x types of one account: both sides are calendar- and catalogue-sized.
    expected = recurring.drop("m").join(span, "account_id")
    return expected.join(bills, ["account_id", "utility_type", "month"], "left_anti")


def model_features(a: DataFrame) -> DataFrame:
    """The 12 numeric model features of an analysis row, with the has_* flags as 0/1."""
    names = {
        "utility_accounts": "utility_accounts", "payments_count": "payments_last_12m", "span_months": "span_months",
        "on_time_payment_ratio": "on_time_payment_ratio", "missed_payment_count": "missed_payment_count",
        "average_bill_amount": "average_bill_amount", **{f"has_{k.lower()}": f"has_{k.lower()}" for k in fixed.UTILITY_PATTERNS},
        "recurring_type_count": "recurring_types",
    }
    return a.select("account_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in names.items()])


def impute_bulk(table: DataFrame, means: DataFrame) -> DataFrame:
    """Bulk per-customer table: required fields checked, the rest filled from corpus means.

    `means` is one row, joined on a constant.
    """
    need = ["utility_accounts", "payments_last_12m", "on_time_payment_ratio"]
    fill = ["missed_payment_count", "average_bill_amount", *[f"has_{k.lower()}" for k in KINDS if k != "OTHER_BBPS"]]
    t = table.dropna(subset=need).withColumn("span_months", F.lit(12.0)).withColumn("_one", F.lit(1))
    m = means.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_m_{c}") for c in fill])
    j = t.join(F.broadcast(m), "_one")
    have = set(table.columns)
    return j.select(
        "customer_id", *need, "span_months",
        *[F.coalesce(F.col(c).cast("double") if c in have else F.lit(None).cast("double"), F.col(f"_m_{c}")).alias(c) for c in fill],
    )
