"""Everything the rule evaluators need, one wide row per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import count_if, counterparty, money_sum, month_of, ratio
from . import scale
from .features import is_credit, is_debit


def positive(led: DataFrame) -> DataFrame:
    return led.where("amount > 0")


def monthly_flows(led: DataFrame) -> DataFrame:
    """Inflow, outflow, row count and month-end balance per account and calendar month."""
    rows = positive(led).where("txn_date is not null").withColumn("month", month_of("txn_date"))
    return rows.groupBy("account_id", "month").agg(
        money_sum(is_credit()).alias("inflow"),
        money_sum(F.coalesce(~is_credit(), F.lit(True))).alias("outflow"),
        F.count(F.lit(1)).alias("rows"),
        F.max_by("running", F.when(F.col("running").isNotNull(), F.col("seq"))).alias("end_balance"),
    )


def month_shape(monthly: DataFrame) -> DataFrame:
    """Series statistics over the months of an account (a bounded, calendar-sized group)."""
    pos = W.partitionBy("account_id").orderBy("month")
    whole = W.partitionBy("account_id")
    known = F.col("end_balance").isNotNull()
    m = (
        monthly.withColumn("_k", F.row_number().over(pos))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_prev", F.last("end_balance", ignorenulls=True).over(pos.rowsBetween(W.unboundedPreceding, -1)))
    )
    first_half = F.col("_k") <= F.floor(F.col("_n") / 2)
    a, b = F.avg(F.when(first_half, F.col("inflow"))), F.avg(F.when(~first_half, F.col("inflow")))
    rising = known & F.col("_prev").isNotNull() & (F.col("_prev") < F.col("end_balance"))
    n = F.count(F.lit(1))
    return m.groupBy("account_id").agg(
        n.alias("n_months"),
        F.avg("inflow").alias("inflow_mean"),
        F.coalesce(
            F.when(n >= 2, F.stddev_pop("inflow") / F.nullif(F.avg("inflow"), F.lit(0.0))), F.lit(0.0)
        ).alias("inflow_cv"),
        count_if(F.col("inflow") <= 1.0).alias("zero_inflow_months"),
        count_if(F.col("outflow") > F.col("inflow")).alias("deficit_months"),
        F.when(n >= 4, F.when(a != 0, (b - a) / a).otherwise(0.0)).alias("growth"),
        ((count_if(known) >= 3) & (count_if(rising) == 0)).alias("balance_declining"),
        (F.min("rows") <= 1).alias("dormant"),
        ((F.min("inflow") > 0) & (F.min("outflow") > 0)).alias("active_every_month"),
        ((n >= 3) & (F.max("rows") > 3 * F.avg("rows"))).alias("activity_spike"),
    )


def counterparties(led: DataFrame) -> DataFrame:
    """Concentration of credits (top 1/3/5) and of debits (top 1) by counterparty."""
    flows = (
        positive(led)
        .where("txn_type in ('CREDIT', 'DEBIT')")
        .groupBy("account_id", "txn_type", counterparty("sig", "narration").alias("party"))
        .agg(F.sum("amount").alias("amt"), F.count(F.lit(1)).alias("cnt"))
    )
    # The filter on the rank becomes a per-task top-5 before the shuffle.
    w = W.partitionBy("account_id", "txn_type").orderBy(F.col("amt").desc(), "party")
    top = (
        flows.withColumn("rk", F.row_number().over(w))
        .where("rk <= 5")
        .groupBy("account_id")
        .agg(
            money_sum(is_credit() & (F.col("rk") <= 1), "amt").alias("top1"),
            money_sum(is_credit() & (F.col("rk") <= 3), "amt").alias("top3"),
            money_sum(is_credit(), "amt").alias("top5"),
            money_sum(is_debit() & (F.col("rk") <= 1), "amt").alias("top_supplier"),
        )
    )
    sizes = flows.groupBy("account_id").agg(
        count_if(is_credit()).alias("unique_payees"),
        count_if(is_credit() & (F.col("cnt") >= 2)).alias("repeat_payees"),
    )
    return sizes.join(top, "account_id")


def money_in_out(led: DataFrame, inflow: DataFrame) -> DataFrame:
    """Large credits followed within two days by a debit of at least 80 % of them."""
    rows = positive(led).where("txn_date is not null").select(
        "account_id", "seq", "blk", "txn_date", "amount", "txn_type"
    )
    big = inflow.select("account_id", (F.col("avg_monthly_inflow") * 0.5).alias("big"))
    rows = scale.attach(rows, big, ["account_id"])
    return scale.later_partner(
        rows,
        ["account_id"],
        is_query=is_credit() & (F.col("amount") >= F.col("big")) & (F.col("big") > 0),
        is_provider=is_debit(),
        accept=lambda cand, own: cand >= 0.8 * own,
    )


def rapid_duplicates(led: DataFrame) -> DataFrame:
    """Rows with a later row of the same signature and amount (within 1) inside two days."""
    rows = positive(led).where("txn_date is not null").select(
        "account_id", "sig", "seq", "blk", "txn_date", "amount"
    )
    return scale.later_partner(
        rows,
        ["account_id", "sig"],
        is_query=F.lit(True),
        is_provider=F.lit(True),
        bucket=F.floor("amount"),
        reach=1,
        accept=lambda cand, own: F.abs(cand - own) < 1.0,
    )


def counters(led: DataFrame) -> DataFrame:
    """All tag counts and sums of an account in one pass; EMI lenders and months apart."""
    cr, db = "amount > 0 and txn_type = 'CREDIT'", "amount > 0 and txn_type = 'DEBIT'"
    counts = {
        "n_txns": "amount > 0",
        "n_credits": cr,
        "neg_points": "running < 0",
        "low_bal_points": "running >= 0 and running < 2000",
        "emi_txn_count": f"{db} and is_emi",
        "gst_count": f"{db} and is_gst",
        "tax_count": f"{db} and is_tax",
        "rent_count": f"{db} and is_rent",
        "util_count": f"{db} and is_utility",
        "salary_in_count": f"{cr} and is_salary",
        "upi_credit_count": f"{cr} and is_upi",
        "cash_wd_count": f"{db} and is_cash",
        "reversal_count": "amount > 0 and is_reversal",
        "bounce_count": "amount > 0 and is_bounce",
        "round_credits": f"{cr} and amount >= 50000 and amount % 50000 = 0",
        "structuring_credits": f"{cr} and is_cash and (amount >= 40000 and amount < 50000 "
        "or amount >= 90000 and amount < 100000 or amount >= 190000 and amount < 200000)",
    }
    sums = {
        "total_credit": cr,
        "total_debit": db,
        "emi_amt": f"{db} and is_emi",
        "gst_amt": f"{db} and is_gst",
        "rent_amt": f"{db} and is_rent",
        "util_amt": f"{db} and is_utility",
        "salary_amt": f"{cr} and is_salary",
        "upi_credit_amt": f"{cr} and is_upi",
        "cash_deposit_amt": f"{cr} and is_cash",
    }
    wide = led.groupBy("account_id").agg(
        *[F.expr(f"count_if({cond})").alias(n) for n, cond in counts.items()],
        *[F.expr(f"coalesce(sum(amount) filter (where {cond}), 0.0D)").alias(n) for n, cond in sums.items()],
        F.expr(f"coalesce(max(amount) filter (where {cr}), 0.0D)").alias("largest_credit"),
        F.avg("running").alias("avg_bal"),
        F.min("running").alias("min_bal"),
    )
    emi = positive(led).where(is_debit() & F.col("is_emi"))
    lenders = (
        emi.where("sig <> ''").select("account_id", "sig").distinct()
        .groupBy("account_id").agg(F.count(F.lit(1)).alias("emi_lenders"))
    )
    months = (
        emi.where("txn_date is not null").select("account_id", month_of("txn_date").alias("m")).distinct()
        .groupBy("account_id").agg(F.count(F.lit(1)).alias("emi_months"))
    )
    return wide.join(lenders, "account_id", "left").join(months, "account_id", "left").na.fill(
        0, ["emi_lenders", "emi_months"]
    )


def rule_context(led: DataFrame, scored: DataFrame) -> DataFrame:
    """Join of all parts; `scored` carries the vector and the score columns of each account."""
    tally = lambda df, name: df.groupBy("account_id").agg(F.count(F.lit(1)).alias(name))
    c = (
        scored.join(counters(led), "account_id")
        .join(month_shape(monthly_flows(led)), "account_id", "left")
        .join(counterparties(led), "account_id", "left")
        .join(tally(money_in_out(led, scored), "same_day_inout"), "account_id", "left")
        .join(tally(rapid_duplicates(led), "rapid_dup"), "account_id", "left")
    )
    zero = [
        "same_day_inout", "rapid_dup", "inflow_cv", "zero_inflow_months", "deficit_months",
        "unique_payees", "repeat_payees", "top1", "top3", "top5", "top_supplier",
    ]
    c = c.na.fill(0, zero).na.fill(1, ["n_months"]).na.fill(
        False, ["balance_declining", "dormant", "activity_spike"]
    )
    c = c.na.fill(True, ["active_every_month"])
    months, inflow = F.col("statement_months"), F.col("avg_monthly_inflow")
    return (
        c.withColumns(
            {
                "avg_bal": F.coalesce("avg_bal", "avg_balance"),
                "min_bal": F.coalesce("min_bal", "minimum_balance"),
                "monthly_emi": F.col("emi_amt") / months,
                "monthly_gst": F.col("gst_amt") / months,
                "monthly_rent": F.col("rent_amt") / months,
                "fixed_burden": F.col("emi_amt") / months + F.col("rent_amt") / months + F.col("util_amt") / months,
                "largest_credit_pct": ratio("largest_credit", inflow),
                "top1_share": ratio("top1", "total_credit"),
                "top3_share": ratio("top3", "total_credit"),
                "top5_share": ratio("top5", "total_credit"),
                "top_supplier_share": ratio("top_supplier", "total_debit"),
                "same_day_ratio": ratio("same_day_inout", "n_credits"),
                "cash_deposit_ratio": ratio("cash_deposit_amt", "total_credit"),
                "expense_ratio": ratio("total_debit", "total_credit"),
                "tx_per_month": F.col("n_txns") / months,
            }
        )
        .withColumns(
            {
                "emi_burden": ratio("monthly_emi", inflow),
                "rent_burden": ratio("monthly_rent", inflow),
                "fixed_burden_ratio": ratio("fixed_burden", inflow),
                "coverage": ratio(inflow, "fixed_burden"),
                "is_salaried": (F.col("salary_in_count") >= F.greatest(F.lit(2), F.col("n_months") - 1))
                | ((F.col("salary_in_count") >= 1) & (ratio("salary_amt", "total_credit") >= 0.55)),
            }
        )
        .drop("top1", "top3", "top5", "top_supplier", "emi_amt", "gst_amt", "rent_amt", "util_amt", "salary_amt")
    )
