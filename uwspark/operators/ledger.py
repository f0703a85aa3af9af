"""Ordered ledger operators: running balance, recovery of amounts, month buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.columns import (
    guessed_type, half_even, month_of, narration_amount, narration_tags, signature,
)


def signed(amount: str = "amount") -> Column:
    value = F.coalesce(F.col(amount), F.lit(0.0))
    return F.when(F.col("txn_type") == "CREDIT", value).otherwise(-value)


def running_balance(
    txns: DataFrame, openings: DataFrame | None, keys: Sequence[str] = ("account_id",), out: str = "running"
) -> DataFrame:
    """Printed balance where present, else the previous balance plus or minus the amount.

    Inside a block the rows are grouped by the last printed balance before them
    and summed from there.  Across blocks the same rule runs on one row per block:
    a block that prints a balance restarts the value, any other block adds to it.
    """
    keys = list(keys)
    blocks = txns.select(*keys, "blk").distinct()
    # Only keys that span several blocks need the value at the end of a block; there are fewer of them than blocks are full, so the list is broadcast.
    several = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    ends = (
        _summed_in_block(txns.join(F.broadcast(several), keys, "left_semi"), keys)
        .groupBy(*keys, "blk")
        .agg(F.max_by(F.struct("_a", "_s"), "seq").alias("e"))
        .select(*keys, "blk", "e._a", "e._s")
    )
    upto = W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy(*keys, "_bg").orderBy("blk").rowsBetween(W.unboundedPreceding, 0)
    prior = W.partitionBy(*keys).orderBy("blk")
    ends = (
        ends.withColumn("_bg", F.count("_a").over(upto))
        .withColumn("_ba", F.last("_a", ignorenulls=True).over(upto))
        .withColumn("_bs", F.sum("_s").over(group))
        .select(*keys, "blk", F.lag("_ba").over(prior).alias("_pa"), F.lag("_bs").over(prior).alias("_ps"))
    )
    carry = blocks.join(ends, [*keys, "blk"], "left")
    if openings is not None:
        carry = carry.join(openings.select("account_id", "opening_balance"), "account_id", "left")
    else:
        carry = carry.withColumn("opening_balance", F.lit(None).cast("double"))
    carry = carry.select(
        *keys, "blk",
        (F.coalesce("_pa", "opening_balance") + F.coalesce("_ps", F.lit(0.0))).alias("_carry"),
    )
    return (
        _summed_in_block(txns, keys)
        .join(carry.hint("merge"), [*keys, "blk"])
        .withColumn(out, F.coalesce("_a", "_carry") + F.col("_s"))
        .drop("_g", "_a", "_s", "_carry")
    )


def _summed_in_block(txns: DataFrame, keys: list[str]) -> DataFrame:
    """`_a`: last printed balance inside the block so far; `_s`: flow since then."""
    run = W.partitionBy(*keys, "blk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    within = W.partitionBy(*keys, "blk", "_g").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    flow = F.when(F.col("balance").isNull(), signed()).otherwise(0.0)
    return (
        txns.withColumn("_g", F.count("balance").over(run))
        .withColumn("_a", F.last("balance", ignorenulls=True).over(run))
        .withColumn("_s", F.sum(flow).over(within))
    )


def last_known(
    txns: DataFrame, value: str, *, before: str, upto: str, keys: Sequence[str] = ("account_id",)
) -> DataFrame:
    """Last non-null `value` strictly before each row and up to it, in statement order."""
    keys = list(keys)
    w = W.partitionBy(*keys, "blk").orderBy("seq")
    past, incl = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    ends = txns.groupBy(*keys, "blk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("_end")
    )
    prior = W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "blk", F.last("_end", ignorenulls=True).over(prior).alias("_in"))
    return (
        txns.withColumn("_b", F.last(value, ignorenulls=True).over(past))
        .withColumn("_u", F.last(value, ignorenulls=True).over(incl))
        .join(ends.hint("merge"), [*keys, "blk"])
        .withColumn(before, F.coalesce("_b", "_in"))
        .withColumn(upto, F.coalesce("_u", "_in"))
        .drop("_b", "_u", "_in")
    )


def clean_statement(txns: DataFrame, recover: Column | bool = True) -> DataFrame:
    """Recover or drop rows without an amount, forward-fill the balance.

    Adds `status` (kept / recovered / dropped), `method`, `reason`, `imputed` and the
    cleaned `amount`, `txn_type`, `balance` as `c_amount`, `c_type`, `c_balance`.
    """
    do = F.lit(recover) if isinstance(recover, bool) else recover
    rows = last_known(txns, "balance", before="prev_balance", upto="fill_balance")
    usable = F.coalesce(F.col("amount") > 0, F.lit(False))
    delta = half_even(F.col("balance") - F.col("prev_balance"), 2)
    by_delta = ~usable & do & F.coalesce(delta != 0, F.lit(False))
    narr = narration_amount("narration")
    kind = F.coalesce("txn_type", guessed_type("narration"))
    by_text = ~usable & do & ~by_delta & narr.isNotNull() & kind.isNotNull()
    got = usable | by_delta | by_text
    # The "no change" wording looks at the balance after this row was read.
    seen = F.col("balance").isNotNull()
    reason = F.when(~do, "missing or non-positive amount").when(
        seen, "no amount; balance shows no change; no amount in narration"
    ).otherwise("no amount; no balance to infer a delta; no amount in narration")
    return (
        rows.withColumn("status", F.when(usable, "kept").when(got, "recovered").otherwise("dropped"))
        .withColumn("method", F.when(by_delta, "balance change").when(by_text, "narration"))
        .withColumn("reason", F.when(~got, reason))
        .withColumn("imputed", got & F.col("balance").isNull() & F.col("prev_balance").isNotNull())
        .withColumn(
            "c_amount", F.when(usable, F.col("amount")).when(by_delta, F.abs(delta)).when(by_text, narr)
        )
        .withColumn(
            "c_type",
            F.when(
                by_delta, F.coalesce("txn_type", F.when(delta > 0, "CREDIT").otherwise("DEBIT"))
            ).when(by_text, kind).otherwise(F.col("txn_type")),
        )
        .withColumn("c_balance", F.coalesce("balance", "prev_balance"))
    )


def cleaned_rows(cleaned: DataFrame) -> DataFrame:
    """The surviving rows of `clean_statement` under the ledger's own column names."""
    return cleaned.where("status <> 'dropped'").select(
        "account_id", "seq", "blk", "txn_date", "narration",
        F.col("c_type").alias("txn_type"), F.col("c_amount").alias("amount"), F.col("c_balance").alias("balance"),
    )


def tagged(txns: DataFrame) -> DataFrame:
    rows = txns.withColumn("_upper", F.upper("narration"))
    return rows.withColumns({**narration_tags("narration", "_upper"), "sig": signature("narration")}).drop("_upper")


def month_buckets(txns: DataFrame) -> DataFrame:
    """Calendar-month bucket per row, carrying the last known month over undated rows.

    Accounts with fewer than 60 % dated rows get equal sequential chunks instead.
    Adds `bucket` (sortable text), `bucket_label` and `bucket_days`.
    """
    from .scale import attach

    rows = last_known(
        txns.withColumn("_m", F.trunc("txn_date", "month")), "_m", before="_mb", upto="_mu"
    )
    stats = txns.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("txn_date").alias("_d"), F.min("seq").alias("_seq0")
    )
    periods = F.greatest(F.lit(1.0), F.least(F.lit(12.0), half_even(F.col("_n") / 10)))
    stats = stats.withColumn("_size", F.ceil(F.col("_n") / periods)).withColumn(
        "_cal", F.col("_d") / F.col("_n") >= 0.6
    )
    rows = attach(rows, stats, ["account_id"])
    chunk = F.floor((F.col("seq") - F.col("_seq0")) / F.col("_size")) + 1
    return rows.select(
        *txns.columns,
        F.when(F.col("_cal"), F.coalesce(month_of("_mu"), F.lit("0000-00")))
        .otherwise(F.concat(F.lit("P"), F.lpad(chunk.cast("string"), 4, "0")))
        .alias("bucket"),
        F.when(
            F.col("_cal"),
            F.coalesce(F.date_format("_mu", "MMM yyyy"), F.lit("Period")),
        )
        .otherwise(F.concat(F.lit("Period "), chunk.cast("string")))
        .alias("bucket_label"),
        F.when(F.col("_cal") & F.col("_mu").isNotNull(), F.dayofmonth(F.last_day("_mu")))
        .otherwise(30)
        .alias("bucket_days"),
    )


def prepare(txns: DataFrame, openings: DataFrame) -> DataFrame:
    """Tags, signature and running balance of every row: the input of all later operators."""
    return tagged(running_balance(txns, openings))


def header_junk(narration: str = "narration") -> Column:
    return F.col(narration).rlike(fixed.HEADER_JUNK)
