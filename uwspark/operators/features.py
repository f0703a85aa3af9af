"""Statement summaries, the underwriting vector and the session-model features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.columns import clip, count_if, half_even, money_sum, month_of, ratio
from . import ledger, scale



def is_credit() -> Column:
    return F.col("txn_type") == "CREDIT"


def is_debit() -> Column:
    return F.col("txn_type") == "DEBIT"


def merge(frames: list[DataFrame], key: str = "account_id", how: str = "left") -> DataFrame:
    """Join per-account tables side by side."""
    return reduce(lambda a, b: a.join(b, key, how), frames)


def statement_summary(txns: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Count, totals, first/last/min/max balance; labelled opening and closing win."""
    seen = F.when(F.col("balance").isNotNull(), F.col("seq"))
    out = txns.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        half_even(money_sum(is_debit()), 2).alias("total_debit"),
        half_even(money_sum(is_credit()), 2).alias("total_credit"),
        F.min_by("balance", seen).alias("opening_balance"),
        F.max_by("balance", seen).alias("closing_balance"),
        F.min("balance").alias("min_balance"),
        F.max("balance").alias("max_balance"),
    )
    if labelled is None:
        return out
    lab = labelled.select(
        "account_id", F.col("opening_balance").alias("_o"), F.col("closing_balance").alias("_c")
    )
    return (
        out.join(lab, "account_id", "left")
        .withColumn("opening_balance", F.coalesce("_o", "opening_balance"))
        .withColumn("closing_balance", F.coalesce("_c", "closing_balance"))
        .drop("_o", "_c")
    )


def merged_summary(per_file: DataFrame) -> DataFrame:
    """Several statements of one account: totals add up, first opening, last closing."""
    opened = F.when(F.col("opening_balance").isNotNull(), F.col("file_seq"))
    closed = F.when(F.col("closing_balance").isNotNull(), F.col("file_seq"))
    return per_file.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("transaction_count").alias("transaction_count"),
        half_even(F.sum("total_debit"), 2).alias("total_debit"),
        half_even(F.sum("total_credit"), 2).alias("total_credit"),
        F.min_by("opening_balance", opened).alias("opening_balance"),
        F.max_by("closing_balance", closed).alias("closing_balance"),
    )


def statement_months(first: Column, last: Column, dated: Column, rows: Column) -> Column:
    span = half_even((F.datediff(last, first) + 1) / 30.44, 2)
    return F.greatest(F.lit(1.0), F.when(dated >= 2, span).otherwise(half_even(rows / 30, 2)))


def monthly_credits(txns: DataFrame) -> DataFrame:
    """Credits per account and calendar month; undated rows share one extra bucket."""
    return (
        txns.where(is_credit())
        .groupBy("account_id", F.coalesce(month_of("txn_date"), F.lit("?")).alias("month"))
        .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("credit"))
    )


def income_stability(txns: DataFrame) -> DataFrame:
    m = monthly_credits(txns).where("credit > 0")
    cv = F.stddev_pop("credit") / F.avg("credit")
    return m.groupBy("account_id").agg(
        F.when(F.count(F.lit(1)) < 2, 0.6)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - cv))
        .alias("stability")
    )


def underwriting_vector(led: DataFrame) -> DataFrame:
    """The 13 underwriting numbers per account from a prepared ledger."""
    agg = led.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("txn_date").alias("dated"),
        F.min("txn_date").alias("d0"),
        F.max("txn_date").alias("d1"),
        half_even(money_sum(is_credit()), 2).alias("tc"),
        half_even(money_sum(is_debit()), 2).alias("td"),
        count_if(F.col("is_bounce")).alias("bounces"),
        money_sum(is_debit() & F.col("is_cash")).alias("cash_out"),
        F.count("running").alias("rn"),
        F.avg("running").alias("r_avg"),
        F.stddev_pop("running").alias("r_sd"),
        F.min("running").alias("r_min"),
    )
    return vector_from_totals(agg.join(income_stability(led), "account_id", "left"))


def vector_from_totals(t: DataFrame) -> DataFrame:
    """Vector arithmetic on totals: n, dated, d0, d1, tc, td, bounces, cash_out, rn, r_*, stability."""
    months = statement_months(F.col("d0"), F.col("d1"), F.col("dated"), F.col("n"))
    vol = F.when(
        F.col("rn") >= 2,
        F.when(F.col("r_avg") > 0, F.col("r_sd") / F.col("r_avg")).otherwise(1.0),
    ).otherwise(0.3)
    keep = [k for k in ("account_id", "bucket") if k in t.columns]
    t = t.withColumn("statement_months", months).withColumn(
        "balance_volatility", half_even(F.least(vol, F.lit(5.0)), 4)
    )
    return t.select(
        *keep,
        F.lit(None).cast("double").alias("account_age_days"),
        "statement_months",
        half_even(F.col("tc") / F.col("statement_months")).alias("avg_monthly_inflow"),
        half_even(F.col("td") / F.col("statement_months")).alias("avg_monthly_debit"),
        F.col("bounces").alias("nach_bounce_count_90d"),
        F.when(F.col("td") > 0, F.least(F.lit(9.99), half_even(F.col("tc") / F.col("td"), 2)))
        .otherwise(F.when(F.col("tc") > 0, 3.0).otherwise(0.0))
        .alias("dscr_ratio"),
        half_even(ratio("cash_out", "td"), 4).alias("cash_withdrawal_ratio"),
        "balance_volatility",
        F.col("balance_volatility").alias("transaction_volatility"),
        half_even(F.coalesce("r_min", F.lit(0.0))).alias("minimum_balance"),
        half_even(F.coalesce("r_avg", F.lit(0.0))).alias("avg_balance"),
        half_even(ratio("td", "tc") * 100, 2).alias("foir_ratio"),
        half_even(F.coalesce("stability", F.lit(0.6)), 3).alias("income_stability"),
    )


# ------------------------------------------------------------- session-model features


def largest_drop(txns: DataFrame, keys: list[str]) -> DataFrame:
    """Largest fall between consecutive known balances, 0 when none."""
    known = ledger.last_known(txns, "balance", before="_pb", upto="_ub", keys=keys)
    drop = F.col("_pb") - F.col("balance")
    return known.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(drop > 0, drop)), F.lit(0.0)).alias("max_drop")
    )


def session_features(txns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nine features per key; the statement length is taken as 90 days / 3 months."""
    keys = keys or ["account_id"]
    base = txns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("n_amt"),
        F.count("balance").alias("n_bal"),
        F.avg("balance").alias("bal_avg"),
        F.stddev_pop("balance").alias("bal_sd"),
        half_even(money_sum(is_debit()), 2).alias("td"),
        half_even(money_sum(is_credit()), 2).alias("tc"),
    )
    med = scale.exact_percentiles(scale.value_counts(txns, keys, "amount"), keys, {"med": 0.5})
    large = (
        scale.attach(txns.where("amount is not null"), med, keys)
        .groupBy(*keys)
        .agg(count_if(F.col("amount") > 2 * F.col("med")).alias("n_large"))
    )
    t = base.join(largest_drop(txns, keys), keys, "left").join(large, keys, "left")
    adb = F.coalesce("bal_avg", F.lit(50000.0))
    vol = F.when(
        F.col("n_bal") >= 2,
        F.col("bal_sd") / F.when(F.col("bal_avg") == 0, 1.0).otherwise(F.col("bal_avg")),
    ).otherwise(0.2)
    td = F.when(F.col("td") == 0, 1.0).otherwise(F.col("td"))
    tc = F.when(F.col("tc") == 0, 1.0).otherwise(F.col("tc"))
    large_pct = F.when(F.col("n_amt") > 0, F.col("n_large") / F.col("n_amt")).otherwise(0.1)
    drawdown = F.when(F.col("n_bal") >= 2, F.col("max_drop") / F.greatest(adb, F.lit(1.0))).otherwise(0.0)
    return t.select(
        *keys,
        F.greatest(adb, F.lit(1.0)).alias("avg_daily_balance"),
        half_even(F.least(vol, F.lit(5.0)), 4).alias("balance_volatility"),
        half_even(F.least(tc / F.greatest(td, F.lit(1.0)), F.lit(10.0)), 4).alias("credit_debit_ratio"),
        (tc / 3.0).alias("monthly_credit"),
        (td / 3.0).alias("monthly_debit"),
        half_even(F.col("n") / 90.0, 4).alias("tx_velocity"),
        half_even(F.least(drawdown, F.lit(1.0)), 4).alias("max_drawdown_pct"),
        half_even(large_pct, 4).alias("large_tx_pct"),
        half_even(F.least(F.lit(1.0), vol * 0.5 + large_pct * 0.5), 4).alias("irregular_gap_score"),
    )


def engineered(features: DataFrame) -> DataFrame:
    """Net-flow ratio and liquidity runway next to the nine base features."""
    mc, md = F.col("monthly_credit"), F.col("monthly_debit")
    return features.withColumn(
        "net_flow_ratio", half_even(clip((mc - md) / F.greatest(mc, F.lit(1.0)), -1.0, 1.0), 4)
    ).withColumn(
        "liquidity_runway_days",
        half_even(
            F.least(F.lit(180.0), F.col("avg_daily_balance") / F.greatest(md / 30.0, F.lit(1.0))), 1
        ),
    )


def min_max(name: str, value: Column | None = None) -> Column:
    low, high = fixed.FEATURE_BOUNDS[name]
    v = F.col(name) if value is None else value
    return clip((v - low) / (high - low), 0.0, 1.0)


def z_score(name: str) -> Column:
    mean, sd = fixed.FEATURE_REFERENCE[name]
    return half_even((F.col(name) - mean) / sd, 4)


def normalised(features: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long table (key, feature, raw, minmax, zscore) of the chosen features."""
    keys = keys or ["account_id"]
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                half_even(n, 4).alias("raw"),
                half_even(min_max(n), 4).alias("minmax"),
                z_score(n).alias("zscore"),
            )
            for n in names
        ]
    )
    return features.select(*keys, F.inline(items))


def chunked(txns: DataFrame, n_chunks: int = 5, min_size: int = 3) -> DataFrame:
    """Sequential chunks of each account; a short tail is left out, tiny accounts stay whole."""
    rows = scale.number_rows(txns, ["account_id"], ["blk"], ["seq"], out="pos")
    sizes = txns.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = scale.attach(rows, sizes, ["account_id"])
    size = F.greatest(F.lit(min_size), F.floor(F.col("_n") / n_chunks))
    small = F.col("_n") < 2 * min_size
    chunk = F.when(small, 0).otherwise(F.floor(F.col("pos") / size)).cast("bigint")
    start = chunk * size
    length = F.least(size, F.col("_n") - start)
    return (
        rows.withColumn("chunk", chunk)
        .where(small | (length >= min_size))
        .drop("pos", "_n")
    )


def feature_ranking(samples: DataFrame, top_k: int = 6) -> DataFrame:
    """Population variance of each min-max feature over all samples, ranked."""
    names = list(fixed.FEATURE_BOUNDS)
    wide = samples.agg(*[F.var_pop(min_max(n)).alias(n) for n in names])
    items = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(n).alias("feature"), F.col(n).alias("variance"))
            for i, n in enumerate(names)
        ]
    )
    # One row per feature name: a fixed list of eleven.
    w = W.orderBy(F.col("variance").desc(), "ord")
    return (
        wide.select(F.inline(items))
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .select(
            "rank", "feature", half_even("variance", 5).alias("variance"),
            (F.col("rank") <= top_k).alias("selected"),
        )
    )


def range_ranking(rows: DataFrame, numeric: list[str], categories: dict[str, list[str]] | None = None, share: float = 0.6) -> DataFrame:
    """Features ranked by the sample variance of their values scaled to the range of the data.

    One pass: the variance of a scaled column is that of the column over its squared range.  Missing values
    count as 0; a category becomes one column of 0 and 1 per value.  The first `share` of the features,
    at least one, are selected; ties keep the order of the columns.
    """
    cols = {n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) for n in numeric}
    for n, values in (categories or {}).items():
        for v in values:
            cols[f"{n}_{v}"] = F.when(F.upper(F.col(n).cast("string")).eqNullSafe(F.lit(v)), 1.0).otherwise(0.0)
    spread = lambda c: F.nullif(F.max(c) - F.min(c), F.lit(0.0))
    wide = rows.agg(*[F.struct(F.var_samp(c).alias("v"), spread(c).alias("r")).alias(n) for n, c in cols.items()])
    scaled = lambda n: F.coalesce(F.col(f"{n}.v") / (F.col(f"{n}.r") * F.col(f"{n}.r")), F.col(f"{n}.v"))
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("feature"), scaled(n).alias("variance")) for i, n in enumerate(cols)])
    keep = max(1, round(len(cols) * share))
    # One row per feature name.
    w = W.orderBy(F.col("variance").desc(), "ord")
    return (
        wide.select(F.inline(items))
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .select("rank", "feature", half_even("variance", 6).alias("variance"), (F.col("rank") <= keep).alias("selected"))
    )


def duplicate_rows(txns: DataFrame) -> DataFrame:
    """Rows beyond the first per (narration, amount, type) and per (text, rounded amount)."""
    exact = (
        txns.groupBy("account_id", "narration", "amount", "txn_type")
        .agg((F.count(F.lit(1)) - 1).alias("x"))
        .groupBy("account_id")
        .agg(F.sum("x").alias("exact_duplicates"))
    )
    loose = (
        txns.groupBy(
            "account_id", F.lower(F.trim("narration")).alias("t"), half_even("amount", 2).alias("a")
        )
        .agg((F.count(F.lit(1)) - 1).alias("x"))
        .groupBy("account_id")
        .agg(F.sum("x").alias("loose_duplicates"))
    )
    return exact.join(loose, "account_id")


def processed_row(features: DataFrame, dups: DataFrame, sizes: DataFrame, selected: list[str]) -> DataFrame:
    """Display row of one source after cleaning: balance, ratio, velocity, duplicates, score."""
    score = sum((half_even(min_max(n), 4) for n in selected), F.lit(0.0)) / len(selected)
    return (
        features.join(dups, "account_id")
        .join(sizes, "account_id")
        .select(
            "account_id",
            half_even("avg_daily_balance").alias("adb"),
            F.least(F.lit(9.99), F.col("credit_debit_ratio")).alias("credit_debit"),
            half_even(F.col("rows") / 30, 1).alias("per_day"),
            "exact_duplicates",
            half_even(score, 3).alias("norm_score"),
        )
    )
