"""Points scorecard, credit score, gate, anomalies and monthly analytics."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import clip, count_if, decision_of, grade, half_even, money_sum, month_of, ratio
from ..staging import stage
from . import features, ledger, scale


@dataclass(frozen=True)
class ScoringConfig:
    """Credit-policy numbers (fixed values, each can be patched)."""

    baseline: float = 740.0
    surplus_weight: float = 220.0
    surplus_floor: float = -180.0
    surplus_cap: float = 55.0
    overspend_trigger: float = -0.15
    overspend_extra_penalty: float = 45.0
    income_stability_weight: float = 130.0
    income_stability_pivot: float = 0.60
    bounce_first: float = 110.0
    bounce_each_after: float = 80.0
    bounce_cap: float = 260.0
    overdraft_penalty: float = 170.0
    low_balance_2k_penalty: float = 70.0
    low_balance_10k_penalty: float = 25.0
    high_balance_threshold: float = 100000.0
    high_balance_bonus: float = 25.0
    volatility_weight: float = 70.0
    volatility_pivot: float = 0.40
    cash_withdrawal_weight: float = 250.0
    cash_withdrawal_pivot: float = 0.12
    dscr_bonus_threshold: float = 1.30
    dscr_bonus_weight: float = 40.0
    dscr_bonus_cap: float = 35.0
    grade_low_min: int = 700
    grade_medium_min: int = 550
    gate_threshold: int = 650
    pd_scale_max: float = 18.0
    pd_scale_denom: float = 850.0
    pd_floor: float = 0.3
    ml_blend_weight: float = 0.45

    def patched(self, patch: dict) -> "ScoringConfig":
        """A copy with the known numeric fields of `patch`; unknown or bad values are ignored."""
        changes = {}
        for f in fields(self):
            try:
                if patch.get(f.name) is not None:
                    changes[f.name] = type(f.default)(patch[f.name])
            except (TypeError, ValueError):
                continue
        return replace(self, **changes)


DEFAULT = ScoringConfig()


def scorecard(cfg: ScoringConfig = DEFAULT) -> Column:
    inflow, debit = F.col("avg_monthly_inflow"), F.col("avg_monthly_debit")
    surplus = F.when(inflow > 0, (inflow - debit) / inflow).otherwise(-1.0)
    bounces, low = F.col("nach_bounce_count_90d"), F.col("minimum_balance")
    parts = [
        F.lit(cfg.baseline),
        clip(surplus * cfg.surplus_weight, cfg.surplus_floor, cfg.surplus_cap),
        F.when(surplus < cfg.overspend_trigger, -cfg.overspend_extra_penalty).otherwise(0.0),
        (F.col("income_stability") - cfg.income_stability_pivot) * cfg.income_stability_weight,
        F.when(
            bounces > 0,
            -F.least(F.lit(cfg.bounce_cap), cfg.bounce_first + (bounces - 1) * cfg.bounce_each_after),
        ).otherwise(0.0),
        F.when(low < 0, -cfg.overdraft_penalty)
        .when(low < 2000, -cfg.low_balance_2k_penalty)
        .when(low < 10000, -cfg.low_balance_10k_penalty)
        .when(low > cfg.high_balance_threshold, cfg.high_balance_bonus)
        .otherwise(0.0),
        -clip(F.col("balance_volatility") - cfg.volatility_pivot, 0.0, 1.2) * cfg.volatility_weight,
        -clip(F.col("cash_withdrawal_ratio") - cfg.cash_withdrawal_pivot, 0.0, 0.4)
        * cfg.cash_withdrawal_weight,
        F.when(
            F.col("dscr_ratio") >= cfg.dscr_bonus_threshold,
            F.least(
                F.lit(cfg.dscr_bonus_cap),
                (F.col("dscr_ratio") - cfg.dscr_bonus_threshold) * cfg.dscr_bonus_weight,
            ),
        ).otherwise(0.0),
    ]
    return sum(parts[1:], parts[0])


def credit_score(vector: DataFrame, model_scores: DataFrame | None = None, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Scorecard, optionally blended with a model score (account_id, model_score, model_source)."""
    v = vector.withColumn("card", scorecard(cfg))
    if model_scores is not None:
        v = v.join(model_scores, "account_id", "left")
    else:
        v = v.withColumn("model_score", F.lit(None).cast("double")).withColumn(
            "model_source", F.lit(None).cast("string")
        )
    w = cfg.ml_blend_weight
    blended = F.col("model_score").isNotNull() & F.lit(0.0 < w <= 1.0)
    final = F.when(blended, (1.0 - w) * F.col("card") + w * F.col("model_score")).otherwise(F.col("card"))
    v = v.withColumn("ml_blended", blended).withColumn(
        "score", clip(half_even(final), 300.0, 900.0).cast("bigint")
    )
    pd = F.greatest(
        F.lit(cfg.pd_floor),
        half_even((cfg.pd_scale_denom - F.col("score")) / cfg.pd_scale_denom * cfg.pd_scale_max, 1),
    )
    return (
        v.withColumn("pd", pd)
        .withColumn("grade", grade("score", cfg.grade_low_min, cfg.grade_medium_min))
        .withColumn("decision", decision_of("grade"))
        .withColumn("scorecard_score", half_even("card").cast("bigint"))
        .drop("card")
    )


def gated(scored: DataFrame, cfg: ScoringConfig = DEFAULT, enabled: bool = True) -> DataFrame:
    """Hard cutoff on the score; keeps the three-tier grade as `grade_raw`."""
    out = scored.withColumn("grade_raw", F.col("grade"))
    if not enabled:
        return out.withColumn("gate_passed", F.lit(None).cast("boolean"))
    passed = F.col("score") > cfg.gate_threshold
    return (
        out.withColumn("gate_passed", passed)
        .withColumn("grade", F.when(passed, "LOW").otherwise("HIGH"))
        .withColumn("decision", F.when(passed, "APPROVED").otherwise("REJECTED"))
    )


# ------------------------------------------------------------------------- anomalies


def amount_fence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """4 x the 90th percentile of the amounts up to the 95th, at least 50,000; needs 4 rows.

    The pool up to the cutoff is a prefix of the same sorted values, so its own
    percentile is one more rank lookup in the same value counts.
    """
    counts = scale.value_counts(rows, keys, "amount")
    at95 = lambda edge: lambda size: edge(F.lit(0.95) * (size - 1))
    pick = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    whole = pick("lo", "v") == pick("hi", "v")
    pool = (
        scale.lookup_ranks(counts, keys, {"lo": at95(F.floor), "hi": at95(F.ceil)})
        .where("size >= 4")
        .groupBy(*keys)
        .agg(F.when(whole, pick("hi", "upto")).otherwise(pick("lo", "upto")).alias("size"))
    )
    p90 = scale.exact_percentiles(counts, keys, {"p90": 0.9}, sizes=pool)
    return p90.select(*keys, F.greatest(F.lit(50000.0), 4.0 * F.col("p90")).alias("fence"))


def recurring_signatures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often a signature occurs, with the two extreme amounts (decides pairs)."""
    return rows.where("sig <> ''").groupBy(*keys, "sig").agg(
        F.count(F.lit(1)).alias("sig_n"), F.min("amount").alias("sig_lo"), F.max("amount").alias("sig_hi")
    )


def _judged(running: str) -> tuple[Column, Column]:
    """Whether a row over its fence is unusual, and its score, from `over`, `fence` and the figures of its signature."""
    pair = (F.col("sig_n") == 2) & (
        F.col("sig_hi") - F.col("sig_lo") <= 0.15 * F.greatest(F.col("amount"), F.lit(1.0))
    )
    expected = F.coalesce((F.col("sig_n") >= 3) | pair, F.lit(False))
    unusual = F.col("over") & ~expected
    size = F.least(F.lit(88.0), 48.0 + 22.0 * F.log10(F.col("amount") / F.col("fence") + 1.0))
    score = F.greatest(
        F.when(F.col("is_bounce"), 80.0).otherwise(0.0),
        F.when(F.coalesce(F.col(running) < 0, F.lit(False)), 82.0).otherwise(0.0),
        F.when(unusual, size).otherwise(0.0),
    )
    return unusual, F.least(F.lit(99.0), score)


def anomaly_counts(led: DataFrame, keys: list[str], running: str = "running") -> DataFrame:
    """(keys, flagged): how many rows `anomaly_rows` flags.

    Most months lie in one block, so a task that gets the block has all that is asked about: fences and
    signatures come from windows over it, and the rows move once.  The rows of keys that span blocks go
    through `anomaly_rows`; such a month crosses the end of a block, so the list of them is broadcast.
    """
    several = stage(led.groupBy(*keys).agg((F.min("blk") < F.max("blk")).alias("_many")).where("_many").select(*keys))
    rows = led.where((F.col("amount") > 0) & ~ledger.header_junk())
    group = [*keys, "blk"]
    if several.isEmpty():
        return _counts_in_block(rows, group, running).select(*keys, "flagged")
    within = _counts_in_block(rows.join(F.broadcast(several), keys, "left_anti"), group, running).select(*keys, "flagged")
    across = anomaly_rows(led.join(F.broadcast(several), keys, "left_semi"), keys, running)
    return within.unionByName(across.groupBy(*keys).agg(F.count(F.lit(1)).alias("flagged")))


def _counts_in_block(rows: DataFrame, group: list[str], running: str) -> DataFrame:
    """The count of flagged rows of every group, of which all rows lie together; as `anomaly_rows` and `amount_fence` have it."""
    whole, typed, signed = W.partitionBy(*group), W.partitionBy(*group, "txn_type"), W.partitionBy(*group, "sig")
    at = lambda rank, w: F.max(F.when(F.col("_rn") - 1 == rank.cast("bigint"), F.col("amount"))).over(w)
    cut = F.lit(0.95) * (F.col("_n") - 1)
    pos = F.lit(0.9) * (F.col("_pool") - 1)
    p90 = F.col("_low") + (F.col("_high") - F.col("_low")) * (pos - F.floor(pos))
    known = F.col("txn_type").isin("DEBIT", "CREDIT") & (F.col("_n") >= 4)
    fence = F.when(known, F.greatest(F.lit(50000.0), 4.0 * p90))
    has_sig = F.col("sig") != ""
    judged = (
        rows.select(*group, "txn_type", "amount", "sig", "is_bounce", running)
        .withColumn("_kept", F.count(F.lit(1)).over(whole))
        .where("_kept >= 8")
        # a value that is no number comes last and counts for no rank
        .withColumns({"_rn": F.row_number().over(typed.orderBy("amount")), "_n": F.count_if(~F.isnan("amount")).over(typed)})
        .withColumns({"_lo": at(F.floor(cut), typed), "_hi": at(F.ceil(cut), typed)})
        .withColumn("_pool", F.when(F.col("_lo") == F.col("_hi"), F.count_if(F.col("amount") <= F.col("_hi")).over(typed)).otherwise(F.floor(cut) + 1))
        .withColumns({"_low": at(F.floor(pos), typed), "_high": at(F.ceil(pos), typed)})
        .withColumn("fence", fence)
        .withColumn("over", F.coalesce(F.col("amount") > F.col("fence"), F.lit(False)))
        .withColumns({"_sig_n": F.count(F.lit(1)).over(signed), "sig_lo": F.min("amount").over(signed), "sig_hi": F.max("amount").over(signed)})
        .withColumn("sig_n", F.when(has_sig, F.col("_sig_n")))
    )
    return judged.groupBy(*group).agg(F.count_if(_judged(running)[1] >= 55).alias("flagged"))


def anomaly_rows(led: DataFrame, keys: list[str] | None = None, running: str = "running") -> DataFrame:
    """Every flagged row with score, level and reasons (before the top-12 cut).

    `led` is a prepared ledger; with extra `keys` (a month bucket) fences, counts and
    the 8-row minimum are taken inside the bucket.
    """
    keys = keys or ["account_id"]
    rows = led.where((F.col("amount") > 0) & ~ledger.header_junk())
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept")).where("kept >= 8")
    typed = rows.where("txn_type is not null")
    fences = amount_fence(typed, [*keys, "txn_type"])
    wide = fences.groupBy(*keys).agg(
        F.max(F.when(F.col("txn_type") == "DEBIT", F.col("fence"))).alias("f_debit"),
        F.max(F.when(F.col("txn_type") == "CREDIT", F.col("fence"))).alias("f_credit"),
    )
    rows = scale.attach(rows, enough.join(wide, keys, "left"), keys)
    fence = F.when(F.col("txn_type") == "DEBIT", F.col("f_debit")).when(
        F.col("txn_type") == "CREDIT", F.col("f_credit")
    )
    over = F.coalesce(F.col("amount") > fence, F.lit(False))
    bounce, negative = F.col("is_bounce"), F.coalesce(F.col(running) < 0, F.lit(False))
    flagged = rows.withColumn("fence", fence).withColumn("over", over).where(bounce | negative | over)
    # Only rows over the fence ask about their signature.
    asked = flagged.where("over and sig <> ''").select(*keys, "sig").distinct()
    sigs = recurring_signatures(led.where((F.col("amount") > 0) & ~ledger.header_junk()), keys).join(
        asked, [*keys, "sig"], "left_semi"
    )
    # One row per block that asks, so a signature of one account's many rows stays spread.
    blocks = flagged.select(*keys, "sig", "blk").distinct().join(sigs, [*keys, "sig"])
    flagged = flagged.join(blocks.hint("merge"), [*keys, "sig", "blk"], "left")
    unusual, score = _judged(running)
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("is_bounce"), "return or bounce"),
        F.when(F.coalesce(F.col(running) < 0, F.lit(False)), "balance went negative"),
        F.when(unusual, F.concat(F.lower("txn_type"), F.lit(" far outside the usual range"))),
    )
    return (
        flagged.withColumn("raw", score)
        .where("raw >= 55")
        .select(
            *keys, "seq", "txn_date", "narration", "amount",
            half_even("raw", 1).alias("score"),
            F.when(F.col("raw") >= 72, "HIGH").otherwise("MEDIUM").alias("level"),
            reasons.alias("reasons"),
        )
    )


def top_anomalies(flagged: DataFrame, keep: int = 12) -> DataFrame:
    w = W.partitionBy("account_id").orderBy(F.col("score").desc(), "seq")
    return flagged.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep)


# ------------------------------------------------------------------- monthly analytics


def monthly_view(txns: DataFrame, openings: DataFrame) -> DataFrame:
    """Per bucket: flows, balances (restarting at the opening balance), duplicates, bounces."""
    keys = ["account_id", "bucket"]
    rows = ledger.tagged(ledger.month_buckets(txns))
    # many branches read the rows, so what they need is written once before the balances run and once after
    rows = stage(rows.select(*keys, "seq", "blk", "bucket_label", "bucket_days", "txn_date", "narration", "txn_type", "amount", "balance", "is_bounce", "sig"))
    run = stage(ledger.running_balance(rows, openings, keys=keys).drop("balance"))
    base = run.groupBy(*keys).agg(
        F.first("bucket_label").alias("label"),
        F.first("bucket_days").alias("days"),
        F.count(F.lit(1)).alias("volume"),
        half_even(half_even(money_sum(features.is_credit()), 2)).alias("inflow"),
        half_even(half_even(money_sum(features.is_debit()), 2)).alias("outflow"),
        (half_even(F.sum("running"), 2) / F.count("running")).alias("bal_avg"),
        F.stddev_pop("running").alias("bal_sd"),
        F.min("running").alias("bal_min"),
        F.max("running").alias("bal_max"),
        F.max_by("running", F.when(F.col("running").isNotNull(), F.col("seq"))).alias("bal_last"),
        count_if(F.col("is_bounce")).alias("bounces"),
    )
    dup = (
        run.groupBy(*keys, F.lower(F.trim("narration")).alias("t"), half_even("amount", 2).alias("a"))
        .agg((F.count(F.lit(1)) - 1).alias("x"))
        .groupBy(*keys)
        .agg(F.sum("x").alias("duplicates"))
    )
    counts = anomaly_counts(run, keys)
    flagged = counts.withColumn("flagged", F.least("flagged", F.lit(12)))
    t = base.join(dup, keys, "left").join(flagged, keys, "left")
    net = F.col("inflow") - F.col("outflow")
    flag = F.coalesce("flagged", F.lit(0))
    index = half_even(100 * flag / F.col("volume"))
    vol_idx = F.when(
        F.coalesce(F.col("bal_avg"), F.lit(0.0)) != 0, half_even(F.col("bal_sd") / F.col("bal_avg"), 3)
    ).otherwise(0.0)
    return t.select(
        *keys, "label", "inflow", "outflow", net.alias("net"),
        F.when(F.col("outflow") != 0, half_even(F.col("inflow") / F.col("outflow"), 2))
        .otherwise(F.when(F.col("inflow") != 0, 9.99).otherwise(0.0)).alias("dscr"),
        F.coalesce(
            F.when(F.col("outflow") != 0, half_even(F.col("bal_last") / F.col("outflow"), 1)), F.lit(0.0)
        ).alias("runway_months"),
        F.when(net > F.col("inflow") * 0.3, "Strong").when(net >= 0, "Healthy").otherwise("Tight").alias("cash_label"),
        "volume",
        half_even(F.col("volume") / F.greatest(F.col("days"), F.lit(1)), 2).alias("per_day"),
        F.col("duplicates").cast("bigint").alias("duplicates"),
        flag.cast("bigint").alias("flagged"), index.alias("anomaly_index"),
        F.when(index > 10, "Review").when(flag > 0, "Watch").otherwise("Clean").alias("fraud_label"),
        half_even(F.coalesce("bal_avg", F.lit(0.0))).alias("adb"),
        half_even(F.coalesce("bal_min", F.lit(0.0))).alias("min_bal"),
        half_even(F.coalesce("bal_max", F.lit(0.0))).alias("peak_bal"),
        vol_idx.alias("volatility_index"), "bounces",
        F.when(vol_idx < 0.15, "Very Stable").when(vol_idx < 0.35, "Stable").otherwise("Volatile").alias("balance_label"),
    )


def trajectory(txns: DataFrame, final_scores: DataFrame | None = None, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """Score after each month on all rows so far; the last month shows the final score.

    Works on month aggregates: sums, sums of squares and extremes are accumulated
    over months, so no month is ever joined back to earlier transactions.
    """
    keys = ["account_id"]
    rows = ledger.tagged(ledger.month_buckets(txns))
    first_known = rows.groupBy("account_id").agg(
        F.min_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq"))).alias("opening_balance")
    )
    run = ledger.running_balance(rows, first_known)
    mid = run.groupBy("account_id").agg(F.avg("running").alias("shift"))
    run = scale.attach(run, mid, keys)
    dev = F.col("running") - F.col("shift")
    month = run.groupBy("account_id", "bucket").agg(
        F.max("shift").alias("shift"),
        F.count(F.lit(1)).alias("n"),
        F.count("txn_date").alias("dated"),
        F.min("txn_date").alias("d0"),
        F.max("txn_date").alias("d1"),
        money_sum(features.is_credit()).alias("tc"),
        money_sum(features.is_debit()).alias("td"),
        count_if(F.col("is_bounce")).alias("bounces"),
        money_sum(features.is_debit() & F.col("is_cash")).alias("cash_out"),
        F.count("balance").alias("known"),
        F.count("running").alias("rn"),
        F.sum(dev).alias("s1"),
        F.sum(dev * dev).alias("s2"),
        F.min("running").alias("r_min"),
    )
    # A month key may spread over buckets (undated rows, chunk mode): count it once and
    # let each bucket add the growth of the squared running month total.
    per_key = (
        rows.where(features.is_credit())
        .groupBy("account_id", "bucket", F.coalesce(month_of("txn_date"), F.lit("?")).alias("month"))
        .agg(F.sum("amount").alias("credit"))
        .where("credit > 0")
    )
    k = W.partitionBy("account_id", "month").orderBy("bucket")
    upto = F.sum("credit").over(k.rowsBetween(W.unboundedPreceding, 0))
    by_bucket = (
        per_key.withColumn("cum", upto)
        .withColumn("new", F.when(F.row_number().over(k) == 1, 1).otherwise(0))
        .withColumn("sq", F.col("cum") * F.col("cum") - F.pow(F.col("cum") - F.col("credit"), F.lit(2.0)))
        .groupBy("account_id", "bucket")
        .agg(F.sum("new").alias("cm"), F.sum("credit").alias("c1"), F.sum("sq").alias("c2"))
    )
    w = W.partitionBy("account_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    last = W.partitionBy("account_id").orderBy(F.col("bucket").desc())
    t = month.join(by_bucket, ["account_id", "bucket"], "left").na.fill(0, ["cm", "c1", "c2"])
    tot = ["n", "dated", "tc", "td", "bounces", "cash_out", "known", "rn", "s1", "s2", "cm", "c1", "c2"]
    t = t.select(
        "account_id", "bucket", "shift", F.row_number().over(last).alias("from_end"),
        F.min("d0").over(w).alias("d0"), F.max("d1").over(w).alias("d1"), F.min("r_min").over(w).alias("r_min"),
        *[F.sum(x).over(w).alias(x) for x in tot],
    )
    has = F.col("known") > 0
    mean = F.col("s1") / F.col("rn")
    cmean = F.col("c1") / F.col("cm")
    t = (
        t.withColumn("tc", half_even("tc", 2)).withColumn("td", half_even("td", 2))
        .withColumn("r_avg", F.when(has, F.col("shift") + mean))
        .withColumn("r_sd", F.when(has, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("rn") - mean * mean))))
        .withColumn("r_min", F.when(has, F.col("r_min")))
        .withColumn("rn", F.when(has, F.col("rn")).otherwise(0))
        .withColumn(
            "stability",
            F.when(F.col("cm") < 2, 0.6).otherwise(
                F.greatest(
                    F.lit(0.0),
                    1 - F.sqrt(F.greatest(F.lit(0.0), F.col("c2") / F.col("cm") - cmean * cmean)) / cmean,
                )
            ),
        )
    )
    vec = features.vector_from_totals(t)
    scored = credit_score(vec, cfg=cfg).select("account_id", "bucket", "score", "pd")
    out = scored.join(t.select("account_id", "bucket", "from_end"), ["account_id", "bucket"])
    if final_scores is not None:
        fin = final_scores.select("account_id", F.col("score").alias("_fs"), F.col("pd").alias("_fp"))
        out = out.join(fin, "account_id", "left")
        lastm = (F.col("from_end") == 1) & F.col("_fs").isNotNull()
        out = out.withColumn("score", F.when(lastm, F.col("_fs")).otherwise(F.col("score"))).withColumn(
            "pd", F.when(lastm, F.col("_fp")).otherwise(F.col("pd"))
        )
    return out.select(
        "account_id", "bucket", "score", "pd", grade("score", cfg.grade_low_min, cfg.grade_medium_min).alias("grade")
    )
