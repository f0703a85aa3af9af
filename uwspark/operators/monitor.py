"""Robust baselines, outlier scores, drift and guard checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import fixed
from ..functions.columns import clip, count_if, half_even, psi_band, z_band
from ..staging import stage
from . import scale


def long_metrics(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """(keys, metric, value) of the chosen numeric columns."""
    items = ", ".join(f"named_struct('metric', '{n}', 'value', cast({n} as double))" for n in names)
    return df.selectExpr(*keys, f"inline(array({items}))")


def metric_table(spark: SparkSession, domain: str) -> DataFrame:
    """Declared metrics of a domain: position, label, fallback median and spread (at most eleven rows)."""
    rows = [(i, m, l, float(a), float(b)) for i, (m, (l, a, b)) in enumerate(fixed.PATTERN_METRICS[domain].items())]
    return spark.createDataFrame(rows, "ord int, metric string, label string, f_med double, f_mad double")


def robust_profile(
    long: DataFrame, min_samples: int = 8, tails: dict[str, float] | None = None, digits: int = 5
) -> DataFrame:
    """Median, MAD (population spread, then 1, when it is 0) and tail percentiles per metric."""
    tails = tails or {"p95": 0.95}
    stats = scale.median_abs_deviation(long, ["metric"], "value", tails)
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    return (
        stats.where(F.col("n") >= min_samples)
        .select(
            "metric",
            "n",
            half_even("med", digits).alias("median"),
            half_even(F.coalesce(nonzero("mad"), nonzero("sd"), F.lit(1.0)), digits).alias("mad"),
            *[half_even(t, digits).alias(t) for t in tails],
        )
    )


def compare_to_baseline(long: DataFrame, declared: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """Modified z of every metric against its trained row, else the declared fallback."""
    # Both tables have one row per declared metric.
    base = declared.select("metric", "label", "ord", "f_med", "f_mad")
    if trained is not None:
        base = base.join(trained.select("metric", F.col("median"), F.col("mad")), "metric", "left")
    else:
        base = base.withColumn("median", F.lit(None).cast("double")).withColumn("mad", F.lit(None).cast("double"))
    med, mad = F.coalesce("median", "f_med"), F.greatest(F.coalesce("mad", "f_mad"), F.lit(1e-9))
    return (
        long.where("value is not null")
        .join(F.broadcast(base), "metric")
        .withColumn("z", half_even(0.6745 * F.abs(F.col("value") - med) / mad, 2))
        .select(
            *long.columns,
            "label",
            "ord",
            half_even(med, 4).alias("baseline"),
            "z",
            z_band("z").alias("band"),
            F.when(F.col("median").isNotNull(), "training").otherwise("typical").alias("basis"),
        )
    )


def worst_z(compared: DataFrame, key: str = "account_id") -> DataFrame:
    out = compared.groupBy(key).agg(F.max("z").alias("worst_z"))
    return out.withColumn("worst_band", z_band("worst_z"))


def outlier_scores(vector: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """0..100 outlier score of an underwriting vector and the features at or over 3.5."""
    spark = vector.sparkSession
    rows = [(m, a, b) for m, (a, b) in fixed.OUTLIER_FALLBACK.items()]
    base = spark.createDataFrame(rows, "metric string, f_med double, f_mad double")
    if profile is not None:
        base = base.join(profile.select("metric", "median", "mad"), "metric", "left")
    else:
        base = base.withColumn("median", F.lit(None).cast("double")).withColumn("mad", F.lit(None).cast("double"))
    mad = F.when(F.col("median").isNotNull(), F.greatest("mad", F.lit(1e-9))).otherwise(F.col("f_mad"))
    z = 0.6745 * F.abs(F.col("value") - F.coalesce("median", "f_med")) / mad
    scored = (
        long_metrics(vector, list(fixed.OUTLIER_FALLBACK))
        .where("value is not null")
        .join(F.broadcast(base), "metric")
        .withColumn("z", z)
    )
    # At most eleven flags per account.
    return scored.groupBy("account_id").agg(
        F.least(F.lit(100.0), half_even(F.max("z") / 3.5 * 60.0, 1)).alias("outlier_score"),
        (F.max("z") >= 3.5).alias("is_outlier"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("z") >= 3.5, F.col("metric")))), ",").alias("flags"),
    )


def clamped(vector: DataFrame) -> DataFrame:
    """Every guarded feature forced into its bounds, with the list of the ones touched."""
    present = [f for f in fixed.GUARD_BOUNDS if f in vector.columns]
    notes = []
    values = {}
    for f in present:
        lo, hi = fixed.GUARD_BOUNDS[f]
        v = F.col(f).cast("double")
        notes.append(
            F.when(v.isNull(), F.lit(f"{f} not numeric")).when((v < lo) | (v > hi), F.lit(f"{f} clamped"))
        )
        values[f] = F.coalesce(clip(v, lo, hi), F.lit(lo))
    missing = [F.lit(f"{f} missing") for f in fixed.GUARD_BOUNDS if f not in present]
    out = vector.withColumn("warnings", F.array_compact(F.array(*notes, *missing)))
    out = out.withColumns(values)
    for f in fixed.GUARD_BOUNDS:
        if f not in present:
            out = out.withColumn(f, F.lit(0.5 if f == "income_stability" else fixed.GUARD_BOUNDS[f][0]))
    return out


# ------------------------------------------------------------------------------- PSI


def psi(
    reference: DataFrame, recent: DataFrame, bins: int = 10, min_ref: int = 20, min_recent: int = 10
) -> DataFrame:
    """Population stability index per metric of two long tables (metric, value).

    Decile edges come from exact percentiles of the reference; both sides are then
    reduced to one count per (metric, bin).  Values outside the edges fall out of
    every bin but stay in the divisor.
    """
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    ref_counts = scale.value_counts(reference, ["metric"], "value")
    rec_counts = scale.value_counts(recent, ["metric"], "value")
    edges = scale.exact_percentiles(ref_counts, ["metric"], names).select(
        "metric", F.array_distinct(F.array(*names)).alias("edges")
    )

    def shares(counts: DataFrame, out: str) -> DataFrame:
        # One row of edges per metric name.
        j = counts.join(F.broadcast(edges), "metric")
        below = F.size(F.filter("edges", lambda e: e <= F.col("v")))
        top = F.size("edges")
        at = F.when((F.col("v") < F.element_at("edges", 1)) | (F.col("v") > F.element_at("edges", -1)), None)
        return (
            j.withColumn("bin", at.otherwise(F.least(below, top - 1)))
            .groupBy("metric", "bin")
            .agg(F.sum("n").alias(out))
        )

    sizes = lambda c, out: c.groupBy("metric").agg(F.sum("n").alias(out))
    grid = edges.select("metric", F.size("edges").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).where(
        "bin < k"
    )
    share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(n), F.lit(1e-4))
    t = (
        grid.join(shares(ref_counts, "rc"), ["metric", "bin"], "left")
        .join(shares(rec_counts, "cc"), ["metric", "bin"], "left")
        .join(sizes(ref_counts, "rn"), "metric")
        .join(sizes(rec_counts, "cn"), "metric")
    )
    e, a = share("rc", "rn"), share("cc", "cn")
    out = t.groupBy("metric").agg(
        F.sum((a - e) * F.log(a / e)).alias("raw"), F.max("k").alias("k"), F.max("rn").alias("rn"), F.max("cn").alias("cn")
    )
    ok = (F.col("k") >= 3) & (F.col("rn") >= min_ref) & (F.col("cn") >= min_recent)
    all_metrics = sizes(ref_counts, "ref_n").join(sizes(rec_counts, "recent_n"), "metric", "left")
    return (
        all_metrics.join(out, "metric", "left")
        .select(
            "metric", "ref_n", F.coalesce("recent_n", F.lit(0)).alias("recent_n"),
            F.coalesce(F.when(ok, F.col("raw")), F.lit(0.0)).alias("psi"),
        )
    )


def drift_report(reference: DataFrame, recent: DataFrame) -> DataFrame:
    """PSI, band and means per feature, with the overall status of the worst one."""
    means = lambda d, out: d.groupBy("metric").agg(half_even(half_even(F.sum("value"), 6) / F.count("value"), 3).alias(out))
    t = (
        psi(reference, recent)
        .join(means(reference, "reference_mean"), "metric", "left")
        .join(means(recent, "recent_mean"), "metric", "left")
    )
    # One row per feature name.
    worst = F.max("psi").over(W.partitionBy())
    return t.select(
        "metric",
        half_even("psi", 3).alias("psi"),
        psi_band("psi").alias("band"),
        "reference_mean",
        "recent_mean",
        psi_band(worst).alias("status"),
    )


def halves(history: DataFrame, coarse: Sequence[str], order: Sequence[str | Column], least: int = 20) -> DataFrame:
    """Adds `size` and `half`: the earliest half of a time-ordered history is `reference`, the last half `recent`.

    Places come from the counts of the `coarse` blocks, so no task sorts more than one block; the middle
    row of an odd history is in neither half.
    """
    placed = scale.number_rows(history, [], coarse, order, "_pos")
    # one row
    size = history.agg(F.count(F.lit(1)).alias("size"))
    half = F.greatest(F.lit(least), F.floor(F.col("size") / 2))
    return (
        placed.join(F.broadcast(size))
        .withColumn("half", F.when(F.col("_pos") < half, "reference").when(F.col("_pos") >= F.col("size") - half, "recent"))
        .drop("_pos")
    )


def drift_by_halves(
    history: DataFrame, features: Sequence[str], score: str, coarse: Sequence[str], order: Sequence[str | Column], least: int = 20
) -> DataFrame:
    """Drift of every feature and of the score between the halves of a history.

    (metric, kind, psi, band, reference_mean, recent_mean, reference_n, recent_n, status): the status is the
    band of the worst feature; the score has a band of its own.  A history of fewer than two times `least`
    rows gives one row with the status `insufficient-data`.
    """
    spark = history.sparkSession
    names = [*features, score]
    split = stage(halves(history, coarse, order, least).select("size", "half", *[F.col(n).cast("double").alias(n) for n in names]))
    long = long_metrics(split.where("half is not null"), names, ["half"])
    part = lambda h: long.where(F.col("half") == h).select("metric", "value")
    means = lambda h, out: part(h).where("value is not null").groupBy("metric").agg(
        half_even(half_even(F.sum("value"), 6) / F.count("value"), 3).alias(out)
    )
    kinds = spark.createDataFrame([(n, "prediction" if n == score else "feature") for n in names], "metric string, kind string")
    # A handful of metric names.
    t = (
        F.broadcast(kinds).join(psi(part("reference"), part("recent")).select("metric", F.col("psi").alias("_psi")), "metric", "left")
        .join(means("reference", "reference_mean"), "metric", "left")
        .join(means("recent", "recent_mean"), "metric", "left")
        .withColumn("_psi", F.coalesce("_psi", F.lit(0.0)))
    )
    sizes = split.agg(
        F.count_if(F.col("half") == "reference").alias("reference_n"), F.count_if(F.col("half") == "recent").alias("recent_n"), F.count(F.lit(1)).alias("_n")
    )
    worst = F.max(F.when(F.col("kind") == "feature", F.col("_psi"))).over(W.partitionBy())
    full = t.join(F.broadcast(sizes)).where(F.col("_n") >= 2 * least).select(
        "metric", "kind", half_even("_psi", 3).alias("psi"), psi_band("_psi").alias("band"),
        "reference_mean", "recent_mean", "reference_n", "recent_n", psi_band(worst).alias("status"),
    )
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    short = sizes.where(F.col("_n") < 2 * least).select(
        none_s.alias("metric"), none_s.alias("kind"), none_d.alias("psi"), none_s.alias("band"), none_d.alias("reference_mean"),
        none_d.alias("recent_mean"), "reference_n", "recent_n", F.lit("insufficient-data").alias("status"),
    )
    return full.unionByName(short)


# ----------------------------------------------------------------------------- guards


def guard_transactions(txns: DataFrame, max_amount: float = 1e9) -> DataFrame:
    """Sanitise rows: implausible amounts out, control characters off, type settled."""
    amt = F.col("amount")
    kind = F.upper(F.coalesce("txn_type", F.lit("")))
    return txns.where(amt.isNull() | ((amt >= 0) & (amt <= max_amount))).withColumns(
        {
            "narration": F.regexp_replace(F.coalesce("narration", F.lit("")), r"[\x00-\x08\x0A-\x1F]", ""),
            "txn_type": F.when(kind.isin("DEBIT", "CREDIT"), kind).when(amt.isNotNull(), "CREDIT"),
            "amount": F.abs(amt),
        }
    )


def guard_report(raw: DataFrame, reported: DataFrame, max_amount: float = 1e9) -> DataFrame:
    """Per account: dropped rows, recomputed totals, and which reported figures disagree.

    `reported`: account_id, total_credit, total_debit, opening_balance, closing_balance.
    """
    ok = guard_transactions(raw, max_amount)
    sums = ok.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.coalesce(F.sum(F.when(F.col("txn_type") == "CREDIT", F.col("amount"))), F.lit(0.0)).alias("credit_sum"),
        F.coalesce(F.sum(F.when(F.col("txn_type") == "DEBIT", F.col("amount"))), F.lit(0.0)).alias("debit_sum"),
    )
    seen = raw.groupBy("account_id").agg(F.count(F.lit(1)).alias("rows_in"))
    t = seen.join(sums, "account_id", "left").na.fill(0, ["rows_kept", "credit_sum", "debit_sum"]).join(
        reported, "account_id", "left"
    )

    def off(rep: str, total: str) -> Column:
        return F.coalesce(
            F.col(rep).isNotNull() & (F.col(total) > 0) & (F.abs(F.col(rep) - F.col(total)) > 0.02 * F.col(total)),
            F.lit(False),
        )

    expected = F.col("opening_balance") + F.col("credit_sum") - F.col("debit_sum")
    close = F.col("closing_balance")
    limit = F.greatest(F.lit(1.0), 0.02 * F.abs(F.when(close != 0, close).otherwise(1.0)))
    return t.select(
        "account_id",
        (F.col("rows_in") - F.col("rows_kept")).alias("dropped"),
        half_even("credit_sum", 2).alias("total_credit"),
        half_even("debit_sum", 2).alias("total_debit"),
        off("total_credit", "credit_sum").alias("credit_drift"),
        off("total_debit", "debit_sum").alias("debit_drift"),
        F.coalesce(F.abs(expected - close) > limit, F.lit(False)).alias("closing_mismatch"),
    )


# Plausible ranges of a training table (fixed values).
TRAINING_RANGES = {
    "bounce_count": (0, 100), "overdraft_count": (0, 100), "negative_balance_days": (0, 366),
    "emi_to_credit_ratio": (0, 5), "existing_debt_burden": (0, 5), "income_consistency_score": (0, 1),
    "credit_regularity_score": (0, 1), "cash_flow_stability_score": (0, 1), "monthly_net_cash_flow": (-5, 5),
    "credit_debit_ratio": (0, 100), "average_monthly_balance": (-1e8, 1e9), "monthly_income": (0, 1e9),
    "age": (18, 100),
}
LABEL_COLUMNS = ["default", "is_default", "target", "label"]


def validate_training_rows(df: DataFrame, order: str) -> DataFrame:
    """Add `reason`: the first check a row fails, null when accepted.

    Duplicates are found by grouping on a hash of the row and keeping the first by
    `order`.  Rows of one hash are dealt over salts: each salt sums its own rows, the
    salts of a hash meet as one row each, and the answer goes back by (hash, salt), so
    a row repeated any number of times fills no single task.
    """
    cols = [c for c in df.columns if c != order]
    filled = F.lit(False)
    for c in cols:
        filled = filled | F.col(c).isNotNull()
    marked = df.withColumn("_h", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = marked.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = marked.groupBy("_h", "_salt").agg(F.min(order).alias("_least"))
    firsts = part.groupBy("_h").agg(F.min("_least").alias("_first"))
    marked = marked.join(part.select("_h", "_salt").join(firsts, "_h").hint("merge"), ["_h", "_salt"])
    reason = F.when(~filled, "empty row").when(F.col(order) != F.col("_first"), "exact duplicate")
    for c, (lo, hi) in TRAINING_RANGES.items():
        if c in cols:
            v = F.col(c).try_cast("double")
            reason = reason.when((v < lo) | (v > hi), f"{c} out of range")
    for c in LABEL_COLUMNS:
        if c in cols:
            v = F.col(c).try_cast("double")
            reason = reason.when(~F.coalesce(v.isin(0.0, 1.0), F.lit(False)), f"{c} not 0/1")
    return marked.withColumn("reason", reason).drop("_h", "_salt", "_first")


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def promotion_guard(candidate: float, active: float | None) -> dict:
    """A candidate model may not fall more than the limit below the active one."""
    if active is None:
        return {"promote": True, "drop": 0.0}
    drop = active - candidate
    return {"promote": drop <= fixed.MAX_REGRESSION, "drop": drop}


def overview(events: DataFrame, outliers: DataFrame, batches: DataFrame) -> DataFrame:
    """Monitoring headline: events by severity, outlier runs and rejected rows in one row."""
    e = events.agg(
        F.count(F.lit(1)).alias("events"),
        count_if(F.col("severity") == "critical").alias("critical"),
        count_if(F.col("severity") == "warning").alias("warnings"),
    )
    o = outliers.agg(count_if(F.col("is_outlier")).alias("outlier_runs"))
    b = batches.agg(F.coalesce(F.sum("rows_rejected"), F.lit(0)).cast("bigint").alias("rows_rejected"))
    # Three one-row aggregates side by side.
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(e).join(one(o), "_one").join(one(b), "_one").drop("_one")
