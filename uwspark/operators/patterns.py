"""Fraud typologies, verdicts, concern scores and corpus views of the four domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.columns import count_if, half_even, sql_text, zone
from . import scale
from .monitor import long_metrics


@dataclass(frozen=True)
class Typology:
    """A named signature: SQL conditions on the metric row and the figure that proves it."""

    name: str
    match: str
    elevated: str
    figure: str
    unit: str
    hard: bool = False

    def verdict_sql(self) -> str:
        return f"CASE WHEN {self.match} THEN 'match' WHEN {self.elevated} THEN 'elevated' ELSE 'none' END"


# Names, limits and the hard flag are fixed values.
TYPOLOGIES: dict[str, list[Typology]] = {
    "aa": [
        Typology("Money in, then straight back out", "same_day_inout >= 1", "same_day_ratio > 0.15", "same_day_inout", "time(s)", True),
        Typology("Money moving in circles", "same_day_ratio > 0.30", "same_day_ratio > 0.15", "same_day_ratio * 100", "% of deposits left", True),
        Typology("One oversized deposit", "largest_credit_pct > 2.0", "largest_credit_pct > 1.0", "largest_credit_pct", "x one month's income", True),
        Typology("Cash kept just under ₹50,000", "structuring_credits >= 3", "structuring_credits >= 1", "structuring_credits", "cash deposit(s)"),
        Typology("Same payment repeated fast", "rapid_dup >= 3", "rapid_dup >= 2", "rapid_dup", "repeated payment(s)"),
        Typology("Many payments reversed", "reversal_count > 5", "reversal_count > 3", "reversal_count", "reversed payment(s)"),
        Typology("Too many round-number deposits", "round_credits >= 4", "round_credits >= 2", "round_credits", "round deposit(s)"),
    ],
    "upi": [
        Typology("Money received then moved straight out", "rapid_pass_through_count >= 3", "rapid_pass_through_count >= 1", "rapid_pass_through_count", "event(s)", True),
        Typology("Transfers just under a reporting threshold", "structuring_count >= 3", "structuring_count >= 1", "structuring_count", "transfer(s)", True),
        Typology("High-risk merchant spend", "high_risk_mcc_spend_pct > 20", "high_risk_mcc_spend_pct > 8", "high_risk_mcc_spend_pct", "% high-risk", True),
        Typology("One counterparty dominates P2P flow", "single_counterparty_dominance_pct > 85", "single_counterparty_dominance_pct > 60", "single_counterparty_dominance_pct", "% with one party"),
        Typology("Sudden transaction spike", "sudden_spike_ratio > 6", "sudden_spike_ratio > 3", "sudden_spike_ratio", "x the daily average"),
        Typology("Many failed transactions", "failed_ratio > 0.15", "failed_ratio > 0.08", "failed_ratio * 100", "% failed"),
        Typology("Too many round-number transfers", "round_amount_ratio > 0.4", "round_amount_ratio > 0.25", "round_amount_ratio * 100", "% round"),
    ],
    "bbps": [
        Typology("Duplicate bill payments", "duplicate_payment_count >= 2", "duplicate_payment_count >= 1", "duplicate_payment_count", "duplicate(s)", True),
        Typology("Same bill paid twice fast", "rapid_repeat_count >= 2", "rapid_repeat_count >= 1", "rapid_repeat_count", "rapid repeat(s)", True),
        Typology("One bill far above normal", "bill_spike_ratio > 4.0", "bill_spike_ratio > 2.5", "bill_spike_ratio", "x the average bill", True),
        Typology("Almost all spend on one utility", "single_utility_dominance_pct > 90", "single_utility_dominance_pct > 75", "single_utility_dominance_pct", "% on one utility"),
        Typology("Too many round-number payments", "round_amount_ratio > 0.5", "round_amount_ratio > 0.3", "round_amount_ratio * 100", "% round"),
        Typology("Vague / unclassified bill narrations", "vague_narration_ratio > 0.4", "vague_narration_ratio > 0.2", "vague_narration_ratio * 100", "% unclassified"),
        Typology("Missed utility payments piling up", "missed_payment_count >= 4", "missed_payment_count >= 2", "missed_payment_count", "missed payment(s)"),
    ],
    "gst": [
        Typology("Sales figures don't match", "gstr1_vs_gstr3b_mismatch_pct > 15", "gstr1_vs_gstr3b_mismatch_pct > 8", "gstr1_vs_gstr3b_mismatch_pct", "% gap", True),
        Typology("Claiming more tax credit than allowed", "itc_claim_ratio > 1.10", "itc_claim_ratio > 1.02", "itc_claim_ratio", "x available", True),
        Typology("Skipped GST filings", "missed_return_count >= 2", "missed_return_count >= 1", "missed_return_count", "return(s) never filed", True),
        Typology("Sales falling sharply", "turnover_decline_percentage > 40 OR consecutive_declining_quarters >= 3", "turnover_decline_percentage > 20", "turnover_decline_percentage", "% down"),
        Typology("Sales jumped unrealistically", "turnover_growth_yoy > 200", "turnover_growth_yoy > 120", "turnover_growth_yoy", "% up in a year"),
        Typology("Depends on a single customer", "top_buyer_sales_percentage > 70", "top_buyer_sales_percentage > 50", "top_buyer_sales_percentage", "% of sales"),
    ],
}


def typologies(metrics: DataFrame, domain: str, key: str = "account_id") -> DataFrame:
    """Long table (key, ord, typology, hard, verdict, evidence)."""
    items = [
        f"named_struct('ord', {i}, 'typology', {sql_text(t.name)}, 'hard', {t.hard}, 'verdict', {t.verdict_sql()}, "
        f"'evidence', concat(format_number(cast({t.figure} as double), 2), {sql_text(' ' + t.unit)}))"
        for i, t in enumerate(TYPOLOGIES[domain])
    ]
    return metrics.selectExpr(key, f"inline(array({', '.join(items)}))")


def typology_flags(typ: DataFrame, key: str = "account_id") -> DataFrame:
    return typ.groupBy(key).agg(
        F.max(F.col("hard") & (F.col("verdict") == "match")).alias("hard_match"),
        F.max(F.col("verdict") != "none").alias("soft"),
    )


def verdicts(
    flags: DataFrame, worst: DataFrame, models: DataFrame | None = None, key: str = "account_id"
) -> DataFrame:
    """Verdict, concern score, zone and the two status boxes of every entity.

    `models` may bring `fraud_p` and `anomaly_p`; a fraud probability of 0.6 escalates.
    """
    t = flags.join(worst, key)
    if models is not None:
        t = t.join(models.select(key, "fraud_p", "anomaly_p"), key, "left")
    else:
        t = t.withColumn("fraud_p", F.lit(0.0)).withColumn("anomaly_p", F.lit(0.0))
    t = t.na.fill(0.0, ["fraud_p", "anomaly_p"])
    fp, ap, band = F.col("fraud_p"), F.col("anomaly_p"), F.col("worst_band")
    hit = F.col("hard_match") | (fp >= 0.6)
    signals = {
        "typology": F.when(hit, 100.0).otherwise(0.0),
        "fraud_model": fp * 100.0,
        "anomaly_model": ap * 75.0,
        "anomaly_metric": F.least(F.lit(100.0), F.col("worst_z") / 3.5 * 60.0),
    }
    top = F.greatest(*signals.values())
    reason = None
    for name, value in signals.items():
        reason = F.when(value == top, name) if reason is None else reason.when(value == top, name)
    concern = half_even(top).cast("bigint")
    return t.select(
        key,
        F.when(hit, "MATCHES FRAUD TYPOLOGY")
        .when((band == "extreme") | (F.col("soft") & (band == "elevated")), "ELEVATED ANOMALY SIGNATURE")
        .when(F.col("soft") | (band == "elevated"), "SOME ELEVATED SIGNALS")
        .otherwise("CONSISTENT WITH TRAINING")
        .alias("verdict"),
        concern.alias("concern_score"),
        zone(concern).alias("zone"),
        F.when(zone(concern) == "good", "none").otherwise(reason).alias("reason"),
        F.least(F.lit(100.0), half_even(F.col("worst_z") / 3.5 * 60.0, 1)).alias("pattern_score"),
        F.when(hit, "alert").when(F.col("soft") | (fp >= 0.3), "review").otherwise("clear").alias("fraud_box"),
        F.when((ap >= 0.7) | (band == "extreme"), "alert")
        .when((ap >= 0.4) | (band == "elevated"), "review")
        .otherwise("clear")
        .alias("anomaly_box"),
    )


#: What a box talks about, by domain; the sentences of `status_boxes` are built from it.
SUBJECT = {"aa": "bank account", "gst": "tax filings", "upi": "payments", "bbps": "bill payments"}


def _box_detail(domain: str, box: str, status: str) -> str:
    found = {
        ("fraud", "clear"): "No known fraud typology matches the {}.",
        ("fraud", "review"): "A soft typology or a raised model probability concerns the {}; read them by hand.",
        ("fraud", "alert"): "A hard fraud typology matches the {}, or the model is confident of one.",
        ("anomaly", "clear"): "All metrics of the {} lie within their usual bands.",
        ("anomaly", "review"): "At least one metric of the {} lies above its usual band.",
        ("anomaly", "alert"): "At least one metric of the {} lies far outside its usual band.",
    }
    return found[box, status].format(SUBJECT[domain])


def status_boxes(verdict: DataFrame, domain: str, key: str = "account_id") -> DataFrame:
    """Fraud and anomaly box of every entity with headline and detail text (a table of six rows)."""
    rows = [
        (box, status, head, _box_detail(domain, box, status))
        for (of, box, status), head in fixed.BOX_HEADLINES.items()
        if of == domain
    ]
    texts = verdict.sparkSession.createDataFrame(rows, "box string, status string, headline string, detail string")
    long = verdict.selectExpr(
        key, "inline(array(named_struct('box', 'fraud', 'status', fraud_box), named_struct('box', 'anomaly', 'status', anomaly_box)))"
    )
    return long.join(F.broadcast(texts), ["box", "status"])


def corpus_typologies(typ: DataFrame, key: str = "account_id") -> DataFrame:
    """How many entities each typology fires on, with the first evidence."""
    at = lambda v: F.min_by("evidence", F.when(F.col("verdict") == v, F.col(key)))
    return typ.groupBy("ord", "typology", "hard").agg(
        count_if(F.col("verdict") == "match").alias("matched"),
        count_if(F.col("verdict") == "elevated").alias("elevated"),
        count_if(F.col("verdict") == "none").alias("clear"),
        F.coalesce(at("match"), at("elevated"), F.lit("")).alias("worst_evidence"),
    )


def corpus_metrics(metrics: DataFrame, domain: str, key: str = "account_id") -> DataFrame:
    """Upper median, maximum and count above two typical spreads, per metric."""
    from .monitor import metric_table

    declared = metric_table(metrics.sparkSession, domain)
    long = long_metrics(metrics, list(fixed.PATTERN_METRICS[domain]), [key]).where("value is not null")
    counts = scale.value_counts(long, ["metric"], "value")
    mid = scale.lookup_ranks(counts, ["metric"], {"mid": lambda n: F.floor(n / 2)}).select(
        "metric", half_even("v", 3).alias("median")
    )
    # The declared metrics are a handful of rows.
    flagged = (
        counts.join(F.broadcast(declared), "metric")
        .groupBy("ord", "metric", "label")
        .agg(
            half_even(F.max("v"), 3).alias("max"),
            F.coalesce(
                F.sum(F.when(F.col("v") > F.col("f_med") + F.col("f_mad") / 0.6745 * 2.0, F.col("n"))), F.lit(0)
            ).cast("bigint").alias("flagged"),
        )
    )
    return flagged.join(mid, "metric")


# Weak anomaly labels: any metric past its limit (fixed values).
ANOMALY_LIMITS = {
    "aa": "reversal_count > 3 OR bounce_count > 0 OR neg_points > 0 OR cash_deposit_ratio > 0.40 "
    "OR inflow_cv > 0.60 OR largest_credit_pct > 1.0",
    "gst": "turnover_decline_percentage > 20 OR consecutive_declining_quarters >= 2 OR late_return_count >= 2",
    "bbps": "single_utility_dominance_pct > 75 OR vague_narration_ratio > 0.2 OR missed_payment_count >= 2 "
    "OR bill_spike_ratio > 2.5",
    "upi": "sudden_spike_ratio > 3 OR failed_ratio > 0.08 OR round_amount_ratio > 0.25 "
    "OR single_counterparty_dominance_pct > 60",
}


def weak_labels(metrics: DataFrame, domain: str, key: str = "account_id") -> DataFrame:
    """Fraud label = any hard typology match; anomaly label = the domain's metric limits."""
    hard = " OR ".join(f"({t.match})" for t in TYPOLOGIES[domain] if t.hard)
    return metrics.select(
        key,
        F.coalesce(F.expr(hard), F.lit(False)).cast("int").alias("fraud_label"),
        F.coalesce(F.expr(ANOMALY_LIMITS[domain]), F.lit(False)).cast("int").alias("anomaly_label"),
    )


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Display order of a table with a fixed, small number of rows."""
    return df.withColumn("position", F.row_number().over(W.orderBy(*order)).cast("bigint"))
