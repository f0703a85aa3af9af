"""Fraud and anomaly pattern models: two heads per domain over its metric rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import half_even
from ..operators import patterns
from ..sources import sinks
from ..staging import stage
from . import evaluation, heads
from .heads import Head

# The metrics each pattern model sees.
FEATURES: dict[str, dict[str, tuple[str, ...]]] = {
    "aa": {
        "fraud": ("same_day_ratio", "same_day_inout", "rapid_dup", "round_credits", "structuring_credits", "largest_credit_pct"),
        "anomaly": ("reversal_count", "bounce_count", "neg_points", "cash_deposit_ratio", "inflow_cv", "largest_credit_pct"),
    },
    "gst": {
        "fraud": ("gstr1_vs_gstr3b_mismatch_pct", "itc_claim_ratio", "missed_return_count"),
        "anomaly": (
            "turnover_decline_percentage",
            "consecutive_declining_quarters",
            "turnover_growth_yoy",
            "top_buyer_sales_percentage",
            "late_return_count",
        ),
    },
    "bbps": {
        "fraud": ("duplicate_payment_count", "rapid_repeat_count", "bill_spike_ratio", "round_amount_ratio"),
        "anomaly": ("single_utility_dominance_pct", "vague_narration_ratio", "missed_payment_count", "bill_spike_ratio"),
    },
    "upi": {
        "fraud": ("rapid_pass_through_count", "structuring_count", "high_risk_mcc_spend_pct", "single_counterparty_dominance_pct"),
        "anomaly": ("sudden_spike_ratio", "failed_ratio", "round_amount_ratio", "single_counterparty_dominance_pct"),
    },
}
KINDS = ("fraud", "anomaly")


def head_of(domain: str, kind: str) -> Head:
    return Head(f"{domain}_pattern_{kind}_model", f"{kind}_label", "classifier", FEATURES[domain][kind], classes=("0", "1"))


@dataclass(frozen=True)
class Fitted:
    """A fitted head, or, where all training rows carry one label, that label."""

    head: Head
    model: PipelineModel | None
    only: float = 0.0


def training_rows(metrics: DataFrame, domain: str, key: str) -> DataFrame:
    """Metric rows with both weak labels; features as numbers, missing ones 0."""
    names = sorted({f for kind in KINDS for f in FEATURES[domain][kind]})
    rows = metrics.select(key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names])
    return rows.join(patterns.weak_labels(metrics, domain, key), key)


def fit(rows: DataFrame, domain: str, algorithm: str = "gradient_boosting") -> dict[str, Fitted]:
    """The two pattern models of a domain; `rows` come from `training_rows`, staged."""
    ends = rows.agg(*[f(f"{kind}_label").alias(f"{kind}_{n}") for kind in KINDS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for kind in KINDS:
        head, low, high = head_of(domain, kind), ends[f"{kind}_lo"], ends[f"{kind}_hi"]
        if low is None or low == high:
            out[kind] = Fitted(head, None, float(low or 0))
        else:
            out[kind] = Fitted(head, heads.fit(rows, head, algorithm))
    return out


def probability(fitted: Fitted, rows: DataFrame, key: str) -> DataFrame:
    """(key, p, flag): probability of the pattern, three decimals, and whether it is at least a half."""
    if fitted.model is None:
        scored = rows.select(key, F.lit(fitted.only).alias("p"))
    else:
        scored = evaluation.probabilities(fitted.model, rows, fitted.head).select(key, half_even(F.element_at("p", 2), 3).alias("p"))
    return scored.withColumn("flag", F.col("p") >= 0.5)


def scored(models: dict[str, Fitted], rows: DataFrame, key: str) -> DataFrame:
    """(key, fraud_p, fraud_flag, anomaly_p, anomaly_flag) of every entity."""
    parts = [
        probability(models[kind], rows, key).select(key, F.col("p").alias(f"{kind}_p"), F.col("flag").alias(f"{kind}_flag")) for kind in KINDS
    ]
    return parts[0].join(parts[1], key)


def save(models: dict[str, Fitted], root: str, domain: str, version: int) -> dict[str, str]:
    """Paths of the stored pipelines; heads with one label only have none."""
    return {k: sinks.save_model(f.model, root, domain, f.head.id, version) for k, f in models.items() if f.model is not None}


def load(domain: str, paths: dict[str, str], only: dict[str, float] | None = None) -> dict[str, Fitted]:
    """Stored models of a domain; `only` names the label of heads that were never fitted."""
    return {
        kind: Fitted(head_of(domain, kind), sinks.load_model(paths[kind]) if kind in paths else None, (only or {}).get(kind, 0.0))
        for kind in KINDS
    }


def evaluation_rows(rows: DataFrame, domain: str, key: str, k: int = 5, algorithm: str = "gradient_boosting") -> DataFrame:
    """Fold metrics of both heads, with the tolerance of pattern models."""
    staged = stage(rows)
    parts = [evaluation.evaluated(staged, head_of(domain, kind), key, k, algorithm, 0.06) for kind in KINDS]
    return parts[0].unionByName(parts[1])


def verdicts(metrics: DataFrame, worst: DataFrame, models: DataFrame, domain: str, key: str) -> DataFrame:
    """Verdict ladder with the model probabilities: a fraud probability of 0.6 and more escalates."""
    flags = patterns.typology_flags(patterns.typologies(metrics, domain, key), key)
    return patterns.verdicts(flags, worst, models, key)
