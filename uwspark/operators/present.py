"""Display views of a tax profile: curated metrics, back-cast series, nested business row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import half_even

# Field, label, kind in display order (fixed values).
CURATED = [
    ("annualised_gst_turnover", "Annualised Turnover", "money"),
    ("monthly_turnover", "Monthly Turnover", "money"),
    ("quarterly_turnover", "Quarterly Turnover", "money"),
    ("total_taxable_turnover", "Taxable Turnover (latest)", "money"),
    ("turnover_growth_yoy", "Turnover Growth YoY", "pct"),
    ("turnover_growth_qoq", "Turnover Growth QoQ", "pct"),
    ("filing_regularity_percentage", "Filing Regularity", "pct"),
    ("missed_return_count", "Missed Returns", "num"),
    ("late_return_count", "Late Returns", "num"),
    ("net_itc_amount", "Net ITC", "money"),
    ("itc_claimed_amount", "ITC Claimed", "money"),
    ("gstr3b_net_tax_liability", "Net Tax Liability", "money"),
    ("top_buyer_sales_percentage", "Top Buyer Share", "pct"),
    ("unique_buyer_count", "Unique Buyers", "num"),
    ("buyer_concentration_level", "Buyer Concentration", "text"),
    ("business_vintage_years", "Business Vintage (yrs)", "num"),
    ("gst_status", "GST Status", "text"),
]


def curated(profile: DataFrame) -> DataFrame:
    """Long table of the curated fields that carry a value."""
    items = []
    for i, (field, label, kind) in enumerate(CURATED):
        value = f"cast({field} as double)" if kind != "text" else "cast(null as double)"
        text = f"upper({field})" if kind == "text" else "cast(null as string)"
        items.append(
            f"named_struct('position', {i}, 'field', '{field}', 'label', '{label}', 'kind', '{kind}', "
            f"'value', {value}, 'text_value', {text})"
        )
    long = profile.selectExpr("gstin", f"inline(array({', '.join(items)}))")
    return long.where("value is not null or coalesce(text_value, '') <> ''")


def backcast(profile: DataFrame, months: int = 12) -> DataFrame:
    """Turnover series of a flat record, walked back from the last month by its growth."""
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    base = F.coalesce(nz("monthly_turnover"), nz("total_taxable_turnover"), F.col("annualised_gst_turnover") / 12)
    growth = F.greatest(F.lit(-0.4), F.least(F.lit(0.4), F.coalesce("turnover_growth_mom", F.lit(0.0)) / 100.0))
    t = profile.select("gstin", base.cast("double").alias("_b"), growth.cast("double").alias("_g")).where("_b > 0")
    walk = F.expr(
        f"aggregate(sequence(1, {months - 1}), array(_b), "
        "(a, k) -> concat(a, array(greatest(0.0D, rint(element_at(a, -1) / (1 + _g) * 100) / 100))))"
    )
    return t.select("gstin", F.posexplode(walk).alias("months_back", "turnover")).withColumn(
        "turnover", half_even("turnover", 2)
    )


def business_view(profile: DataFrame, heads: DataFrame, series: DataFrame) -> DataFrame:
    """One nested row per business: profile, prediction, metrics and series (bounded by months)."""
    metrics = curated(profile).groupBy("gstin").agg(
        F.sort_array(F.collect_list(F.struct("position", "label", "value", "text_value"))).alias("metrics")
    )
    points = series.groupBy("gstin").agg(
        F.sort_array(F.collect_list(F.struct("period", "turnover", "filed", "on_time"))).alias("series")
    )
    pred = heads.select("gstin", F.struct("head_score", "head_risk").alias("prediction"))
    packed = profile.select("gstin", F.struct(*[c for c in profile.columns if c != "gstin"]).alias("profile"))
    return packed.join(pred, "gstin", "left").join(metrics, "gstin", "left").join(points, "gstin", "left")


def feature_summary(profile: DataFrame) -> DataFrame:
    """Headline averages of a tax corpus in one row; ratios over zero divisors are left out."""
    claim = F.col("itc_claimed_amount") / F.nullif(F.col("itc_available_amount"), F.lit(0.0))
    names = {
        "avg_annual_turnover": F.avg("annualised_gst_turnover"),
        "avg_monthly_turnover": F.avg("monthly_turnover"),
        "filing_regularity_pct": F.avg("filing_regularity_percentage"),
        "on_time_filing_pct": F.avg(F.when(F.upper("return_status") == "FILED", 1.0).otherwise(0.0)) * 100,
        "turnover_growth_yoy": F.avg("turnover_growth_yoy"),
        "itc_claim_ratio": F.avg(claim),
        "top_buyer_pct": F.avg("top_buyer_sales_percentage"),
        "avg_vintage_years": F.avg("business_vintage_years"),
    }
    return profile.agg(*[half_even(v, 3).alias(n) for n, v in names.items()])
