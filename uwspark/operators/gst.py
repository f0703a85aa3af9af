"""Tax-return roll-up: one profile per gstin from rows per period and return type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import clip, concentration_band, count_if, half_even, ratio

NUMERIC = [
    "taxable_value", "gross_total_value", "b2b_value", "b2c_value", "export_value", "sez_value",
    "b2b_invoice_count", "unique_buyer_count", "top_buyer_value", "outward_taxable_value", "outward_igst",
    "outward_cgst", "outward_sgst", "outward_cess", "itc_igst", "itc_cgst", "itc_sgst", "itc_cess", "itc_total",
    "itc_reversed", "net_itc", "tax_payable", "itc_available_total", "total_taxable_value", "supplier_count",
]
TEXT = ["legal_name", "trade_name", "gst_status", "registration_date", "constitution", "filing_frequency", "return_status"]


def widened(returns: DataFrame) -> DataFrame:
    """Missing optional fields as nulls, so every source has the same shape."""
    out = returns
    for c in NUMERIC:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    for c in TEXT:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    for c in ("filing_date", "due_date"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("date"))
    if "file_seq" not in out.columns:
        out = out.withColumn("file_seq", F.lit(0).cast("bigint"))
    return out


def latest_rows(returns: DataFrame) -> DataFrame:
    """Last row per (gstin, period, type): a max over structs, combined before the shuffle."""
    r = widened(returns)
    keys = ["gstin", "period", "return_type"]
    rest = [c for c in r.columns if c not in keys]
    return r.groupBy(*keys).agg(F.max_by(F.struct(*rest), "file_seq").alias("r")).select(*keys, "r.*")


def periods(returns: DataFrame) -> DataFrame:
    """One row per (gstin, period) with the four return types side by side and the turnover.

    The returns of a business, a calendar-sized group, move once; all later groups of it lie there already.
    """
    r = latest_rows(returns.repartition("gstin"))
    fields = [*NUMERIC, "filing_date", "due_date", "return_status"]
    picked = [
        F.max(F.when(F.col("return_type") == t, F.struct(*fields))).alias(a)
        for t, a in (("GSTR1", "g1"), ("GSTR3B", "g3"), ("GSTR2A", "g2a"), ("GSTR2B", "g2b"))
    ]
    p = r.groupBy("gstin", "period").agg(*picked)
    out3 = F.coalesce("g3.outward_taxable_value", F.lit(0.0))
    sales1 = taxable_sales()
    turnover = F.when(out3 > 0, out3).when(F.col("g1").isNotNull(), sales1).otherwise(out3)
    late = F.datediff("g3.filing_date", "g3.due_date")
    status = F.upper(F.coalesce("g3.return_status", F.lit("")))
    on_time = F.when(late.isNotNull(), late <= 0).when(status != "", status.isin("FILED", "ONTIME"))
    return p.withColumns({"turnover": turnover, "days_late": late, "status3": status, "on_time": on_time})


def taxable_sales() -> Column:
    t = F.col("g1.taxable_value")
    return F.coalesce(F.when(t != 0, t), F.col("g1.gross_total_value"), t, F.lit(0.0))


def turnover_shape(p: DataFrame) -> DataFrame:
    """Growth, trailing sums and declining streak on the positive-turnover series.

    A business has one row per calendar month here, so its windows are bounded.
    """
    w = W.partitionBy("gstin").orderBy("period")
    back = W.partitionBy("gstin").orderBy(F.col("period").desc())
    s = (
        p.where("turnover > 0")
        .select("gstin", "period", "turnover")
        .withColumn("l1", F.lag("turnover", 1).over(w))
        .withColumn("l3", F.lag("turnover", 3).over(w))
        .withColumn("l12", F.lag("turnover", 12).over(w))
        .withColumn("k", F.row_number().over(back))
    )
    rises = F.when(~F.coalesce(F.col("turnover") < F.col("l1"), F.lit(False)), F.col("k"))
    now = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    growth = lambda c: half_even(
        F.coalesce((now("turnover") - now(c)) / now(c) * 100, F.lit(0.0)), 4
    )
    last = lambda k: F.sum(F.when(F.col("k") <= k, F.col("turnover")))
    return s.groupBy("gstin").agg(
        now("turnover").alias("monthly"),
        last(3).alias("quarterly"),
        F.when(F.count(F.lit(1)) >= 12, last(12)).otherwise(F.avg("turnover") * 12).alias("annualised"),
        growth("l1").alias("mom"),
        growth("l3").alias("qoq"),
        growth("l12").alias("yoy"),
        F.least(F.lit(4), F.min(rises) - 1).cast("bigint").alias("declining"),
    )


def metadata(returns: DataFrame) -> DataFrame:
    """First non-empty value of each descriptive field in file order."""
    fields = ("legal_name", "trade_name", "gst_status", "constitution", "filing_frequency", "registration_date")
    r = widened(returns)
    pos = F.struct("file_seq", "period", "return_type")
    # a field that no return has needs no search
    found = [
        F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", pos)).alias(c) for c in fields if c in returns.columns
    ]
    out = r.groupBy("gstin").agg(*found) if found else r.select("gstin").distinct()
    return out.select("gstin", *[c if c in returns.columns else F.lit(None).cast("string").alias(c) for c in fields])


def mismatch(p: DataFrame) -> DataFrame:
    """Mean absolute gap between the two sales returns, in percent of the second."""
    gap = F.abs(taxable_sales() - F.col("g3.outward_taxable_value")) / F.col("g3.outward_taxable_value") * 100
    ok = F.col("g1").isNotNull() & (F.col("g3.outward_taxable_value") > 0)
    return p.groupBy("gstin").agg(half_even(F.coalesce(F.avg(F.when(ok, gap)), F.lit(0.0)), 2).alias("mismatch"))


def profiles(returns: DataFrame, as_of: str, proposed_loans: DataFrame | None = None) -> DataFrame:
    """The full profile; `as_of` fixes the day the vintage is measured on."""
    p = periods(returns)
    has = lambda t: F.col(t).isNotNull()
    newest = lambda t: F.max_by(t, F.when(has(t), F.col("period")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean1 = lambda v: F.coalesce(F.avg(F.when(has("g1"), v)), F.lit(0.0))
    late, ontime = F.col("days_late") > 0, F.col("days_late") <= 0
    unknown = F.col("days_late").isNull() & has("g3")
    g = p.groupBy("gstin").agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count(F.lit(1)).alias("n_periods"),
        *[count_if(has(t)).alias(f"seen_{t}") for t in ("g1", "g3", "g2a", "g2b")],
        (count_if(late) + count_if(unknown & (F.col("status3") == "LATE"))).alias("late"),
        (count_if(ontime) + count_if(unknown & F.col("status3").isin("FILED", "ONTIME"))).alias("ontime"),
        F.avg(F.when(F.col("days_late").isNotNull(), F.greatest(F.lit(0), F.col("days_late")))).alias("delay"),
        mean1(taxable_sales()).alias("g1_sales"),
        mean1(z("g1.b2b_value")).alias("b2b"),
        mean1(z("g1.b2c_value")).alias("b2c"),
        mean1(z("g1.export_value")).alias("export"),
        mean1(z("g1.sez_value")).alias("sez"),
        newest("g1").alias("g1"), newest("g3").alias("g3"), newest("g2a").alias("g2a"), newest("g2b").alias("g2b"),
    )
    t = (
        g.join(turnover_shape(p), "gstin", "left")
        .join(mismatch(p), "gstin")
        .join(metadata(returns), "gstin")
        .na.fill(0.0, ["monthly", "quarterly", "annualised", "mom", "qoq", "yoy"])
        .na.fill(0, ["declining"])
    )
    if proposed_loans is not None:
        t = t.join(proposed_loans.select("gstin", F.col("proposed_loan_amount").alias("_loan")), "gstin", "left")
    else:
        t = t.withColumn("_loan", F.lit(None).cast("double"))
    nz = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c))
    loan = nz("_loan")
    t = t.withColumns(
        {
            "monthly": F.col("monthly"),
            "mix": F.coalesce(F.when(F.col("b2b") + F.col("b2c") != 0, F.col("b2b") + F.col("b2c")), nz("monthly"), F.lit(1.0)),
            "claimed": F.when(
                has("g3"),
                F.coalesce(nz("g3.itc_total"), z("g3.itc_igst") + z("g3.itc_cgst") + z("g3.itc_sgst") + z("g3.itc_cess")),
            ).otherwise(0.0),
            "reversed": z("g3.itc_reversed"),
            "top_pct": clip(
                F.when(F.col("monthly") != 0, half_even(100 * z("g1.top_buyer_value") / F.col("monthly"), 2)).otherwise(20.0),
                0.0, 95.0,
            ),
            "ratio": F.when(loan.isNotNull(), half_even(F.col("annualised") / loan, 2)).otherwise(2.0),
        }
    )
    taxes = z("g3.outward_igst") + z("g3.outward_cgst") + z("g3.outward_sgst") + z("g3.outward_cess")
    start = F.coalesce(F.to_date("registration_date"), F.to_date(F.concat("first_period", F.lit("-01"))))
    b2b_pct = half_even(100 * F.col("b2b") / F.col("mix"), 2)
    m2 = lambda c: half_even(c, 2)
    return t.select(
        F.col("gstin"),
        F.coalesce("legal_name", F.lit("")).alias("legal_name"),
        F.coalesce("trade_name", F.lit("")).alias("trade_name"),
        F.upper(F.coalesce("gst_status", F.lit("ACTIVE"))).alias("gst_status"),
        F.lit("GSTR3B").alias("return_type"),
        F.when((F.col("late") > 0) & (F.col("ontime") == 0), "LATE").otherwise("FILED").alias("return_status"),
        F.upper(F.coalesce("filing_frequency", F.lit("MONTHLY"))).alias("filing_frequency"),
        half_even(F.coalesce("delay", F.lit(0.0)), 1).alias("filing_delay_days"),
        m2("g1_sales").alias("gstr1_sales_value"),
        m2("monthly").alias("gstr3b_taxable_outward_supply"),
        m2(F.coalesce(nz("g3.tax_payable"), taxes)).alias("gstr3b_net_tax_liability"),
        m2("monthly").alias("total_taxable_turnover"),
        m2("b2b").alias("b2b_sales_amount"),
        m2("b2c").alias("b2c_sales_amount"),
        b2b_pct.alias("b2b_sales_percentage"),
        m2(100 - b2b_pct).alias("b2c_sales_percentage"),
        m2("export").alias("export_sales_amount"),
        m2("sez").alias("sez_sales_amount"),
        F.lit(0.0).alias("reverse_charge_sales_amount"),
        m2(z("g3.outward_igst")).alias("igst_amount"),
        m2(z("g3.outward_cgst")).alias("cgst_amount"),
        m2(z("g3.outward_sgst")).alias("sgst_amount"),
        m2(z("g3.outward_cess")).alias("cess_amount"),
        m2(
            F.when(has("g2b"), z("g2b.itc_available_total")).when(has("g2a"), z("g2a.total_taxable_value")).otherwise(F.col("claimed"))
        ).alias("itc_available_amount"),
        m2("claimed").alias("itc_claimed_amount"),
        m2("reversed").alias("itc_reversed_amount"),
        m2(
            F.coalesce(nz("g3.net_itc"), F.greatest(F.lit(0.0), F.col("claimed") - F.col("reversed")))
        ).alias("net_itc_amount"),
        z("g1.unique_buyer_count").cast("bigint").alias("unique_buyer_count"),
        z("g1.b2b_invoice_count").cast("bigint").alias("unique_b2b_buyer_count"),
        F.col("top_pct").alias("top_buyer_sales_percentage"),
        concentration_band("top_pct").alias("buyer_concentration_level"),
        m2("monthly").alias("monthly_turnover"),
        m2("quarterly").alias("quarterly_turnover"),
        F.col("mom").alias("turnover_growth_mom"),
        F.col("qoq").alias("turnover_growth_qoq"),
        F.col("yoy").alias("turnover_growth_yoy"),
        m2(F.abs(F.least(F.lit(0.0), F.col("yoy")))).alias("turnover_decline_percentage"),
        F.col("declining").alias("consecutive_declining_quarters"),
        F.when(F.col("seen_g3") > 0, m2(100 * F.col("ontime") / F.col("seen_g3"))).otherwise(50.0).alias("filing_regularity_percentage"),
        F.greatest(F.lit(0), F.col("n_periods") - F.col("seen_g3")).cast("bigint").alias("missed_return_count"),
        F.col("late").alias("late_return_count"),
        F.col("mismatch").alias("gstr1_vs_gstr3b_mismatch_pct"),
        m2(F.datediff(F.lit(as_of).cast("date"), start) / 365.25).alias("business_vintage_years"),
        m2("annualised").alias("annualised_gst_turnover"),
        m2(F.coalesce(loan, F.col("annualised") / F.col("ratio"))).alias("proposed_loan_amount"),
        F.col("ratio").alias("gst_turnover_to_loan_ratio"),
        m2(F.col("annualised") * 0.40).alias("maximum_loan_by_gst_rule"),
        F.lit(1.0).alias("gst_data_completeness_score"),
        F.col("n_periods").alias("periods_covered"),
        "first_period", "last_period",
        F.col("seen_g1").alias("returns_gstr1"), F.col("seen_g3").alias("returns_gstr3b"),
        F.col("seen_g2a").alias("returns_gstr2a"), F.col("seen_g2b").alias("returns_gstr2b"),
        F.coalesce("g2b.supplier_count", "g2a.supplier_count", F.lit(0.0)).cast("bigint").alias("suppliers"),
    )


def monthly_series(p: DataFrame) -> DataFrame:
    """Turnover, filed and on-time flag per (gstin, period)."""
    return p.select(
        "gstin", "period", half_even("turnover", 2).alias("turnover"),
        (F.col("g3").isNotNull() | F.col("g1").isNotNull()).alias("filed"), "on_time",
    )


def fraud_metrics(profile: DataFrame) -> DataFrame:
    d = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return profile.select(
        "gstin",
        d("gstr1_vs_gstr3b_mismatch_pct"), d("missed_return_count"), d("late_return_count"),
        ratio("itc_claimed_amount", "itc_available_amount").alias("itc_claim_ratio"),
        d("turnover_decline_percentage"), d("consecutive_declining_quarters"), d("turnover_growth_yoy"),
        d("top_buyer_sales_percentage"),
    )


def policy_heads(profile: DataFrame) -> DataFrame:
    """Stand-in for the two heads whose training labels are an outside input.

    Score = 100 minus points for the serious conditions of the rule list that use no
    model head; flag from the score.  This is a policy label of this library.
    """
    bad = lambda cond, pts: F.when(cond, float(pts)).otherwise(0.0)
    score = (
        F.lit(100.0)
        - bad(F.col("gst_status") != "ACTIVE", 40)
        - bad(F.col("filing_regularity_percentage") < 80, 20)
        - bad(F.col("missed_return_count") > 0, 20)
        - bad(F.col("turnover_decline_percentage") > 25, 20)
    )
    return profile.withColumn("head_score", score).withColumns(
        {
            "head_risk": F.when(F.col("head_score") >= 75, "LOW").when(F.col("head_score") >= 55, "MEDIUM").otherwise("HIGH"),
            "head_loan": F.col("maximum_loan_by_gst_rule"),
            "head_filing": F.col("filing_regularity_percentage"),
        }
    )


def source_rollup(blocks: DataFrame, types: tuple[str, ...] = ("GSTR1", "GSTR3B", "GSTR2A", "GSTR2B")) -> DataFrame:
    """One row per source from the summaries of its statements.

    A block has (source_id, businesses, avg_score, low, medium, high) and how many returns of each type it
    saw; counts are added, the score is the mean of the block scores that are known.
    """
    names = ["businesses", "low", "medium", "high", *[t.lower() for t in types]]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return blocks.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("statements"), half_even(F.avg("avg_score"), 2).alias("avg_score"), *[total(n) for n in names]
    )
