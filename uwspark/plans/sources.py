"""Payment, utility-bill and tax-return queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rulebook
from ..functions.columns import half_even
from ..operators import bbps, gst, rules, upi
from ..sources import adapters
from ..staging import shared, stage
from . import oracle
from .registry import query

AS_OF = "2002-01-01"


def payments(spark, sf_dir):
    return shared(spark, sf_dir, "payments", lambda: adapters.upi_txn(spark, sf_dir, shift_months=True))


def bank(spark, sf_dir):
    return shared(spark, sf_dir, "bank", lambda: adapters.bank_txn(spark, sf_dir))


def returns(spark, sf_dir):
    return shared(spark, sf_dir, "returns", lambda: adapters.gst_return(spark, sf_dir))


# ------------------------------------------------------------------ payments


@query("d11_upi_analysis", "SELECT * FROM x_upi_analysis")
def upi_analysis(spark, sf_dir):
    return upi.analysis(payments(spark, sf_dir))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in oracle.fixed.MCC_LABELS.items())


@query(
    "d12_f04_spend_by_mcc",
    f"""SELECT account_id, coalesce(mcc, 'OTHER') AS mcc, CASE coalesce(mcc, 'OTHER') {_LABELS} ELSE 'Other' END AS label,
      count(*) AS payment_count, round_even(sum(amount), 2) AS total_amount,
      coalesce(mcc, 'OTHER') IN ({oracle.quoted(oracle.fixed.HIGH_RISK_MCC)}) AS high_risk
    FROM x_upi WHERE mode = 'P2M' GROUP BY ALL""",
)
def mcc(spark, sf_dir):
    return upi.spend_by_mcc(adapters.upi_txn(spark, sf_dir))


@query("c03_upi_pass_through", "SELECT account_id, count(*) AS hits FROM x_pass GROUP BY 1")
def pass_through(spark, sf_dir):
    return upi.pass_through(payments(spark, sf_dir)).groupBy("account_id").agg(F.count(F.lit(1)).alias("hits"))


@query("k14_e17_upi_fraud_metrics", "SELECT * FROM x_upi_metrics")
def upi_metrics(spark, sf_dir):
    return upi.fraud_metrics(payments(spark, sf_dir))


oracle.block("x_upi_rules", oracle.rules_sql("x_upi_analysis", rulebook.UPI_RULES))
oracle.block("x_upi_tally", oracle.tally_sql("x_upi_rules"))


def _final_sql(src: str, final) -> str:
    return f"""SELECT account_id, rule_id, status, serious, detail FROM {src}_rules UNION ALL
      SELECT account_id, '{final[0]}', CASE WHEN passed + failed = 0 THEN 'SKIP' WHEN failed <= 2 THEN 'PASS' ELSE 'FAIL' END, true, passed || ' passed, ' || failed || ' failed, ' || skipped || ' skipped'
      FROM {src}_tally"""


@query("k08_upi_rules", _final_sql("x_upi", rulebook.UPI_FINAL))
def upi_rules(spark, sf_dir):
    a = upi.analysis(payments(spark, sf_dir))
    out = rules.with_final_signal(rules.evaluate(a, rulebook.UPI_RULES), rulebook.UPI_FINAL)
    return out.select("account_id", "rule_id", "status", "serious", "detail")


@query(
    "b28_upi_model_features",
    """SELECT account_id, CAST(total_transactions AS DOUBLE) AS total_transactions, CAST(span_months AS DOUBLE) AS span_months,
      p2p_ratio, p2m_ratio, success_ratio, failed_ratio, CAST(unique_payees AS DOUBLE) AS unique_payees,
      CAST(unique_payers AS DOUBLE) AS unique_payers, CAST(recurring_payee_count AS DOUBLE) AS recurring_payee_count,
      daily_avg_transactions, weekend_spend_pct, avg_ticket_size, high_risk_mcc_spend_pct, p2p_debit_velocity, p2p_credit_velocity
    FROM x_upi_analysis""",
)
def upi_features(spark, sf_dir):
    return upi.model_features(upi.analysis(payments(spark, sf_dir)))


# ------------------------------------------------------------------ utility bills


@query(
    "b20_utility_types",
    "SELECT utility_type, count(*) AS n, round_even(sum(amount), 2) AS paid FROM x_bills GROUP BY 1",
)
def utility_types(spark, sf_dir):
    rows = bbps.utility_rows(adapters.bank_txn(spark, sf_dir))
    return rows.groupBy("utility_type").agg(F.count(F.lit(1)).alias("n"), half_even(F.sum("amount"), 2).alias("paid"))


@query("d13_bbps_by_type", "SELECT * EXCLUDE (paid) FROM x_bill_types")
def bill_types(spark, sf_dir):
    return bbps.by_type(bank(spark, sf_dir)).drop("_paid")


@query("d13_bbps_analysis", "SELECT * FROM x_bill_analysis")
def bill_analysis(spark, sf_dir):
    return bbps.analysis(bbps.by_type(bank(spark, sf_dir)))


@query(
    "g03_missing_periods",
    """SELECT r.account_id, r.utility_type, s.month FROM (SELECT account_id, utility_type FROM x_bill_types WHERE recurring) r
      JOIN (SELECT DISTINCT account_id, strftime(txn_date, '%Y-%m') AS month FROM x_bank) s USING (account_id)
      WHERE NOT EXISTS (SELECT 1 FROM x_bills b WHERE b.account_id = r.account_id AND b.utility_type = r.utility_type AND b.month = s.month)""",
)
def missing(spark, sf_dir):
    return bbps.missing_periods(bank(spark, sf_dir))


@query(
    "e13_repeat_payments",
    "SELECT account_id, CAST(dup AS BIGINT) AS dup, CAST(rapid AS BIGINT) AS rapid FROM x_bill_repeats",
)
def repeats(spark, sf_dir):
    return bbps.repeats(bbps.utility_rows(adapters.bank_txn(spark, sf_dir)))


@query("k13_bbps_fraud_metrics", "SELECT * FROM x_bill_metrics")
def bill_metrics(spark, sf_dir):
    txns = bank(spark, sf_dir)
    types = stage(bbps.by_type(txns))
    return bbps.fraud_metrics(txns, types, bbps.analysis(types))


oracle.block("x_bbps_rules", oracle.rules_sql("x_bill_analysis", rulebook.BBPS_RULES))
oracle.block("x_bbps_tally", oracle.tally_sql("x_bbps_rules"))


@query("k07_bbps_rules", _final_sql("x_bbps", rulebook.BBPS_FINAL))
def bbps_rules(spark, sf_dir):
    a = bbps.analysis(bbps.by_type(bank(spark, sf_dir)))
    out = rules.with_final_signal(rules.evaluate(a, rulebook.BBPS_RULES), rulebook.BBPS_FINAL)
    return out.select("account_id", "rule_id", "status", "serious", "detail")


# ------------------------------------------------------------------ tax returns


@query(
    "d14_gst_profile",
    "SELECT * FROM x_gst_profile",
)
def gst_profile(spark, sf_dir):
    keep = """gstin gst_status return_status filing_delay_days gstr1_sales_value gstr3b_net_tax_liability b2b_sales_amount
      b2c_sales_amount b2b_sales_percentage export_sales_amount itc_available_amount itc_claimed_amount itc_reversed_amount
      net_itc_amount unique_buyer_count unique_b2b_buyer_count top_buyer_sales_percentage buyer_concentration_level
      monthly_turnover quarterly_turnover turnover_growth_mom turnover_growth_qoq turnover_growth_yoy
      turnover_decline_percentage consecutive_declining_quarters filing_regularity_percentage missed_return_count
      late_return_count gstr1_vs_gstr3b_mismatch_pct business_vintage_years annualised_gst_turnover proposed_loan_amount
      gst_turnover_to_loan_ratio maximum_loan_by_gst_rule gst_data_completeness_score periods_covered suppliers""".split()
    return gst.profiles(returns(spark, sf_dir), AS_OF).select(*keep)


@query(
    "e06_e08_turnover_shape",
    """SELECT gstin, round(monthly, 2) AS monthly, round(quarterly, 2) AS quarterly, round(annualised, 2) AS annualised,
      mom, qoq, yoy, declining FROM x_gst_shape""",
)
def turnover_shape(spark, sf_dir):
    s = gst.turnover_shape(gst.periods(adapters.gst_return(spark, sf_dir)))
    return s.withColumns({c: F.round(c, 2) for c in ("monthly", "quarterly", "annualised")})


@query(
    "c05_return_mismatch",
    """SELECT gstin, round_even(coalesce(avg(abs(taxable - outward) / outward * 100) FILTER (kept > 0 AND outward > 0), 0.0), 2) AS mismatch
    FROM x_gst_p GROUP BY gstin""",
)
def mismatch(spark, sf_dir):
    return gst.mismatch(gst.periods(adapters.gst_return(spark, sf_dir)))


@query(
    "d14_monthly_series",
    """SELECT gstin, period, round_even(turnover, 2) AS turnover, true AS filed, days_late <= 0 AS on_time FROM x_gst_p""",
)
def series(spark, sf_dir):
    return gst.monthly_series(gst.periods(adapters.gst_return(spark, sf_dir)))


@query("k12_gst_fraud_metrics", "SELECT * REPLACE (round(itc_claim_ratio, 6) AS itc_claim_ratio) FROM x_gst_metrics")
def gst_metrics(spark, sf_dir):
    m = gst.fraud_metrics(gst.profiles(returns(spark, sf_dir), AS_OF))
    return m.withColumn("itc_claim_ratio", F.round("itc_claim_ratio", 6))


oracle.block("x_gst_rules", oracle.rules_sql("x_gst_heads", rulebook.GST_RULES, key="gstin"))
oracle.block("x_gst_tally", oracle.tally_sql("x_gst_rules", key="gstin"))


@query("k06_gst_rules", "SELECT gstin, rule_id, status, serious, detail FROM x_gst_rules")
def gst_rules(spark, sf_dir):
    p = gst.policy_heads(gst.profiles(returns(spark, sf_dir), AS_OF))
    return rules.evaluate(p, rulebook.GST_RULES, key="gstin").select("gstin", "rule_id", "status", "serious", "detail")


@query(
    "k06_gst_decision",
    """SELECT gstin, passed, failed, skipped, CASE WHEN serious_fails > 0 THEN 'REJECTED' WHEN failed > 0 OR head_score < 55
      THEN 'CONDITIONAL APPROVAL' WHEN head_score >= 75 THEN 'APPROVED' ELSE 'APPROVED WITH NOTES' END AS decision
    FROM x_gst_tally JOIN x_gst_heads USING (gstin)""",
)
def gst_decision(spark, sf_dir):
    p = stage(gst.policy_heads(gst.profiles(returns(spark, sf_dir), AS_OF)))
    out = rules.gst_decision(rules.evaluate(p, rulebook.GST_RULES, key="gstin", detail=False), p)
    return out.select("gstin", "passed", "failed", "skipped", "decision")
