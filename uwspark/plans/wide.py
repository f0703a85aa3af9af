"""Queries that compare whole outputs: every column of the tax profile, nested lists and vectors laid flat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, gst, present, rules, warehouse as wh
from .bank import prepared, scores
from .history import applicants, runs
from .registry import query
from .sources import AS_OF, returns


@query(
    "d14_gst_full_profile",
    """SELECT * EXCLUDE (returns_gstr3b), CAST(returns_gstr3b AS BIGINT) AS returns_gstr3b FROM (
      SELECT p.*, '' AS legal_name, '' AS trade_name, 'GSTR3B' AS return_type, 'MONTHLY' AS filing_frequency,
        monthly_turnover AS gstr3b_taxable_outward_supply, monthly_turnover AS total_taxable_turnover,
        round_even(100 - b2b_sales_percentage, 2) AS b2c_sales_percentage, 0.0::DOUBLE AS sez_sales_amount, 0.0::DOUBLE AS reverse_charge_sales_amount,
        gstr3b_net_tax_liability AS igst_amount, 0.0::DOUBLE AS cgst_amount, 0.0::DOUBLE AS sgst_amount, 0.0::DOUBLE AS cess_amount,
        first_period, last_period, returns_gstr1, returns_gstr3b, CAST(0 AS BIGINT) AS returns_gstr2a, returns_gstr1 AS returns_gstr2b
      FROM x_gst_profile p JOIN
        (SELECT gstin, min(period) AS first_period, max(period) AS last_period, count(*) AS returns_gstr1, count(*) FILTER (kept > 0) AS returns_gstr3b
         FROM x_gst_p GROUP BY gstin) USING (gstin))""",
)
def gst_full_profile(spark, sf_dir):
    return gst.profiles(returns(spark, sf_dir), AS_OF)


_TEXTS = [(i, f) for i, (f, _, k) in enumerate(present.CURATED) if k == "text"]


@query(
    "b18_curated_texts",
    """SELECT gstin, CAST(position AS INTEGER) AS position, field, text_value FROM (
      SELECT gstin, """
    + f"{_TEXTS[0][0]} AS position, 'buyer_concentration_level' AS field, upper(buyer_concentration_level) AS text_value FROM x_gst_profile "
    + f"UNION ALL SELECT gstin, {_TEXTS[1][0]}, 'gst_status', upper(gst_status) FROM x_gst_profile)",
)
def curated_texts(spark, sf_dir):
    out = present.curated(gst.profiles(returns(spark, sf_dir), AS_OF)).where("kind = 'text'")
    return out.select("gstin", "position", "field", "text_value")


_KEYED = """SELECT x_run.*, c_name, CASE WHEN id % 7 = 0 THEN ' Ref ' || (id % 500) WHEN id % 7 = 1 THEN 'Applicant' END AS ref,
      CASE WHEN id % 5 <> 0 THEN c_name END AS holder,
      CASE WHEN id % 3 = 0 THEN 'Stmt.' || (id % 40) || '.PDF' WHEN id % 3 = 1 THEN '' END AS file,
      CASE WHEN id % 11 <> 0 THEN data_source END AS src FROM x_run JOIN customer ON c_custkey = applicant_id"""


@query(
    "d30_b25_history_lists",
    f"""SELECT application_key, max(id) AS last_id, count(*) AS models,
      string_agg(id || ' ' || model_id || ' ' || credit_score || ' ' || decision, ', ' ORDER BY id DESC) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY application_key, model_id ORDER BY id DESC) AS rn FROM
      (SELECT *, CASE WHEN trim(coalesce(ref, '')) <> '' AND lower(trim(ref)) <> 'applicant' THEN 'ref:' || lower(trim(ref))
        WHEN trim(coalesce(holder, '')) <> '' THEN 'name:' || lower(trim(holder))
        WHEN coalesce(file, '') <> '' THEN 'file:' || lower(trim(regexp_replace(file, '\\.[^.]*$', ''))) ELSE 'src:' || coalesce(src, 'unknown') END AS application_key
      FROM ({_KEYED}))) WHERE rn = 1 GROUP BY 1""",
)
def history_lists(spark, sf_dir):
    """All four kinds of key, the nested list laid flat."""
    r = runs(spark, sf_dir).join(applicants(spark, sf_dir).withColumnRenamed("id", "applicant_id"), "applicant_id")
    i = F.col("id")
    r = r.withColumns(
        {
            "ref": F.when(i % 7 == 0, F.concat(F.lit(" Ref "), (i % 500).cast("string"))).when(i % 7 == 1, "Applicant"),
            "holder": F.when(i % 5 != 0, F.col("name")),
            "file": F.when(i % 3 == 0, F.concat(F.lit("Stmt."), (i % 40).cast("string"), F.lit(".PDF"))).when(i % 3 == 1, ""),
            "src": F.when(i % 11 != 0, F.col("data_source")),
        }
    )
    out = wh.test_history(r.withColumn("application_key", wh.application_key("ref", "holder", "file", "src")))
    line = lambda h: F.concat_ws(" ", h["id"], h["model_id"], h["credit_score"], h["decision"])
    return out.withColumn("history", F.array_join(F.transform("history", line), ", "))


_VECTOR = ["statement_months", "avg_monthly_inflow", "avg_monthly_debit", "nach_bounce_count_90d", "dscr_ratio", "cash_withdrawal_ratio",
           "balance_volatility", "minimum_balance", "avg_balance", "foir_ratio", "income_stability"]


@query(
    "k19_payload_vector",
    f"SELECT account_id, 'ANALYZED' AS status, {', '.join(f'round(CAST({c} AS DOUBLE), 4) AS {c}' for c in _VECTOR)} FROM x_score",
)
def payload_vector(spark, sf_dir):
    led = prepared(spark, sf_dir)
    out = rules.payload(scores(led), features.statement_summary(led)).select("account_id", "status", "feature_vector.*")
    return out.select("account_id", "status", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in _VECTOR))


@query(
    "k28_business_view_flat",
    f"""SELECT gstin, monthly_turnover, CAST(head_score AS DOUBLE) AS head_score, head_risk, metrics, label_text, round(metric_sum, 4) AS metric_sum, months, first_period, last_period, on_time, turnover
    FROM x_gst_heads JOIN (SELECT gstin, count(*) AS months, min(period) AS first_period, max(period) AS last_period,
        count(*) FILTER (days_late <= 0) AS on_time, round(sum(round_even(turnover, 2)), 2) AS turnover FROM x_gst_p GROUP BY gstin) USING (gstin)
    JOIN (SELECT gstin, CAST({len(present.CURATED)} AS BIGINT) AS metrics, upper(buyer_concentration_level) || ',' || upper(gst_status) AS label_text,
        {" + ".join(f"CAST({f} AS DOUBLE)" for f, _, k in present.CURATED if k != "text").replace("total_taxable_turnover", "monthly_turnover")} AS metric_sum FROM x_gst_profile) USING (gstin)""",
)
def business_view_flat(spark, sf_dir):
    """The nested document of every business, its lists laid flat."""
    r = returns(spark, sf_dir)
    profile = gst.policy_heads(gst.profiles(r, AS_OF))
    heads = profile.select("gstin", "head_score", "head_risk")
    plain = profile.drop("head_score", "head_risk", "head_loan", "head_filing")
    view = present.business_view(plain, heads, gst.monthly_series(gst.periods(r)))
    total = lambda c, of: F.aggregate(F.transform(c, of), F.lit(0.0), lambda a, x: a + x)
    return view.select(
        "gstin", "profile.monthly_turnover", "prediction.head_score", "prediction.head_risk",
        F.size("metrics").cast("bigint").alias("metrics"),
        F.array_join(F.array_compact(F.transform("metrics", lambda m: m["text_value"])), ",").alias("label_text"),
        F.round(total("metrics", lambda m: F.coalesce(m["value"], F.lit(0.0))), 4).alias("metric_sum"),
        F.size("series").cast("bigint").alias("months"),
        F.array_min(F.transform("series", lambda p: p["period"])).alias("first_period"),
        F.array_max(F.transform("series", lambda p: p["period"])).alias("last_period"),
        F.size(F.filter("series", lambda p: p["on_time"])).cast("bigint").alias("on_time"),
        F.round(total("series", lambda p: p["turnover"]), 2).alias("turnover"),
    )
