"""Run-history and corpus queries over orders (runs) and customers (applicants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import decision_of, grade
from ..operators import monitor, warehouse as wh
from ..sources import adapters
from ..sources.adapters import read
from . import oracle
from .registry import query


def runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    score = (300 + F.floor("o_totalprice") % 601).cast("bigint")
    models = F.array(*[F.lit(m) for m in ("risk_model", "cashflow_model", "fraud_model", "money_balance_model")])
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("applicant_id"),
        F.when(k % 3 != 0, k % 4999).alias("statement_id"),
        F.element_at(models, (F.col("o_custkey") % 4 + 1).cast("int")).alias("model_id"),
        F.when(k % 7 != 0, "UPLOADED_STATEMENT").otherwise("SIMULATED").alias("data_source"),
        score.alias("credit_score"),
        grade(score).alias("risk_grade"),
        decision_of(grade(score)).alias("decision"),
        (k % 50).alias("transaction_count"),
        (k % 5).alias("anomaly_count"),
        F.when(k % 2 == 0, F.concat(F.lit("dataset-v"), (k % 6).cast("string"))).alias("model_source"),
        F.to_date("o_orderdate").alias("created_at"),
    )


oracle.block(
    "x_run",
    """SELECT *, CASE risk_grade WHEN 'LOW' THEN 'APPROVED' WHEN 'MEDIUM' THEN 'CONDITIONAL APPROVAL' ELSE 'REJECTED' END AS decision,
      coalesce(statement_id, -applicant_id, -1000000 - id) AS entity FROM
     (SELECT *, CASE WHEN credit_score >= 700 THEN 'LOW' WHEN credit_score >= 550 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_grade FROM
      (SELECT o_orderkey AS id, o_custkey AS applicant_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4999 END AS statement_id,
        ['risk_model', 'cashflow_model', 'fraud_model', 'money_balance_model'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS model_id,
        CASE WHEN o_orderkey % 7 <> 0 THEN 'UPLOADED_STATEMENT' ELSE 'SIMULATED' END AS data_source,
        CAST(300 + CAST(floor(o_totalprice) AS BIGINT) % 601 AS BIGINT) AS credit_score, o_orderkey % 50 AS transaction_count, o_orderkey % 5 AS anomaly_count,
        CASE WHEN o_orderkey % 2 = 0 THEN 'dataset-v' || (o_orderkey % 6) END AS model_source, CAST(o_orderdate AS DATE) AS created_at FROM orders))""",
)
oracle.block(
    "x_one",
    """SELECT * FROM x_run WHERE id IN (SELECT max(id) FROM x_run WHERE data_source = 'UPLOADED_STATEMENT' AND model_id = 'risk_model' GROUP BY entity)""",
)


def applicants(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("c08_representative_runs", "SELECT id, credit_score, decision FROM x_one")
def representative(spark, sf_dir):
    return wh.representative_runs(runs(spark, sf_dir)).select("id", "credit_score", "decision")


@query(
    "c09_f03_recent_runs",
    "SELECT o.id, credit_score, risk_grade, c_name AS applicant_name FROM (SELECT * FROM x_one ORDER BY id DESC LIMIT 8) o LEFT JOIN customer ON c_custkey = applicant_id",
)
def recent(spark, sf_dir):
    one = wh.representative_runs(runs(spark, sf_dir))
    return wh.recent_runs(one, applicants(spark, sf_dir)).select("id", "credit_score", "risk_grade", "applicant_name")


@query(
    "c10_d28_dashboard",
    """SELECT count(*) AS analyzed, CAST(sum(transaction_count) AS BIGINT) AS processed, round_even(avg(credit_score), 1) AS avg_score,
      CAST(sum(anomaly_count) AS BIGINT) AS anomalies, (SELECT count(DISTINCT statement_id) FROM x_run WHERE decision = 'CONDITIONAL APPROVAL') AS pending FROM x_one""",
)
def dashboard(spark, sf_dir):
    r = runs(spark, sf_dir)
    evaluations = r.select(F.col("id").alias("run_id"), "decision")
    return wh.dashboard(wh.representative_runs(r), wh.pending_cases(evaluations, r))


@query(
    "d28_d32_breakdown",
    """SELECT 'grade' AS kind, risk_grade AS value, count(*) AS runs FROM x_one GROUP BY ALL UNION ALL
      SELECT 'decision', decision, count(*) FROM x_one GROUP BY ALL""",
)
def breakdown(spark, sf_dir):
    return wh.breakdown(wh.representative_runs(runs(spark, sf_dir)))


@query(
    "c11_orphan_applicants",
    """SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
      AND NOT EXISTS (SELECT 1 FROM x_run WHERE applicant_id = c_custkey AND statement_id IS NOT NULL)""",
)
def orphans(spark, sf_dir):
    r = runs(spark, sf_dir)
    return wh.orphan_applicants(applicants(spark, sf_dir), r.where("statement_id is not null"), r).select("id")


@query(
    "c12_backfill",
    """SELECT DISTINCT c_custkey AS applicant_id, m AS model_id FROM customer, (VALUES ('risk_model'), ('fraud_model')) AS t(m)
      WHERE NOT EXISTS (SELECT 1 FROM x_run WHERE applicant_id = c_custkey AND model_id = m AND statement_id IS NULL)""",
)
def backfill(spark, sf_dir):
    models = F.explode(F.array(F.lit("risk_model"), F.lit("fraud_model")))
    cache = applicants(spark, sf_dir).select(F.col("id").alias("applicant_id"), models.alias("model_id"))
    return wh.backfill(cache, runs(spark, sf_dir))


@query(
    "c14_latest_statement_run",
    """SELECT source_id, s.statement_id, coalesce(r.run_id, (SELECT max(id) FROM x_run WHERE data_source = 'UPLOADED_STATEMENT')) AS run_id FROM
      (SELECT c_nationkey AS source_id, max(c_custkey) AS statement_id FROM customer GROUP BY 1) s
      LEFT JOIN (SELECT statement_id, max(id) AS run_id FROM x_run WHERE statement_id IS NOT NULL GROUP BY 1) r ON r.statement_id = s.statement_id""",
)
def latest(spark, sf_dir):
    statements = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("id")
    )
    return wh.latest_run_of_latest_statement(statements, runs(spark, sf_dir))


@query(
    "c16_model_version",
    """SELECT id, model_source, r_regionkey + 100 AS model_version_id FROM x_run LEFT JOIN region
      ON r_regionkey = TRY_CAST(regexp_extract(model_source, '^dataset-v(\\d+)$', 1) AS INTEGER)""",
)
def model_version(spark, sf_dir):
    versions = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("version"), (F.col("r_regionkey") + 100).alias("id")
    )
    return wh.with_model_version(runs(spark, sf_dir), versions).select("id", "model_source", "model_version_id")


@query(
    "k22_run_upsert",
    """SELECT id, statement_id, model_id FROM x_run WHERE statement_id IS NULL UNION ALL
      SELECT max(id), statement_id, model_id FROM x_run WHERE statement_id IS NOT NULL GROUP BY ALL""",
)
def upsert(spark, sf_dir):
    return wh.upsert_runs(runs(spark, sf_dir)).select("id", "statement_id", "model_id")


@query(
    "d30_b25_test_history",
    """SELECT 'name:' || lower(c_name) AS application_key, max(id) AS last_id, count(DISTINCT model_id) AS models FROM x_run JOIN customer
      ON c_custkey = applicant_id GROUP BY 1""",
)
def history(spark, sf_dir):
    r = runs(spark, sf_dir).join(
        applicants(spark, sf_dir).withColumnRenamed("id", "applicant_id").withColumnRenamed("name", "holder"), "applicant_id"
    )
    none = F.lit(None).cast("string")
    r = r.withColumns({"ref": none, "file": none, "src": F.lit("account_aggregator")})
    r = r.withColumn("application_key", wh.application_key("ref", "holder", "file", "src"))
    return wh.test_history(r).select("application_key", "last_id", "models")


@query(
    "f03_newest_runs",
    "SELECT id, credit_score FROM x_run ORDER BY id DESC LIMIT 50",
)
def newest(spark, sf_dir):
    return wh.newest(runs(spark, sf_dir), "id", 50).select("id", "credit_score")


@query(
    "f06_first_businesses",
    """SELECT source, id, rk FROM (SELECT c_nationkey AS source, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rk FROM customer)
      WHERE rk <= 10""",
)
def first_businesses(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("id"))
    return wh.ranked_within(c, "source", F.col("id"), 10)


@query(
    "a08_e16_corpus_merge",
    """SELECT c_custkey AS customer_id, CASE WHEN s_acctbal IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS balance
      FROM customer FULL JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey IS NOT NULL
      UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""",
)
def corpus(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
    batch = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("customer_id"), F.col("s_acctbal").alias("balance"))
    return wh.merge_corpus(base, batch, ["customer_id"])


@query(
    "a09_merge_report",
    """SELECT CAST(count(*) FILTER (c_custkey IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (c_custkey IS NOT NULL AND s_suppkey IS NOT NULL) AS BIGINT) AS skipped_duplicates,
      count(*) AS total FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON s_suppkey = c_custkey""",
)
def merge_report(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    batch = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("customer_id"))
    return wh.merge_report(base, batch, ["customer_id"])


@query(
    "d31_corpus_stats",
    "SELECT count(*) AS rows, CAST(3 AS BIGINT) AS columns, count(DISTINCT c_mktsegment) AS banks FROM customer",
)
def stats(spark, sf_dir):
    return wh.corpus_stats(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_mktsegment")


@query(
    "a14_e19_star_statements",
    """SELECT account_id, seq, transactions, amount, name FROM (SELECT l_suppkey AS account_id, max(seq) AS seq, count(*) AS transactions,
       CAST(sum(CAST(CASE WHEN seq % 17 <> 16 THEN l_extendedprice END AS DECIMAL(16, 2))) AS DOUBLE) AS amount FROM x_numbered GROUP BY 1)
     JOIN (SELECT s_suppkey AS account_id, s_name AS name FROM supplier) USING (account_id)""",
)
def star(spark, sf_dir):
    acc = adapters.accounts(spark, sf_dir)
    t = wh.star_tables(acc, adapters.bank_txn(spark, sf_dir), applicants(spark, sf_dir))
    per = t["transactions"].groupBy(F.col("statement_id").alias("account_id")).agg(
        F.max("seq").alias("seq"), F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("double").alias("amount")
    )
    names = t["statements"].join(
        t["applicants"].withColumnRenamed("id", "applicant_id"), "applicant_id"
    ).select("account_id", "name")
    return per.join(names, "account_id")


@query(
    "d29_monitoring_overview",
    """SELECT count(*) AS events, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS critical, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS warnings,
      (SELECT CAST(count(*) FILTER (anomaly_count >= 4) AS BIGINT) FROM x_run) AS outlier_runs,
      (SELECT CAST(sum(l_linenumber) AS BIGINT) FROM lineitem) AS rows_rejected FROM events""",
)
def overview(spark, sf_dir):
    sev = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "warning").otherwise("info")
    events = read(spark, sf_dir, "events").select(sev.alias("severity"))
    out = runs(spark, sf_dir).select((F.col("anomaly_count") >= 4).alias("is_outlier"))
    batches = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rows_rejected"))
    return monitor.overview(events, out, batches)


@query(
    "d15_d16_batch_summary",
    """SELECT decision, count(*) AS businesses, round_even(avg(credit_score), 2) AS avg_score, CAST(count(*) FILTER (risk_grade = 'HIGH') AS BIGINT) AS high FROM x_run GROUP BY 1""",
)
def batch_summary(spark, sf_dir):
    from ..functions.columns import count_if, half_even

    return runs(spark, sf_dir).groupBy("decision").agg(
        F.count(F.lit(1)).alias("businesses"), half_even(F.avg("credit_score"), 2).alias("avg_score"),
        count_if(F.col("risk_grade") == "HIGH").alias("high"),
    )
