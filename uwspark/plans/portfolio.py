"""Drift of the score history, rule toggles, roll-ups of heads and sources, attached evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, rulebook
from ..functions.columns import half_even
from ..ml import heads
from ..operators import features, gst, monitor, rules, warehouse as wh
from ..operators.scale import BLOCK_ROWS
from ..sources.adapters import read
from ..staging import stage
from . import oracle
from .bank import context_of, prepared, scores
from .history import runs
from .learning import _PAYMENT_SQL, payment_features
from .models import _heads, payment_rows
from .registry import query
from .sources import AS_OF, returns

# ------------------------------------------------------------------ drift by halves of the history

_NAMES = [*fixed.OUTLIER_FALLBACK, "score"]
oracle.block(
    "x_history",
    """SELECT *, row_number() OVER (ORDER BY account_id) - 1 AS pos, count(*) OVER () AS size, greatest(20, count(*) OVER () // 2) AS half
    FROM (SELECT *, CAST(NULL AS DOUBLE) AS account_age_days FROM x_score)""",
)
for _half, _cond in (("ref", "pos < half"), ("rec", "pos >= size - half")):
    oracle.block(f"x_half_{_half}", oracle.long_sql(f"(SELECT * FROM x_history WHERE {_cond})", _NAMES))
oracle.block("x_half_psi", oracle.psi_sql("x_half_ref", "x_half_rec"))
_BAND = lambda c: f"CASE WHEN {c} >= 0.25 THEN 'alert' WHEN {c} >= 0.1 THEN 'warn' ELSE 'stable' END"
_MEAN = lambda t: f"(SELECT round_even(round_even(sum(value), 6) / count(value), 3) FROM {t} r WHERE r.metric = n.metric AND value IS NOT NULL)"


@query(
    "d21_drift_by_halves",
    f"""SELECT * FROM (WITH n AS (SELECT unnest([{oracle.quoted(_NAMES)}]) AS metric), c AS (SELECT count(*) AS size, count(*) FILTER (pos < half) AS reference_n, count(*) FILTER (pos >= size - half AND NOT pos < half) AS recent_n FROM x_history),
    p AS (SELECT n.metric, CASE WHEN n.metric = 'score' THEN 'prediction' ELSE 'feature' END AS kind, coalesce(psi, 0.0) AS psi, {_MEAN('x_half_ref')} AS reference_mean, {_MEAN('x_half_rec')} AS recent_mean
      FROM n LEFT JOIN x_half_psi x ON x.metric = n.metric)
    SELECT metric, kind, round_even(psi, 3) AS psi, {_BAND('psi')} AS band, reference_mean, recent_mean, reference_n, recent_n,
      {_BAND("(SELECT max(psi) FROM p WHERE kind = 'feature')")} AS status FROM p, c WHERE size >= 40
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, reference_n, recent_n, 'insufficient-data' FROM c WHERE size < 40)""",
)
def drift_by_halves(spark, sf_dir):
    """Scored statements in the order of their ids: eleven features and the score, first half against second."""
    history = scores(prepared(spark, sf_dir)).withColumn("blk", F.floor(F.col("account_id") / BLOCK_ROWS))
    return monitor.drift_by_halves(history, list(fixed.OUTLIER_FALLBACK), "score", ["blk"], ["account_id"])


# ------------------------------------------------------------------ toggles

SOURCES = ("aa", "upi", "bbps", "gst")
_RULES = [r.id for r in rulebook.BANK_RULES]
_PRODUCTS = list(rulebook.PRODUCTS)


def settings(spark, sf_dir) -> DataFrame:
    """A settings log from the parts: a rule, a product or none, a source or none, on or off, in the order of the keys."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 3 != 0, pick(_PRODUCTS, F.col("p_size"))).alias("product"),
        F.when(k % 4 != 0, pick(SOURCES, F.floor(k / 4))).alias("source"),
        pick(_RULES, k).alias("rule_id"),
        (F.floor(k / 3) % 2 == 0).alias("enabled"),
        k.alias("seq"),
    )


def listed(spark) -> DataFrame:
    """Every rule for every product and source."""
    rows = [(p, s, r) for p in _PRODUCTS for s in SOURCES for r in _RULES]
    return spark.createDataFrame(rows, "product string, source string, rule_id string")


def _item(values, at: str) -> str:
    return f"[{oracle.quoted(values)}][CAST({at} % {len(values)} + 1 AS INTEGER)]"


oracle.block(
    "x_setting",
    f"""SELECT CASE WHEN p_size % 3 <> 0 THEN {_item(_PRODUCTS, 'p_size')} END AS product, CASE WHEN p_partkey % 4 <> 0 THEN {_item(SOURCES, '(p_partkey // 4)')} END AS source,
      {_item(_RULES, 'p_partkey')} AS rule_id, (p_partkey // 3) % 2 = 0 AS enabled, p_partkey AS seq FROM part""",
)
oracle.block(
    "x_toggle",
    f"""SELECT l.product, l.source, l.rule_id, coalesce((SELECT s.enabled FROM x_setting s WHERE s.rule_id = l.rule_id AND (s.product IS NULL OR s.product = l.product) AND (s.source IS NULL OR s.source = l.source)
        ORDER BY s.product IS NOT NULL DESC, s.source IS NOT NULL DESC, s.seq DESC LIMIT 1), true) AS enabled
      FROM (SELECT unnest([{oracle.quoted(_PRODUCTS)}]) AS product) p, (SELECT unnest([{oracle.quoted(SOURCES)}]) AS source) s, (SELECT unnest([{oracle.quoted(_RULES)}]) AS rule_id) r, LATERAL (SELECT p.product, s.source, r.rule_id) l""",
)


@query("j02_product_source_toggles", "SELECT product, source, rule_id, enabled FROM x_toggle")
def toggles(spark, sf_dir):
    return rules.resolved_toggles(listed(spark), settings(spark, sf_dir))


@query(
    "c13_toggled_rules",
    f"""SELECT account_id, product, CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (status = 'FAIL') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'SKIP') AS BIGINT) AS skipped
    FROM (SELECT *, {_item(_PRODUCTS, 'account_id')} AS product FROM x_bank_rules) JOIN x_toggle USING (product, rule_id) WHERE source = 'aa' AND enabled GROUP BY ALL""",
)
def toggled_rules(spark, sf_dir):
    """Bank rules of every account under the toggles of its product and the statement source."""
    _, ctx = context_of(spark, sf_dir)
    product = F.element_at(F.array(*[F.lit(p) for p in _PRODUCTS]), (F.col("account_id") % len(_PRODUCTS) + 1).cast("int"))
    results = rules.evaluate(ctx, rulebook.BANK_RULES, detail=False).withColumn("product", product)
    on = rules.resolved_toggles(listed(spark), settings(spark, sf_dir)).where("source = 'aa'")
    kept = rules.enabled_only(results, on, ("product", "rule_id"))
    n = lambda s: F.count_if(F.col("status") == s)
    return kept.groupBy("account_id", "product").agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"))


# ------------------------------------------------------------------ roll-ups


def _long(rows: DataFrame) -> DataFrame:
    """Payment targets as (head, value, label) rows."""
    none_v, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    item = lambda h, v, s: F.struct(F.lit(h).alias("head"), v.alias("value"), s.alias("label"))
    return rows.select(
        F.inline(
            F.array(
                item("risk", none_v, F.col("risk_band")),
                item("reliability", F.col("reliability"), none_s),
                item("behaviour", none_v, F.col("behaviour")),
                item("stability", F.col("stability"), none_s),
            )
        )
    )


def _flat(summary: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.map_entries("distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return summary.withColumn("distribution", text)


@query(
    "d15_head_summary",
    f"""SELECT * FROM (WITH t AS ({_PAYMENT_SQL}),
    l AS (SELECT 'risk' AS head, risk_band AS label FROM t UNION ALL SELECT 'behaviour', behaviour FROM t),
    c AS (SELECT head, label, count(*) AS n FROM l GROUP BY ALL)
    SELECT head, CAST(sum(n) AS BIGINT) AS n, NULL::DOUBLE AS value, arg_min(label, (-n, label)) AS label, string_agg(label || '=' || n, ',' ORDER BY label) AS distribution FROM c GROUP BY head
    UNION ALL SELECT 'reliability', count(*), round_even(avg(reliability), 2), NULL, '' FROM t
    UNION ALL SELECT 'stability', count(*), round_even(avg(stability), 2), NULL, '' FROM t)""",
)
def head_summary(spark, sf_dir):
    """The four payment targets of all accounts rolled up per head."""
    return _flat(heads.head_summary(_long(payment_rows(spark, sf_dir))))


@query("d15_fitted_head_summary")
def fitted_head_summary(spark, sf_dir):
    """The same from the predictions of the four fitted heads."""
    rows = payment_rows(spark, sf_dir)
    parts = [
        heads.predict(heads.fit(rows, h, "random_forest"), rows, h, "account_id").select("head", "value", "label")
        for h in _heads("upi", payment_features(spark, sf_dir))
    ]
    return _flat(heads.head_summary(stage(reduce(DataFrame.unionByName, parts))))


@query(
    "d16_source_rollup",
    """SELECT CAST(k % 7 AS BIGINT) AS source_id, count(*) AS statements, round_even(avg(score), 2) AS avg_score, CAST(sum(businesses) AS BIGINT) AS businesses,
      CAST(sum(low) AS BIGINT) AS low, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(high) AS BIGINT) AS high, CAST(sum(gstr1) AS BIGINT) AS gstr1, CAST(sum(gstr3b) AS BIGINT) AS gstr3b, CAST(0 AS BIGINT) AS gstr2a, CAST(sum(gstr2b) AS BIGINT) AS gstr2b
    FROM (SELECT k % 21 AS k, avg(head_score) AS score, count(*) AS businesses, count(*) FILTER (head_risk = 'LOW') AS low, count(*) FILTER (head_risk = 'MEDIUM') AS medium, count(*) FILTER (head_risk = 'HIGH') AS high,
        sum(n) AS gstr1, sum(n3) AS gstr3b, sum(n) AS gstr2b
      FROM (SELECT *, CAST(substr(gstin, 4, 10) AS BIGINT) AS k FROM x_gst_heads) JOIN (SELECT gstin, count(*) AS n, count(*) FILTER (kept > 0) AS n3 FROM x_gst_p GROUP BY 1) USING (gstin) GROUP BY 1)
    GROUP BY 1""",
)
def source_rollup(spark, sf_dir):
    """Tax runs of 21 statements in 7 sources: returns seen, businesses and scores per source."""
    rows = returns(spark, sf_dir)
    seen = rows.groupBy("gstin").agg(*[F.count_if(F.col("return_type") == t).alias(t.lower()) for t in ("GSTR1", "GSTR3B", "GSTR2A", "GSTR2B")])
    profiles = gst.policy_heads(gst.profiles(rows, AS_OF)).select("gstin", "head_score", "head_risk").join(seen, "gstin")
    block = F.substring("gstin", 4, 10).cast("bigint") % 21
    flag = lambda v: F.count_if(F.col("head_risk") == v).alias(v.lower())
    blocks = profiles.groupBy(block.alias("block")).agg(
        F.count(F.lit(1)).alias("businesses"), F.avg("head_score").alias("avg_score"), flag("LOW"), flag("MEDIUM"), flag("HIGH"),
        *[F.sum(t).alias(t) for t in ("gstr1", "gstr3b", "gstr2a", "gstr2b")],
    )
    return gst.source_rollup(blocks.withColumn("source_id", F.col("block") % 7))


# ------------------------------------------------------------------ ranking of tax features

_TAX = ["annualised_gst_turnover", "monthly_turnover", "turnover_growth_yoy", "turnover_decline_percentage", "filing_regularity_percentage",
        "missed_return_count", "late_return_count", "top_buyer_sales_percentage", "unique_buyer_count", "itc_claimed_amount"]
_CLASSES = {"gst_status": ["ACTIVE", "CANCELLED"], "return_status": ["FILED", "LATE"]}
_SCALED = [(n, f"coalesce(CAST({n} AS DOUBLE), 0)") for n in _TAX] + [
    (f"{n}_{v}", f"CASE WHEN upper({n}) = '{v}' THEN 1.0 ELSE 0.0 END") for n, vs in _CLASSES.items() for v in vs
]


@query(
    "d18_tax_feature_ranking",
    "SELECT rank, feature, variance, rank <= 8 AS selected FROM (SELECT *, row_number() OVER (ORDER BY v DESC, ord) AS rank, round_even(v, 6) AS variance FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, '{n}' AS feature, var_samp(({e}) / (SELECT coalesce(nullif(max({e}) - min({e}), 0), 1) FROM x_gst_profile)) AS v FROM x_gst_profile"
        for i, (n, e) in enumerate(_SCALED)
    )
    + "))",
)
def tax_ranking(spark, sf_dir):
    return features.range_ranking(gst.profiles(returns(spark, sf_dir), AS_OF), _TAX, _CLASSES)


# ------------------------------------------------------------------ runs, statements, evaluations


def _applicants(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where(k % 5 != 0).select(
        k.alias("id"),
        F.when(k % 3 == 0, F.concat(F.lit("REF-"), k.cast("string"))).alias("ref_id"),
        F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("Bank "), F.col("c_nationkey").cast("string"))).alias("bank_name"),
    )


def _statements(spark, sf_dir):
    """Statements of the runs: every number is a file; some have no name."""
    r = runs(spark, sf_dir).where("statement_id is not null and statement_id % 3 <> 0")
    return r.groupBy(F.col("statement_id").alias("id")).agg(
        F.max("applicant_id").alias("_a"), F.min("created_at").alias("at")
    ).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("stmt_"), F.col("id").cast("string"), F.lit(".csv"))).alias("file_name"),
        (F.col("_a") % 25).alias("source_id"),
        "at",
    )


oracle.block(
    "x_stmt",
    """SELECT statement_id AS id, CASE WHEN statement_id % 2 = 0 THEN 'stmt_' || statement_id || '.csv' END AS file_name, max(applicant_id) % 25 AS source_id, min(created_at) AS made
    FROM x_run WHERE statement_id IS NOT NULL AND statement_id % 3 <> 0 GROUP BY statement_id""",
)


@query(
    "c09_recent_activity",
    """SELECT o.id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'REF-' || c_custkey END, CASE WHEN c_custkey % 4 <> 0 THEN c_name END, file_name, 'Statement #' || s.id, 'RUN-' || o.id) AS label,
      coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'Bank ' || c_nationkey END, file_name, '-') AS bank, created_at AS "date", transaction_count, credit_score, risk_grade, 'ANALYZED' AS status
    FROM (SELECT * FROM x_one ORDER BY id DESC LIMIT 50) o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = applicant_id LEFT JOIN x_stmt s ON s.id = o.statement_id""",
)
def recent_activity(spark, sf_dir):
    return wh.recent_activity(wh.representative_runs(runs(spark, sf_dir)), _applicants(spark, sf_dir), _statements(spark, sf_dir), keep=50)


@query(
    "c14_attached_evaluations",
    """SELECT * FROM (WITH e AS (SELECT l_orderkey AS id, CASE WHEN min(l_suppkey) % 10 <> 0 THEN min(l_suppkey) % 30 END AS source_id, CAST(min(l_shipdate) AS DATE) AS made, min(l_returnflag) AS decision FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT source_id, made, max(max(id)) OVER (PARTITION BY source_id ORDER BY made) AS statement_id FROM x_stmt GROUP BY source_id, made),
    f AS (SELECT e.*, statement_id FROM e ASOF LEFT JOIN s ON e.source_id = s.source_id AND e.made >= s.made),
    r AS (SELECT statement_id, created_at AS made, max(max(id)) OVER (PARTITION BY statement_id ORDER BY created_at) AS run_id FROM x_run WHERE statement_id IS NOT NULL GROUP BY statement_id, created_at),
    o AS (SELECT f.*, run_id AS own FROM f ASOF LEFT JOIN r ON f.statement_id = r.statement_id AND f.made >= r.made),
    a AS (SELECT created_at AS made, max(max(id)) OVER (ORDER BY created_at) AS any_run FROM x_run WHERE data_source = 'UPLOADED_STATEMENT' GROUP BY created_at)
    SELECT max(id) AS id, run_id, arg_max(decision, id) AS decision FROM (SELECT o.*, coalesce(own, any_run) AS run_id FROM o ASOF LEFT JOIN a ON o.made >= a.made) WHERE run_id IS NOT NULL GROUP BY run_id)""",
)
def attached_evaluations(spark, sf_dir):
    """Orders as evaluations of a source on the day they first ship, attached to the runs there were."""
    supplier = F.min("l_suppkey")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.when(supplier % 10 != 0, supplier % 30).alias("source_id"),
        F.to_date(F.min("l_shipdate")).alias("at"),
        F.min("l_returnflag").alias("decision"),
    )
    own = runs(spark, sf_dir).withColumnRenamed("created_at", "at")
    return wh.attached_evaluations(lines, _statements(spark, sf_dir), own).select("id", "run_id", "decision")
