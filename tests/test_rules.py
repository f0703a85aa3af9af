"""Rule engine, verdict and scorecard on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from uwspark.functions import fixed, rulebook
from uwspark.ml import heads
from uwspark.operators import gst, monitor, patterns, rules, scoring, warehouse

RULE_SCHEMA = "account_id long, ord int, rule_id string, label string, category string, serious boolean, gate boolean, status string, detail string"


def results(spark, *rows):
    return spark.createDataFrame([(1, i, r[0], r[0], "", r[1], r[2], r[3], "") for i, r in enumerate(rows)], RULE_SCHEMA)


@pytest.mark.parametrize(
    "rows,decision",
    [
        ([("credit_score_gate", False, True, "FAIL")], "REJECTED"),
        ([("emi_bounce", True, False, "FAIL"), ("bank_ecs_return", True, False, "FAIL")], "CONDITIONAL APPROVAL"),
        ([("emi_bounce", True, False, "FAIL"), ("cf_deficit", True, False, "FAIL")], "REJECTED"),
        ([("rev_growth", False, False, "FAIL")], "APPROVED WITH NOTES"),
        ([("rev_growth", False, False, "SKIP"), ("exp_ratio", False, False, "PASS")], "APPROVED"),
    ],
)
def test_bank_ladder(spark, rows, decision):
    row = rules.bank_decision(results(spark, *rows)).first()
    assert row.decision == decision
    assert row.passed + row.failed + row.skipped == len(rows)


def test_catalogue_is_complete():
    assert len(rulebook.BANK_RULES) == 116
    assert sum(r.computable for r in rulebook.BANK_RULES) == 69
    assert [len(v) for v in rulebook.PRODUCTS.values()] == [44, 43, 43, 51]
    assert len(rulebook.GST_RULES) == 62 and sum(r.computable for r in rulebook.GST_RULES) == 26


def test_overlay_and_toggles(spark):
    base = rules.catalogue(spark, rulebook.BANK_RULES)
    assert base.where("enabled").count() == 1
    over = spark.createDataFrame(
        [("rev_growth", "Growth, renamed", True), ("house_rule", "House rule", True), ("credit_score_gate", None, False)],
        "rule_id string, label string, enabled boolean",
    )
    out = {r.rule_id: r for r in rules.overlay(base, over).collect()}
    assert out["rev_growth"].label == "Growth, renamed" and out["rev_growth"].enabled
    assert out["house_rule"].category == "Custom" and not out["house_rule"].computable
    assert not out["credit_score_gate"].enabled and len(out) == 117


def test_verdict_ladder(spark):
    flags = spark.createDataFrame(
        [(1, True, True), (2, False, True), (3, False, False), (4, False, False), (5, False, True)],
        "account_id long, hard_match boolean, soft boolean",
    )
    worst = spark.createDataFrame(
        [(1, 0.0, "within"), (2, 2.5, "elevated"), (3, 4.0, "extreme"), (4, 0.5, "within"), (5, 0.0, "within")],
        "account_id long, worst_z double, worst_band string",
    )
    models = spark.createDataFrame([(4, 0.7, 0.1)], "account_id long, fraud_p double, anomaly_p double")
    got = {r.account_id: r for r in patterns.verdicts(flags, worst, models).collect()}
    assert got[1].verdict == "MATCHES FRAUD TYPOLOGY" and got[1].concern_score == 100
    assert got[2].verdict == "ELEVATED ANOMALY SIGNATURE" and got[2].zone == "review"
    assert got[3].verdict == "ELEVATED ANOMALY SIGNATURE" and got[3].reason == "anomaly_metric"
    assert got[4].verdict == "MATCHES FRAUD TYPOLOGY" and got[4].fraud_box == "alert"
    assert got[5].verdict == "SOME ELEVATED SIGNALS" and got[5].zone == "good"


def test_config_patch_ignores_bad_values():
    cfg = scoring.DEFAULT.patched({"gate_threshold": "700", "baseline": "x", "unknown": 1})
    assert cfg.gate_threshold == 700 and cfg.baseline == 740.0


def test_blend_and_score_bounds(spark):
    v = spark.createDataFrame(
        [(1, 0.0, 1000.0, 9, -5.0, 3.0, 0.9, 0.0, 0.0), (2, 90000.0, 10000.0, 0, 200000.0, 0.1, 0.0, 1.0, 9.0)],
        "account_id long, avg_monthly_inflow double, avg_monthly_debit double, nach_bounce_count_90d long, minimum_balance double, "
        "balance_volatility double, cash_withdrawal_ratio double, income_stability double, dscr_ratio double",
    )
    got = {r.account_id: r for r in scoring.credit_score(v).collect()}
    assert got[1].score == 300 and got[1].grade == "HIGH"
    assert got[2].score == 900 and got[2].pd == 0.3
    models = spark.createDataFrame([(1, 900.0, "dataset-v3")], "account_id long, model_score double, model_source string")
    blended = {r.account_id: r for r in scoring.credit_score(v, models).collect()}
    assert blended[1].ml_blended and blended[1].score > 300 and not blended[2].ml_blended


def test_outlier_and_promotion():
    assert monitor.promotion_guard(0.9, None)["promote"]
    assert monitor.promotion_guard(0.9, 0.92)["promote"] and not monitor.promotion_guard(0.9, 0.95)["promote"]


def test_gst_duplicates_and_status_fallback(spark):
    rows = [
        ("G1", "2024-01", "GSTR3B", 0, 100.0, "LATE"), ("G1", "2024-01", "GSTR3B", 1, 200.0, "FILED"),
        ("G1", "2024-02", "GSTR3B", 2, 150.0, "LATE"), ("G1", "2024-03", "GSTR1", 3, None, None),
    ]
    r = spark.createDataFrame(rows, "gstin string, period string, return_type string, file_seq long, outward_taxable_value double, return_status string")
    p = gst.profiles(r, "2025-01-01").first()
    assert p.monthly_turnover == 150.0 and p.turnover_growth_mom == -25.0
    assert p.consecutive_declining_quarters == 1 and p.late_return_count == 1 and p.missed_return_count == 1
    assert p.filing_regularity_percentage == 50.0 and p.business_vintage_years == 1.0


def test_warehouse_joins(spark):
    a = spark.createDataFrame([(1, "stmt_9.pdf"), (2, "Asha"), (3, "Ravi")], "id long, name string")
    runs = spark.createDataFrame(
        [(10, 1, None, "m"), (11, 2, 5, "m"), (12, 2, 5, "m")], "id long, applicant_id long, statement_id long, model_id string"
    )
    assert [r.id for r in warehouse.orphan_applicants(a, runs.where("statement_id is not null"), runs).collect()] == [3]
    assert [r.id for r in warehouse.stray_runs(runs, a).collect()] == [10]
    assert sorted(r.id for r in warehouse.upsert_runs(runs).collect()) == [10, 12]


def test_registry_keeps_best_allowed_version(spark):
    v = spark.createDataFrame(
        [("upi", 1, 0.8, 0.8, 0.5, True), ("upi", 2, 0.9, 0.9, 0.9, False), ("upi", 3, 0.7, 0.9, 0.6, True)],
        "domain string, version int, accuracy double, f1 double, r2 double, may_promote boolean",
    )
    assert [r.version for r in heads.with_active(v).where("active").collect()] == [1]


def test_training_rows_rejected_by_first_reason(spark):
    rows = [(1, 5.0, 30, 0), (2, 5.0, 30, 0), (3, -1.0, 30, 1), (4, 5.0, 12, 1), (5, 5.0, 40, 7), (6, None, None, None)]
    out = monitor.validate_training_rows(spark.createDataFrame(rows, "id long, monthly_income double, age long, label long"), "id")
    got = {r.id: r.reason for r in out.collect()}
    assert got == {
        1: None, 2: "exact duplicate", 3: "monthly_income out of range", 4: "age out of range", 5: "label not 0/1", 6: "empty row",
    }


def test_clamp(spark):
    v = spark.createDataFrame([(1, 5.0e9, 0.5)], "account_id long, avg_monthly_inflow double, income_stability double")
    r = monitor.clamped(v).withColumn("n", F.size("warnings")).first()
    assert r.avg_monthly_inflow == fixed.GUARD_BOUNDS["avg_monthly_inflow"][1]
    assert "avg_monthly_inflow clamped" in r.warnings and "dscr_ratio missing" in r.warnings
