"""Registered queries against their SQL twins on the smallest tables.

A spread of queries over all domains runs by default; UWSPARK_ALL=1 runs every one.
"""

import os

import pytest
from harness import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = """e01_running_balance e03_amount_recovery d04_underwriting_vector k01_k03_score_and_gate d08_k09_rule_context
c02_rapid_duplicates k04_g04_bank_decision k05_product_decisions d11_upi_analysis c03_upi_pass_through d13_bbps_analysis
k13_bbps_fraud_metrics d14_gst_profile k06_gst_decision k10_f01_anomalies e09_score_trajectory d20_d21_drift_report
c08_representative_runs k22_run_upsert a06_e21_text_statements b12_training_validation l01_policy_labels
b12_training_ranges d14_gst_full_profile b18_curated_texts d30_b25_history_lists k19_payload_vector k02_model_blend j03_patched_policy
a09_corpus_version k25_children_rewritten k23_events_appended a12_profiles_by_domain a13_frozen_table k28_business_view_flat
k12_gst_typologies d26_f04_gst_corpus_typologies l05_gst_pattern_labels""".split()
NAMES = sorted(entry.queries()) if os.environ.get("UWSPARK_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ok, message = compare(df, con, sql)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
