"""Tiny blocks and a tiny hot limit must not change any result."""

import pytest
from harness import compare, duck

import __spark_entry__ as entry
from uwspark import staging
from uwspark.operators import scale

SF = "/root/testdata/sf0.001"
NAMES = """e01_running_balance e02_forward_fill e03_amount_recovery c01_money_in_out c03_upi_pass_through e05_chunks
d03_e04_session_features k10_f01_anomalies k18_e12_monthly_analytics e09_score_trajectory""".split()


@pytest.fixture(scope="module")
def small_blocks():
    before = scale.BLOCK_ROWS, scale.HOT_ROWS
    scale.BLOCK_ROWS, scale.HOT_ROWS = 37, 20
    staging.forget()
    yield
    scale.BLOCK_ROWS, scale.HOT_ROWS = before
    staging.forget()


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, small_blocks, name):
    ok, message = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert ok, message
