"""Rows that the operators move: what has no partner is set aside, what lies together is not moved again."""

import datetime as dt
import random

from pyspark.sql import functions as F

from uwspark.operators import context, gst, scale, scoring
from uwspark.sources import adapters


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines())


def test_rows_without_neighbour_are_set_aside(spark, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(scale, "BAND", 16)
    monkeypatch.setattr(scale, "SPAN", 16)
    for reach, days in ((1, 2), (2, 3)):
        rows = [(rnd.randrange(3), i, rnd.randrange(-40, 40), rnd.randrange(-60, 60)) for i in range(300)]
        base = spark.createDataFrame(rows, "k long, seq long, day int, own long")
        kept = {r.seq for r in scale._with_neighbour(base, ["k"], reach, days).collect()}
        near = {a[1] for a in rows for b in rows if a[1] != b[1] and a[0] == b[0] and abs(a[2] - b[2]) <= days and abs(a[3] - b[3]) <= reach}
        assert near <= kept and near
    monkeypatch.undo()
    # one row every ten days at 100 on: only those at an edge of a span are kept
    lonely = spark.range(200).selectExpr("0 as k", "id as seq", "cast(10 * id as int) as day", "100 + id as own")
    assert scale._with_neighbour(lonely, ["k"], 1, 2).count() < 20


def test_credits_and_debits_move_once_for_a_search(spark):
    day = dt.date(2024, 1, 1)
    rows = [(a, i, 0, day + dt.timedelta(days=i), 100.0 * (i % 3 + 1), "CREDIT" if i % 2 else "DEBIT") for a in range(3) for i in range(30)]
    led = spark.createDataFrame(rows, "account_id long, seq long, blk long, txn_date date, amount double, txn_type string")
    inflow = spark.createDataFrame([(a, 300.0) for a in range(3)], "account_id long, avg_monthly_inflow double")
    assert context.money_in_out(led, inflow).count() == 15
    assert "Expand" not in (p := context.money_in_out(led, inflow)._jdf.queryExecution().executedPlan().toString()) and "Union" not in p


def star(spark, folder):
    rnd = random.Random(6)
    at = lambda: dt.datetime(1995, 1, 1) + dt.timedelta(days=rnd.randrange(700))
    lines = [(rnd.randrange(60), rnd.randrange(5), rnd.randrange(9), 1 + rnd.random() * 900, rnd.choice([0.0, 0.05]), 0.1, rnd.choice("ARN"), at()) for _ in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, i % 11) for i in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, ["HOUSEHOLD", "BUILDING"][i % 2], i % 3) for i in range(11)], "c_custkey long, c_mktsegment string, c_nationkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(5)], "s_suppkey long, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")
    return lines


def test_returns_of_lines(spark, tmp_path):
    lines = star(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = adapters.gst_return(spark, str(tmp_path))
        assert exchanges(out) <= 8  # three joins of two sides, orders with their buyers, and the month of the seller
        got = {(r.gstin, r.period): r for r in out.where("return_type = 'GSTR1'").collect()}
        parts = {(r.gstin, r.period): r.supplier_count for r in out.where("return_type = 'GSTR2B'").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {}
    for o, s, p, price, disc, _, _, at in lines:
        buyers, seen = want.setdefault((f"GST{s:010d}", f"{at:%Y-%m}"), ({}, set()))
        buyers[o % 11] = buyers.get(o % 11, 0.0) + price * (1 - disc)
        seen.add(p)
    assert got.keys() == want.keys()
    for k, (buyers, seen) in want.items():
        assert got[k].unique_buyer_count == len(buyers) and parts[k] == len(seen)
        assert abs(got[k].top_buyer_value - max(buyers.values())) < 1e-3 and abs(got[k].taxable_value - sum(buyers.values())) < 1e-3


def test_profiles_move_the_returns_once(spark):
    rows = [(f"G{i % 4}", f"2024-{i % 12 + 1:02d}", t, 10.0 * i, 11.0 * i, "Name" if i % 5 == 0 else None) for i in range(48) for t in ("GSTR1", "GSTR3B")]
    returns = spark.createDataFrame(rows, "gstin string, period string, return_type string, taxable_value double, outward_taxable_value double, legal_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = gst.profiles(returns, "2025-01-01")
        assert exchanges(p) <= 4  # the returns once (three readers), the descriptive fields
        assert {(r.gstin, r.legal_name) for r in p.collect()} == {(f"G{i}", "Name") for i in range(4)}
        bare = gst.metadata(returns.drop("legal_name"))
        assert bare.where(F.coalesce("legal_name", "trade_name").isNull()).count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flagged_rows_of_a_month_are_counted_where_it_lies(spark):
    rnd = random.Random(7)
    nan = float("nan")
    rows = []
    for a in range(4):
        for i in range(400):
            month = f"m{i // 40}"
            amount = rnd.choice([9000.0 * rnd.randrange(1, 9), 40000.0, 2.5e6 * rnd.random(), 30000.0, None, -5.0, nan if a == 3 else 7e5])
            # the months of accounts 2 and 3 cross blocks of 64 rows; those of 0 and 1 lie in one
            blk = i // 40 if a < 2 else i // 64
            word = rnd.choice(["RENT FLAT", "ACME GOODS", "12", "Opening Balance", None])
            sig = None if word is None else word if word.isalpha() or " " in word else ""
            rows.append((a, month, i, blk, dt.date(2024, 1, 1), word, rnd.choice(["DEBIT", "DEBIT", "CREDIT", None, "OTHER"]), amount, rnd.random() < 0.05, sig, 1000.0 * rnd.randrange(-1, 30)))
    rows += [(5, "m0", i, 0, dt.date(2024, 1, 1), "RENT FLAT", "DEBIT", 1e6, False, "RENT FLAT", -1.0) for i in range(7)]  # too few to judge
    rows += [(6, "m0", i, 0, dt.date(2024, 1, 1), f"X{i}", "DEBIT", 5e6 if i == 10 else 100.0, False, f"X{i}", 5.0) for i in range(11)]
    led = spark.createDataFrame(rows, "account_id long, bucket string, seq long, blk long, txn_date date, narration string, txn_type string, amount double, is_bounce boolean, sig string, running double")
    keys = ["account_id", "bucket"]
    want = {(r.account_id, r.bucket): r["count"] for r in scoring.anomaly_rows(led, keys).groupBy(*keys).count().collect()}
    got = {(r.account_id, r.bucket): r.flagged for r in scoring.anomaly_counts(led, keys).collect() if r.flagged}
    assert got == want and len(want) > 30 and want[6, "m0"] == 1 and (5, "m0") not in want
    one = scoring.anomaly_counts(led.where("account_id in (0, 1, 5, 6)"), keys)
    assert exchanges(one) == 1  # the rows of a block; fences, signatures and counts are taken there


def test_monthly_view_moves_rows_few_times(spark):
    rows = [(a, i, 0, dt.date(2024, 1 + i // 40, 1), "RENT FLAT", "DEBIT" if i % 3 else "CREDIT", 100.0 * i, 5000.0 if i % 5 == 0 else None) for a in range(3) for i in range(200)]
    txns = spark.createDataFrame(rows, "account_id long, seq long, blk long, txn_date date, narration string, txn_type string, amount double, balance double")
    openings = spark.createDataFrame([(a, 10.0, "x") for a in range(3)], "account_id long, opening_balance double, account_holder string")
    view = scoring.monthly_view(txns, openings)
    assert exchanges(view) <= 9, exchanges(view)  # the balances are written before; sums, duplicates, anomalies
    assert {(r.account_id, r.bucket, r.volume) for r in view.collect()} == {(a, f"2024-0{m}", 40) for a in range(3) for m in range(1, 6)}
