"""Block-wise operators against plain loops, with blocks and hot limits small enough to split."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from uwspark.operators import bbps, context, features, ledger, monitor, scale, scoring, upi

SCHEMA = "account_id long, seq long, txn_date date, narration string, txn_type string, amount double, balance double"
D0 = dt.date(2024, 1, 1)


def make_rows(seed, n=120, accounts=3, undated=0.1, spread=40):
    rnd = random.Random(seed)
    rows = []
    for a in range(accounts):
        size = n if a == 0 else rnd.randint(1, 25)  # account 0 is the hot one
        days = sorted(rnd.randint(0, spread) for _ in range(size))
        for i in range(size):
            rows.append((
                a, i, None if rnd.random() < undated else D0 + dt.timedelta(days=days[i]),
                rnd.choice(["UPI ACME STORE", "NEFT ACME SALARY", "ATM", "RENT PAYMENT", "ECS RETURN", "x", "PAID RS.1,250.50"]),
                rnd.choice(["CREDIT", "DEBIT"]),
                None if rnd.random() < 0.15 else float(rnd.choice([100, 100.5, 101, 118, 114.9, 250, 85, 87, 5000])),
                float(rnd.randint(-50, 500)) if rnd.random() < 0.2 else None,
            ))
    return rows


def frame(spark, rows, block=4):
    return scale.with_block(spark.createDataFrame(rows, SCHEMA), rows=block)


def by_account(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_running_balance_matches_loop(spark, seed):
    rows = make_rows(seed)
    openings = {0: 1000.0, 1: None}
    acc = spark.createDataFrame(list(openings.items()), "account_id long, opening_balance double")
    got = {(r.account_id, r.seq): r.running for r in ledger.running_balance(frame(spark, rows), acc).collect()}
    for a, txns in by_account(rows).items():
        bal = openings.get(a)
        for r in txns:
            if r[6] is not None:
                bal = r[6]
            elif bal is not None:
                bal += (r[5] or 0.0) if r[4] == "CREDIT" else -(r[5] or 0.0)
            assert got[(a, r[1])] == pytest.approx(bal) if bal is not None else got[(a, r[1])] is None
    assert len(got) == len(rows)


def test_last_known_crosses_blocks(spark):
    rows = make_rows(3)
    out = ledger.last_known(frame(spark, rows, 3), "balance", before="b", upto="u").collect()
    got = {(r.account_id, r.seq): (r.b, r.u) for r in out}
    for a, txns in by_account(rows).items():
        last = None
        for r in txns:
            before = last
            last = r[6] if r[6] is not None else last
            assert got[(a, r[1])] == (before, last)


def test_numbering_splits_hot_keys(spark):
    rnd = random.Random(5)
    rows = [(0 if i % 3 else i % 7, rnd.randint(0, 5), rnd.randint(0, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, day long, slot long, id long")
    spread = scale.spread_hot(df, ["k"], {"_d": F.col("day"), "_s": F.col("slot")}, hot_rows=50)
    assert spread.where("_d >= 0").count() > 0 and spread.where("_d = -1").count() > 0
    got = {r.id: r.seq for r in scale.number_rows(spread, ["k"], ["_d", "_s"], ["day", "slot", "id"]).collect()}
    for k in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])
        assert [got[r[3]] for r in want] == list(range(len(want)))


def test_percentiles_are_exact(spark):
    rnd = random.Random(7)
    rows = [(k, round(rnd.gauss(0, 10 ** (k + 1)), k)) for k in range(3) for _ in range(rnd.randint(1, 400))]
    rows += [(9, 5.0)] * 50
    df = spark.createDataFrame(rows, "k long, x double")
    probs = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in scale.exact_percentiles(scale.value_counts(df, ["k"], "x"), ["k"], probs).collect():
        xs = [x for k, x in rows if k == r.k]
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.percentile(xs, p * 100))


def test_median_abs_deviation(spark):
    rnd = random.Random(8)
    rows = [(m, rnd.random() * 100) for m in "ab" for _ in range(101)]
    long = spark.createDataFrame(rows, "metric string, value double")
    for r in scale.median_abs_deviation(long, ["metric"], "value").collect():
        xs = [x for m, x in rows if m == r.metric]
        med = statistics.median(xs)
        assert r.med == pytest.approx(med)
        assert r.mad == pytest.approx(statistics.median(abs(x - med) for x in xs))


def brute_partner(txns, is_query, is_partner, ok):
    dated = sorted((r for r in txns if r[2] and r[5] and r[5] > 0), key=lambda r: r[2])
    hits = set()
    for i, r in enumerate(dated):
        if is_query(r) and any(
            (q[2] - r[2]).days <= 2 and is_partner(q) and ok(r, q) for q in dated[i + 1:] if (q[2] - r[2]).days <= 2
        ):
            hits.add((r[0], r[1]))
    return hits


@pytest.mark.parametrize("seed,spread", [(11, 40), (12, 3), (13, 1)])
def test_partner_searches_match_brute_force(spark, seed, spread):
    rows = make_rows(seed, n=90, spread=spread)
    led = ledger.tagged(frame(spark, rows, 5)).withColumn("running", F.lit(0.0))
    sig = {(r.account_id, r.seq): r.sig for r in led.select("account_id", "seq", "sig").collect()}
    inflow = spark.createDataFrame([(a, 200.0) for a in range(3)], "account_id long, avg_monthly_inflow double")
    pairs = lambda df: {(r.account_id, r.seq) for r in df.collect()}
    credit, debit = (lambda r: r[4] == "CREDIT"), (lambda r: r[4] == "DEBIT")
    groups = by_account(rows).values()
    want = set().union(*(brute_partner(t, lambda r: credit(r) and r[5] >= 100, debit, lambda r, q: q[5] >= 0.8 * r[5]) for t in groups))
    assert pairs(context.money_in_out(led, inflow)) == want
    same = lambda r, q: sig[(r[0], r[1])] == sig[(q[0], q[1])] and abs(r[5] - q[5]) < 1.0
    want = set().union(*(brute_partner(t, lambda r: True, lambda q: True, same) for t in groups))
    assert want and pairs(context.rapid_duplicates(led)) == want
    want = set().union(*(brute_partner(t, credit, debit, lambda r, q: abs(q[5] - r[5]) / r[5] < 0.15) for t in groups))
    assert pairs(upi.pass_through(led)) == want


def test_cleaning_matches_loop(spark):
    rows = make_rows(21)
    out = {(r.account_id, r.seq): r for r in ledger.clean_statement(frame(spark, rows, 3)).collect()}
    for a, txns in by_account(rows).items():
        last = None
        for r in txns:
            amount, method = r[5], None
            if amount is None:
                if r[6] is not None and last is not None and round(r[6] - last, 2) != 0:
                    amount, method = abs(round(r[6] - last, 2)), "balance change"
                elif "RS.1,250.50" in r[3]:
                    amount, method = 1250.5, "narration"
            got = out[(a, r[1])]
            assert got.method == method
            assert (got.status == "dropped") == (amount is None)
            assert got.c_amount == (pytest.approx(amount) if amount is not None else None)
            last = r[6] if r[6] is not None else last


def test_month_buckets_carry_and_chunk(spark):
    rows = make_rows(31, undated=0.2, spread=90)
    rows += [(7, i, None, "n", "DEBIT", 1.0, None) for i in range(37)]
    got = {(r.account_id, r.seq): r for r in ledger.month_buckets(frame(spark, rows, 4)).collect()}
    for a, txns in by_account(rows).items():
        n = len(txns)
        if sum(1 for r in txns if r[2]) / n >= 0.6:
            last = None
            for r in txns:
                last = r[2] or last
                want = last.strftime("%Y-%m") if last else "0000-00"
                assert got[(a, r[1])].bucket == want
        else:
            periods = max(1, min(12, round(n / 10) or 1))
            size = math.ceil(n / periods)
            for i, r in enumerate(txns):
                assert got[(a, r[1])].bucket_label == f"Period {i // size + 1}"


def test_fence_and_anomalies(spark):
    rows = [(1, i, D0, "SHOP", "DEBIT", float(100 + i), None) for i in range(30)]
    rows += [(1, 30, D0, "UNKNOWN VENDOR", "DEBIT", 900000.0, None), (1, 31, D0, "ECS RETURN", "DEBIT", 10.0, None)]
    df = frame(spark, rows, 7)
    amts = sorted(r[5] for r in rows)
    cut = np.percentile(amts, 95)
    want = max(50000.0, 4 * np.percentile([x for x in amts if x <= cut], 90))
    assert scoring.amount_fence(df, ["account_id", "txn_type"]).first().fence == pytest.approx(want)
    led = ledger.tagged(df).withColumn("running", F.lit(5.0))
    flagged = {r.seq: r for r in scoring.anomaly_rows(led).collect()}
    assert set(flagged) == {30, 31}
    assert flagged[31].score == 80.0 and flagged[30].score == pytest.approx(min(88, 48 + 22 * math.log10(900000 / want + 1)), abs=0.06)
    few = ledger.tagged(frame(spark, rows[-3:])).withColumn("running", F.lit(5.0))
    assert scoring.anomaly_rows(few).count() == 0


def test_chunks_follow_sizes(spark):
    rows = [(a, i, D0, "n", "DEBIT", 1.0, None) for a, n in ((1, 5), (2, 17), (3, 26)) for i in range(n)]
    got = {}
    for r in features.chunked(frame(spark, rows, 4)).collect():
        got.setdefault(r.account_id, {}).setdefault(r.chunk, []).append(r.seq)
    for a, n in ((1, 5), (2, 17), (3, 26)):
        seqs = list(range(n))
        size = max(3, n // 5)
        want = [seqs] if n < 6 else [seqs[i:i + size] for i in range(0, n, size) if len(seqs[i:i + size]) >= 3]
        assert [sorted(v) for _, v in sorted(got[a].items())] == want


def test_psi_matches_numpy(spark):
    rnd = np.random.default_rng(3)
    ref, rec = rnd.normal(0, 1, 300).round(3), rnd.normal(0.4, 1.2, 200).round(3)
    to = lambda xs: spark.createDataFrame([("m", float(x)) for x in xs], "metric string, value double")
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    e = np.clip(np.histogram(ref, edges)[0] / len(ref), 1e-4, None)
    a = np.clip(np.histogram(rec, edges)[0] / len(rec), 1e-4, None)
    assert monitor.psi(to(ref), to(rec)).first().psi == pytest.approx(float(np.sum((a - e) * np.log(a / e))))
    assert monitor.psi(to(ref), to(ref)).first().psi == pytest.approx(0.0, abs=1e-12)
    assert monitor.psi(to([1.0] * 50), to(rec)).first().psi == 0.0


def test_repeat_payments(spark):
    days = [0, 0, 3, 20, 22]
    rows = [(1, i, D0 + dt.timedelta(days=d), "WATER BILL", "DEBIT", 500.2, None) for i, d in enumerate(days)]
    r = bbps.repeats(bbps.utility_rows(frame(spark, rows))).first()
    assert (r.dup, r.rapid) == (4, 3)
