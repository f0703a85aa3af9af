"""ANSI SQL twins: named building blocks and a resolver that prefixes the needed ones.

The blocks are written for small data with plain windows and self-joins; they say
what a query must return, not how to compute it at scale.
"""

from __future__ import annotations

import re

from ..functions import figures, fixed
from ..sources import adapters

BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql.strip()


def twin(select: str) -> str:
    """`select` with every referenced block (and what those need) as a WITH clause."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bx_\w+", sql)):
            if word in BLOCKS and word not in order:
                visit(BLOCKS[word])
                order.append(word)

    visit(select)
    if not order:
        return select.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{BLOCKS[n]}\n)" for n in order) + "\n" + select.strip()


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tags(narration: str = "narration") -> str:
    return ",\n".join(
        f"regexp_matches({narration}, '{p}') AS {n}" for n, p in fixed.TAG_PATTERNS.items()
    )


def sig(narration: str = "narration") -> str:
    return (
        f"array_to_string(list_filter(regexp_extract_all(upper({narration}), '[A-Z]{{3,}}'), "
        f"lambda w: NOT list_contains([{quoted(fixed.SIGNATURE_STOPWORDS)}], w))[1:3], ' ')"
    )


def utility(narration: str = "narration") -> str:
    arms = " ".join(
        f"WHEN regexp_matches({narration}, '{p}') THEN '{k}'" for k, p in fixed.UTILITY_PATTERNS.items()
    )
    return f"CASE {arms} WHEN regexp_matches({narration}, '{fixed.BBPS_HINT}') THEN 'OTHER_BBPS' END"


def div0(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(CAST(({b}) AS DOUBLE), 0), 0.0)"


# ------------------------------------------------------------------ inputs

block(
    "x_account",
    "SELECT s_suppkey AS account_id, s_acctbal AS opening_balance, s_name AS account_holder FROM supplier",
)
block(
    "x_numbered",
    """
SELECT l.*, CAST(l_shipdate AS DATE) AS d,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber,
    l_partkey, l_extendedprice) - 1 AS BIGINT) AS seq
FROM lineitem l""",
)
block(
    "x_bank",
    f"""
SELECT l_suppkey AS account_id, seq, d AS txn_date,
  [{quoted(adapters.NARRATIONS)}][CAST(l_partkey % 16 + 1 AS INTEGER)] || ' ' || p_brand AS narration,
  CASE WHEN l_linestatus = 'O' THEN 'CREDIT' ELSE 'DEBIT' END AS txn_type,
  CASE WHEN seq % 17 <> 16 THEN l_extendedprice END AS amount,
  CASE WHEN seq % 5 = 0 THEN CAST(floor(l_extendedprice * (l_discount * 10 + 0.5) - 20000 * l_tax) AS DOUBLE) END AS balance
FROM x_numbered JOIN part ON p_partkey = l_partkey""",
)
block(
    "x_anchored",
    """
SELECT *, count(balance) OVER (PARTITION BY account_id ORDER BY seq) AS g,
  last_value(balance IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY seq) AS fill_balance,
  last_value(balance IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_balance
FROM x_bank""",
)
block(
    "x_ledger",
    f"""
SELECT a.account_id, seq, txn_date, narration, txn_type, amount, balance, fill_balance, prev_balance,
  coalesce(fill_balance, opening_balance)
   + sum(CASE WHEN balance IS NOT NULL THEN 0.0 WHEN txn_type = 'CREDIT' THEN coalesce(amount, 0) ELSE -coalesce(amount, 0) END)
     OVER (PARTITION BY a.account_id, g ORDER BY seq) AS running,
  strftime(txn_date, '%Y-%m') AS month,
  {tags()},
  {sig()} AS sig
FROM x_anchored a JOIN x_account USING (account_id)""",
)

# ------------------------------------------------------------------ vector and score

block(
    "x_months",
    """
SELECT account_id, month, sum(amount) AS credit FROM x_ledger
WHERE txn_type = 'CREDIT' GROUP BY ALL""",
)
block(
    "x_stability",
    """
SELECT account_id, CASE WHEN count(*) < 2 THEN 0.6 ELSE greatest(0.0, 1.0 - stddev_pop(credit) / avg(credit)) END AS stability
FROM x_months WHERE credit > 0 GROUP BY account_id""",
)
block(
    "x_totals",
    """
SELECT account_id, count(*) AS n, count(txn_date) AS dated, min(txn_date) AS d0, max(txn_date) AS d1,
  round_even(coalesce(sum(amount) FILTER (txn_type = 'CREDIT'), 0.0), 2) AS tc,
  round_even(coalesce(sum(amount) FILTER (txn_type = 'DEBIT'), 0.0), 2) AS td,
  CAST(count(*) FILTER (is_bounce) AS BIGINT) AS bounces,
  coalesce(sum(amount) FILTER (txn_type = 'DEBIT' AND is_cash), 0.0) AS cash_out,
  count(running) AS rn, avg(running) AS r_avg, stddev_pop(running) AS r_sd, min(running) AS r_min,
  any_value(stability) AS stability
FROM x_ledger LEFT JOIN x_stability USING (account_id) GROUP BY account_id""",
)


def vector_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, statement_months,
  round_even(tc / statement_months, 0) AS avg_monthly_inflow,
  round_even(td / statement_months, 0) AS avg_monthly_debit,
  bounces AS nach_bounce_count_90d,
  CASE WHEN td > 0 THEN least(9.99, round_even(tc / td, 2)) WHEN tc > 0 THEN 3.0 ELSE 0.0 END AS dscr_ratio,
  round_even({div0('cash_out', 'td')}, 4) AS cash_withdrawal_ratio,
  balance_volatility, balance_volatility AS transaction_volatility,
  round_even(coalesce(r_min, 0.0), 0) AS minimum_balance, round_even(coalesce(r_avg, 0.0), 0) AS avg_balance,
  round_even({div0('td', 'tc')} * 100, 2) AS foir_ratio,
  round_even(coalesce(stability, 0.6), 3) AS income_stability
FROM (SELECT *, greatest(1.0, CASE WHEN dated >= 2 THEN round_even((datediff('day', d0, d1) + 1) / 30.44, 2)
          ELSE round_even(n / 30.0, 2) END) AS statement_months,
        round_even(least(5.0, CASE WHEN rn >= 2 THEN CASE WHEN r_avg > 0 THEN r_sd / r_avg ELSE 1.0 END ELSE 0.3 END), 4) AS balance_volatility
      FROM {source})"""


SCORE_SQL = """
 740.0
 + greatest(-180.0, least(55.0, sr * 220.0)) + CASE WHEN sr < -0.15 THEN -45.0 ELSE 0.0 END
 + (income_stability - 0.60) * 130.0
 + CASE WHEN nach_bounce_count_90d > 0 THEN -least(260.0, 110.0 + (nach_bounce_count_90d - 1) * 80.0) ELSE 0.0 END
 + CASE WHEN minimum_balance < 0 THEN -170.0 WHEN minimum_balance < 2000 THEN -70.0 WHEN minimum_balance < 10000 THEN -25.0
        WHEN minimum_balance > 100000 THEN 25.0 ELSE 0.0 END
 - greatest(0.0, least(1.2, balance_volatility - 0.40)) * 70.0
 - greatest(0.0, least(0.4, cash_withdrawal_ratio - 0.12)) * 250.0
 + CASE WHEN dscr_ratio >= 1.30 THEN least(35.0, (dscr_ratio - 1.30) * 40.0) ELSE 0.0 END"""


def scored_sql(source: str) -> str:
    return f"""
SELECT *, CASE WHEN score >= 700 THEN 'LOW' WHEN score >= 550 THEN 'MEDIUM' ELSE 'HIGH' END AS grade_raw,
  greatest(0.3, round_even((850.0 - score) / 850.0 * 18.0, 1)) AS pd,
  score > 650 AS gate_passed,
  CASE WHEN score > 650 THEN 'LOW' ELSE 'HIGH' END AS grade,
  CASE WHEN score > 650 THEN 'APPROVED' ELSE 'REJECTED' END AS decision
FROM (SELECT *, CAST(greatest(300.0, least(900.0, round_even(card, 0))) AS BIGINT) AS score,
        CAST(round_even(card, 0) AS BIGINT) AS scorecard_score
      FROM (SELECT *, {SCORE_SQL} AS card
            FROM (SELECT *, CASE WHEN avg_monthly_inflow > 0 THEN (avg_monthly_inflow - avg_monthly_debit) / avg_monthly_inflow
                         ELSE -1.0 END AS sr FROM {source})))"""


block("x_vector", vector_sql("x_totals", "account_id"))
block("x_score", scored_sql("x_vector"))

# ------------------------------------------------------------------ rule context

block("x_pos", "SELECT * FROM x_ledger WHERE amount > 0")
block(
    "x_monthly",
    """
SELECT account_id, month, coalesce(sum(amount) FILTER (txn_type = 'CREDIT'), 0.0) AS inflow,
  coalesce(sum(amount) FILTER (txn_type <> 'CREDIT'), 0.0) AS outflow, count(*) AS rows,
  arg_max(running, seq) AS end_balance
FROM x_pos GROUP BY ALL""",
)
block(
    "x_shape",
    """
SELECT account_id, count(*) AS n_months, avg(inflow) AS inflow_mean,
  CASE WHEN count(*) >= 2 THEN coalesce(stddev_pop(inflow) / nullif(avg(inflow), 0), 0.0) ELSE 0.0 END AS inflow_cv,
  CAST(count(*) FILTER (inflow <= 1.0) AS BIGINT) AS zero_inflow_months,
  CAST(count(*) FILTER (outflow > inflow) AS BIGINT) AS deficit_months,
  CASE WHEN count(*) >= 4 THEN coalesce((avg(inflow) FILTER (k > n // 2) - avg(inflow) FILTER (k <= n // 2))
     / nullif(avg(inflow) FILTER (k <= n // 2), 0), 0.0) END AS growth,
  count(*) FILTER (end_balance IS NOT NULL) >= 3 AND count(*) FILTER (prev < end_balance) = 0 AS balance_declining,
  min(rows) <= 1 AS dormant, min(inflow) > 0 AND min(outflow) > 0 AS active_every_month,
  count(*) >= 3 AND max(rows) > 3 * avg(rows) AS activity_spike
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month) AS k,
        count(*) OVER (PARTITION BY account_id) AS n,
        lag(end_balance) OVER (PARTITION BY account_id ORDER BY month) AS prev FROM x_monthly)
GROUP BY account_id""",
)
block(
    "x_party",
    """
SELECT account_id, txn_type, CASE WHEN sig <> '' THEN sig ELSE narration END AS party,
  sum(amount) AS amt, count(*) AS cnt FROM x_pos GROUP BY ALL""",
)
block(
    "x_conc",
    """
SELECT account_id, CAST(count(*) FILTER (txn_type = 'CREDIT') AS BIGINT) AS unique_payees,
  CAST(count(*) FILTER (txn_type = 'CREDIT' AND cnt >= 2) AS BIGINT) AS repeat_payees,
  coalesce(sum(amt) FILTER (txn_type = 'CREDIT' AND rk <= 1), 0.0) AS top1,
  coalesce(sum(amt) FILTER (txn_type = 'CREDIT' AND rk <= 3), 0.0) AS top3,
  coalesce(sum(amt) FILTER (txn_type = 'CREDIT' AND rk <= 5), 0.0) AS top5,
  coalesce(sum(amt) FILTER (txn_type = 'DEBIT' AND rk <= 1), 0.0) AS top_supplier
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, txn_type ORDER BY amt DESC, party) AS rk FROM x_party)
GROUP BY account_id""",
)
block(
    "x_inout",
    """
SELECT account_id, seq FROM x_pos c JOIN x_vector v USING (account_id)
WHERE c.txn_type = 'CREDIT' AND v.avg_monthly_inflow > 0 AND c.amount >= 0.5 * v.avg_monthly_inflow
  AND EXISTS (SELECT 1 FROM x_pos d WHERE d.account_id = c.account_id AND d.txn_type = 'DEBIT'
     AND d.txn_date BETWEEN c.txn_date AND c.txn_date + 2 AND (d.txn_date > c.txn_date OR d.seq > c.seq)
     AND d.amount >= 0.8 * c.amount)""",
)
block(
    "x_rapid",
    """
SELECT account_id, seq FROM x_pos c
WHERE EXISTS (SELECT 1 FROM x_pos d WHERE d.account_id = c.account_id AND d.sig = c.sig
     AND d.txn_date BETWEEN c.txn_date AND c.txn_date + 2 AND (d.txn_date > c.txn_date OR d.seq > c.seq)
     AND abs(d.amount - c.amount) < 1.0)""",
)


def _tag_sums() -> str:
    spec = [
        ("emi", "DEBIT", "is_emi"), ("gst", "DEBIT", "is_gst"), ("rent", "DEBIT", "is_rent"),
        ("util", "DEBIT", "is_utility"), ("salary", "CREDIT", "is_salary"), ("upi", "CREDIT", "is_upi"),
        ("cash_in", "CREDIT", "is_cash"), ("cash_out", "DEBIT", "is_cash"), ("tax", "DEBIT", "is_tax"),
    ]
    return ",\n".join(
        f"CAST(count(*) FILTER (amount > 0 AND txn_type = '{t}' AND {f}) AS BIGINT) AS {n}_n, "
        f"coalesce(sum(amount) FILTER (amount > 0 AND txn_type = '{t}' AND {f}), 0.0) AS {n}_amt"
        for n, t, f in spec
    )


block(
    "x_counters",
    f"""
SELECT account_id, CAST(count(*) FILTER (amount > 0) AS BIGINT) AS n_txns,
  CAST(count(*) FILTER (amount > 0 AND txn_type = 'CREDIT') AS BIGINT) AS n_credits,
  coalesce(sum(amount) FILTER (amount > 0 AND txn_type = 'CREDIT'), 0.0) AS total_credit,
  coalesce(sum(amount) FILTER (amount > 0 AND txn_type = 'DEBIT'), 0.0) AS total_debit,
  coalesce(max(amount) FILTER (amount > 0 AND txn_type = 'CREDIT'), 0.0) AS largest_credit,
  CAST(count(*) FILTER (running < 0) AS BIGINT) AS neg_points,
  CAST(count(*) FILTER (running >= 0 AND running < 2000) AS BIGINT) AS low_bal_points,
  avg(running) AS avg_bal, min(running) AS min_bal,
  {_tag_sums()},
  CAST(count(*) FILTER (amount > 0 AND is_reversal) AS BIGINT) AS reversal_count,
  CAST(count(*) FILTER (amount > 0 AND is_bounce) AS BIGINT) AS bounce_count,
  CAST(count(*) FILTER (txn_type = 'CREDIT' AND amount >= 50000 AND amount % 50000 = 0) AS BIGINT) AS round_credits,
  CAST(count(*) FILTER (txn_type = 'CREDIT' AND is_cash AND (amount >= 40000 AND amount < 50000
     OR amount >= 90000 AND amount < 100000 OR amount >= 190000 AND amount < 200000)) AS BIGINT) AS structuring_credits,
  count(DISTINCT sig) FILTER (amount > 0 AND txn_type = 'DEBIT' AND is_emi AND sig <> '') AS emi_lenders,
  count(DISTINCT month) FILTER (amount > 0 AND txn_type = 'DEBIT' AND is_emi) AS emi_months
FROM x_ledger GROUP BY account_id""",
)
block(
    "x_context0",
    f"""
SELECT s.account_id, statement_months, avg_monthly_inflow, avg_monthly_debit, dscr_ratio, cash_withdrawal_ratio,
  foir_ratio, income_stability, score, pd, grade, CAST(NULL AS DOUBLE) AS account_age_days,
  n_txns, n_credits, total_credit, total_debit, largest_credit, neg_points, low_bal_points,
  k.avg_bal, k.min_bal, emi_n AS emi_txn_count, gst_n AS gst_count, tax_n AS tax_count, rent_n AS rent_count, util_n AS util_count,
  salary_n AS salary_in_count, upi_n AS upi_credit_count, upi_amt AS upi_credit_amt, cash_in_amt AS cash_deposit_amt,
  cash_out_n AS cash_wd_count, reversal_count, bounce_count, round_credits, structuring_credits, emi_lenders, emi_months,
  n_months, inflow_mean, inflow_cv, zero_inflow_months, deficit_months, growth, balance_declining, dormant,
  active_every_month, activity_spike, unique_payees, repeat_payees,
  CAST(coalesce(io, 0) AS BIGINT) AS same_day_inout, CAST(coalesce(rd, 0) AS BIGINT) AS rapid_dup,
  emi_amt / statement_months AS monthly_emi, gst_amt / statement_months AS monthly_gst, rent_amt / statement_months AS monthly_rent,
  emi_amt / statement_months + rent_amt / statement_months + util_amt / statement_months AS fixed_burden,
  {div0('largest_credit', 'avg_monthly_inflow')} AS largest_credit_pct,
  {div0('top1', 'total_credit')} AS top1_share, {div0('top3', 'total_credit')} AS top3_share,
  {div0('top5', 'total_credit')} AS top5_share, {div0('top_supplier', 'total_debit')} AS top_supplier_share,
  {div0('coalesce(io, 0)', 'n_credits')} AS same_day_ratio, {div0('cash_in_amt', 'total_credit')} AS cash_deposit_ratio,
  {div0('total_debit', 'total_credit')} AS expense_ratio, n_txns / statement_months AS tx_per_month,
  {div0('salary_amt', 'total_credit')} AS salary_share
FROM x_score s JOIN x_counters k USING (account_id) LEFT JOIN x_shape USING (account_id) LEFT JOIN x_conc USING (account_id)
LEFT JOIN (SELECT account_id, count(*) AS io FROM x_inout GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, count(*) AS rd FROM x_rapid GROUP BY 1) USING (account_id)""",
)
block(
    "x_context",
    f"""
SELECT *, {div0('monthly_emi', 'avg_monthly_inflow')} AS emi_burden, {div0('monthly_rent', 'avg_monthly_inflow')} AS rent_burden,
  {div0('fixed_burden', 'avg_monthly_inflow')} AS fixed_burden_ratio, {div0('avg_monthly_inflow', 'fixed_burden')} AS coverage,
  salary_in_count >= greatest(2, n_months - 1) OR (salary_in_count >= 1 AND salary_share >= 0.55) AS is_salaried
FROM x_context0""",
)

# ------------------------------------------------------------------ rules


def _figure(name: str) -> str:
    """A value as the rule details print it."""
    rounded = lambda x, d: f"format('{{:,.{d}f}}', round_even(CAST({x} AS DOUBLE), {d}) + 0.0)"
    text = {
        "money": f"'₹' || {rounded(name, 2)}",
        "percent": f"{rounded(f'{name} * 100', 1)} || ' %'",
        "number": rounded(name, 2),
        "count": rounded(name, 0),
        "flag": f"CASE WHEN {name} THEN 'yes' ELSE 'no' END",
        "text": f"CAST({name} AS VARCHAR)",
    }[figures.FIGURES[name][1]]
    return f"coalesce({text}, 'unknown')" if figures.FIGURES[name][1] != "flag" else f"CASE WHEN {name} IS NULL THEN 'unknown' ELSE {text} END"


def detail_sql(rule) -> str:
    """CASE expression of a rule's detail text."""
    skip, own = figures.shown(rule)
    shown = lambda names: " || ', ' || ".join(f"'{figures.FIGURES[n][0]} ' || {_figure(n)}" for n in names)
    if not rule.computable:
        return f"'{figures.UNKNOWN_RULE}'"
    arms = ["WHEN is_salaried THEN 'Not applicable to a salaried account.'"] if rule.business else []
    if rule.skip != "-":
        arms.append(f"WHEN {rule.skip} THEN '{figures.SKIPPED}'" + (f" || ': ' || {shown(skip)}" if skip else "") + " || '.'")
    measured = f"'Measured ' || {shown(own)} || '.'" if own else "'Informative.'"
    if rule.fail != "no":
        text = figures.in_words(rule.fail).replace("'", "''")
        arms.append(f"WHEN {rule.fail} THEN {measured} || ' Fails where {text}.'")
        measured = f"{measured} || ' Within the limit.'"
    return f"CASE {' '.join(arms)} ELSE {measured} END" if arms else measured


def rules_sql(source: str, rules, key: str = "account_id") -> str:
    """Long table (key, rule_id, serious, gate, status, detail) from the catalogue conditions."""
    items = ",\n".join(
        f"{{'rule_id': '{r.id}', 'serious': {str(r.serious).lower()}, 'gate': {str(r.gate).lower()}, 'status': {r.status_sql()}, 'detail': {detail_sql(r)}}}"
        for r in rules
    )
    return f"SELECT {key}, unnest([{items}], recursive := true) FROM {source}"


def tally_sql(source: str, key: str = "account_id", family=()) -> str:
    fam = f"rule_id IN ({quoted(family)})" if family else "false"
    return f"""
SELECT {key}, CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (status = 'FAIL') AS BIGINT) AS failed,
  CAST(count(*) FILTER (status = 'SKIP') AS BIGINT) AS skipped,
  CAST(count(*) FILTER (status = 'FAIL' AND serious AND NOT {fam}) + least(1, count(*) FILTER (status = 'FAIL' AND serious AND {fam})) AS BIGINT) AS serious_fails,
  coalesce(bool_or(gate AND status <> 'PASS'), false) AS gate_failed
FROM {source} GROUP BY {key}"""


LADDER = """CASE WHEN gate_failed OR serious_fails >= 2 THEN 'REJECTED' WHEN serious_fails = 1 THEN 'CONDITIONAL APPROVAL'
  WHEN failed > 0 THEN 'APPROVED WITH NOTES' ELSE 'APPROVED' END"""

# ------------------------------------------------------------------ payments

_UPI = """
SELECT user_id AS account_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, {date} AS txn_date,
  CASE WHEN event_type IN ('signup', 'click') THEN 'CREDIT' ELSE 'DEBIT' END AS txn_type, value AS amount,
  CASE WHEN event_type IN ('signup', 'click') THEN 'p' || (k % 15) || '@upi' END AS payer_vpa,
  CASE WHEN event_type NOT IN ('signup', 'click') THEN 'm' || (k % 20) || '@upi' END AS payee_vpa,
  CASE WHEN k % 2 = 0 THEN 'P2M' ELSE 'P2P' END AS mode,
  CASE WHEN k % 2 = 0 THEN [{cycle}][(k // 2) % 6 + 1] END AS mcc,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
block("x_upi", _UPI.format(date="CAST(ts AS DATE)", cycle=quoted(adapters.MCC_CYCLE)))
block(
    "x_upi6",
    _UPI.format(
        date="CAST(CAST(ts AS DATE) + to_months(CAST(event_id % 6 AS INTEGER)) AS DATE)", cycle=quoted(adapters.MCC_CYCLE)
    ),
)
block(
    "x_upi_base",
    f"""
SELECT account_id, true AS available, count(DISTINCT strftime(txn_date, '%Y-%m')) AS span_months, count(*) AS total_transactions,
  CAST(count(*) FILTER (mode = 'P2P') AS BIGINT) AS p2p_count, CAST(count(*) FILTER (mode = 'P2M') AS BIGINT) AS p2m_count,
  count(*) FILTER (status = 'SUCCESS') AS ok, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS failed_count,
  count(DISTINCT payee_vpa) FILTER (txn_type = 'DEBIT') AS unique_payees,
  count(DISTINCT payer_vpa) FILTER (txn_type = 'CREDIT') AS unique_payers,
  datediff('day', min(txn_date), max(txn_date)) + 1 AS days, round_even(sum(amount), 2) AS amt,
  coalesce(sum(amount) FILTER (mode = 'P2M' AND txn_type = 'DEBIT'), 0.0) AS merchant,
  coalesce(sum(amount) FILTER (mode = 'P2M' AND txn_type = 'DEBIT' AND isodow(txn_date) >= 6), 0.0) AS weekend,
  coalesce(sum(amount) FILTER (mode = 'P2M' AND txn_type = 'DEBIT' AND mcc IN ({quoted(fixed.HIGH_RISK_MCC)})), 0.0) AS risky,
  round_even(coalesce(sum(amount) FILTER (mode = 'P2P' AND txn_type = 'DEBIT'), 0.0), 2) AS lent,
  round_even(coalesce(sum(amount) FILTER (mode = 'P2P' AND txn_type = 'CREDIT'), 0.0), 2) AS borrowed
FROM x_upi6 GROUP BY account_id""",
)
block(
    "x_upi_peak",
    """
SELECT account_id, max(x) AS peak, avg(x) AS day_mean FROM (SELECT account_id, txn_date, count(*) AS x FROM x_upi6 GROUP BY ALL)
GROUP BY account_id""",
)
block(
    "x_upi_recurring",
    """
SELECT account_id, count(*) AS r FROM (SELECT account_id, payee_vpa FROM x_upi6 WHERE txn_type = 'DEBIT'
  GROUP BY ALL HAVING count(DISTINCT strftime(txn_date, '%Y-%m')) >= 2) GROUP BY account_id""",
)
block(
    "x_upi_analysis",
    f"""
SELECT account_id, available, span_months, total_transactions, p2p_count, p2m_count,
  round_even(p2p_count / total_transactions, 4) AS p2p_ratio, round_even(p2m_count / total_transactions, 4) AS p2m_ratio,
  round_even(ok / total_transactions, 4) AS success_ratio, round_even(failed_count / total_transactions, 4) AS failed_ratio,
  failed_count, unique_payees, unique_payers, CAST(coalesce(r, 0) AS BIGINT) AS recurring_payee_count,
  round_even(total_transactions / days, 3) AS daily_avg_transactions, peak AS peak_day_transaction_count,
  round_even({div0('weekend', 'merchant')} * 100, 1) AS weekend_spend_pct, round_even(amt / total_transactions, 2) AS avg_ticket_size,
  round_even({div0('risky', 'merchant')} * 100, 1) AS high_risk_mcc_spend_pct,
  round_even(lent / span_months, 2) AS p2p_debit_velocity, round_even(borrowed / span_months, 2) AS p2p_credit_velocity
FROM x_upi_base JOIN x_upi_peak USING (account_id) LEFT JOIN x_upi_recurring USING (account_id)""",
)
block(
    "x_pass",
    """
SELECT account_id, seq FROM x_upi6 c WHERE txn_type = 'CREDIT' AND amount > 0
 AND EXISTS (SELECT 1 FROM x_upi6 d WHERE d.account_id = c.account_id AND d.txn_type = 'DEBIT'
   AND d.txn_date BETWEEN c.txn_date AND c.txn_date + 2 AND (d.txn_date > c.txn_date OR d.seq > c.seq)
   AND abs(d.amount - c.amount) / c.amount < 0.15)""",
)
block(
    "x_upi_metrics",
    """
SELECT account_id, CAST(coalesce(rapid, 0) AS DOUBLE) AS rapid_pass_through_count,
  round_even(risky / CASE WHEN merchant <> 0 THEN merchant ELSE 1 END * 100, 1) AS high_risk_mcc_spend_pct,
  CAST(structuring AS DOUBLE) AS structuring_count,
  round_even(coalesce(top, 0) / CASE WHEN lent <> 0 THEN lent ELSE 1 END * 100, 1) AS single_counterparty_dominance_pct,
  round_even(peak / day_mean, 2) AS sudden_spike_ratio, round_even(failed_count / total_transactions, 4) AS failed_ratio,
  round_even(round_n / total_transactions, 4) AS round_amount_ratio
FROM x_upi_base JOIN x_upi_peak USING (account_id)
JOIN (SELECT account_id, count(*) FILTER (amount <> 0 AND amount % 500 = 0) AS round_n,
   count(*) FILTER (mode = 'P2P' AND txn_type = 'DEBIT' AND (amount >= 1800 AND amount < 2000 OR amount >= 9000 AND amount < 10000
      OR amount >= 45000 AND amount < 50000)) AS structuring FROM x_upi6 GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, max(x) AS top FROM (SELECT account_id, payee_vpa, sum(amount) AS x FROM x_upi6
   WHERE mode = 'P2P' AND txn_type = 'DEBIT' GROUP BY ALL) GROUP BY 1) USING (account_id)
LEFT JOIN (SELECT account_id, count(*) AS rapid FROM x_pass GROUP BY 1) USING (account_id)""",
)

# ------------------------------------------------------------------ utility bills

block(
    "x_bills",
    f"SELECT *, strftime(txn_date, '%Y-%m') AS month FROM (SELECT *, {utility()} AS utility_type FROM x_bank WHERE txn_type = 'DEBIT' AND amount IS NOT NULL) WHERE utility_type IS NOT NULL",
)
block(
    "x_bill_types",
    """
SELECT account_id, utility_type, payment_count, months_paid,
  CAST(greatest(0, (CASE WHEN months_paid >= 2 THEN span ELSE months_paid END) - months_paid) AS BIGINT) AS missed_months,
  round_even(paid / payment_count, 2) AS average_bill_amount, round_even(paid, 2) AS total_paid, months_paid >= 2 AS recurring,
  CAST(CASE WHEN months_paid >= 2 THEN span ELSE months_paid END AS BIGINT) AS expected_months, span AS span_months, paid
FROM (SELECT account_id, utility_type, count(*) AS payment_count, count(DISTINCT month) AS months_paid, round_even(sum(amount), 2) AS paid
   FROM x_bills GROUP BY ALL)
JOIN (SELECT account_id, count(DISTINCT strftime(txn_date, '%Y-%m')) AS span FROM x_bank GROUP BY 1) USING (account_id)""",
)
_KINDS = [*fixed.UTILITY_PATTERNS, "OTHER_BBPS"]
block(
    "x_bill_analysis",
    f"""
SELECT *, round_even(greatest(0.0, least(100.0, on_time_payment_ratio * 100 - greatest(0, missed_payment_count - 1) * 5)), 1) AS punctuality_index
FROM (SELECT account_id, true AS available, max(span_months) AS span_months, count(*) AS utility_accounts,
  CAST(sum(payment_count) AS BIGINT) AS payments_last_12m,
  CASE WHEN sum(expected_months) <> 0 THEN round_even(sum(months_paid) / sum(expected_months), 4) ELSE 1.0 END AS on_time_payment_ratio,
  CAST(sum(missed_months) AS BIGINT) AS missed_payment_count, round_even(round_even(sum(paid), 2) / sum(payment_count), 2) AS average_bill_amount,
  CAST(count(*) FILTER (recurring) AS BIGINT) AS recurring_types,
  {', '.join(f"bool_or(utility_type = '{k}') AS has_{k.lower()}" for k in _KINDS)}
FROM x_bill_types GROUP BY account_id)""",
)
block(
    "x_bill_repeats",
    """
SELECT account_id, sum(n - 1) AS dup, sum(near) AS rapid FROM
 (SELECT account_id, utility_type, a, count(*) AS n, count(*) FILTER (datediff('day', prev, txn_date) < 5) AS near FROM
   (SELECT *, lag(txn_date) OVER (PARTITION BY account_id, utility_type, a ORDER BY txn_date, seq) AS prev
    FROM (SELECT *, round_even(amount, 0) AS a FROM x_bills)) GROUP BY ALL) GROUP BY account_id""",
)
block(
    "x_bill_metrics",
    """
SELECT account_id, CAST(coalesce(dup, 0) AS DOUBLE) AS duplicate_payment_count, CAST(coalesce(rapid, 0) AS DOUBLE) AS rapid_repeat_count,
  round_even(coalesce(spike, 0), 2) AS bill_spike_ratio, round_even(coalesce(best / nullif(total, 0), 0) * 100, 1) AS single_utility_dominance_pct,
  round_even(round_n / n, 3) AS round_amount_ratio, round_even(other_n / n, 3) AS vague_narration_ratio,
  CAST(missed_payment_count AS DOUBLE) AS missed_payment_count
FROM (SELECT b.account_id, count(*) AS n, count(*) FILTER (amount > 0 AND amount % 500 = 0) AS round_n,
    count(*) FILTER (b.utility_type = 'OTHER_BBPS') AS other_n, max(amount / nullif(average_bill_amount, 0)) AS spike
  FROM x_bills b JOIN x_bill_types t ON t.account_id = b.account_id AND t.utility_type = b.utility_type GROUP BY 1)
JOIN (SELECT account_id, sum(total_paid) AS total, max(total_paid) AS best FROM x_bill_types GROUP BY 1) USING (account_id)
JOIN x_bill_analysis USING (account_id) LEFT JOIN x_bill_repeats USING (account_id)""",
)

# ------------------------------------------------------------------ tax returns

block(
    "x_gst_lines",
    """
SELECT 'GST' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS gstin, strftime(l_shipdate, '%Y-%m') AS period,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS ms, l_extendedprice * (1 - l_discount) AS net, l_tax, l_discount, l_returnflag, l_partkey,
  o_custkey, c_mktsegment <> 'HOUSEHOLD' AS b2b, c_nationkey <> s_nationkey AND l_returnflag = 'A' AS export
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey""",
)
block(
    "x_gst_period",
    """
SELECT gstin, period, min(ms) AS ms, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS kept, round_even(sum(net), 4) AS taxable,
  round_even(coalesce(sum(net) FILTER (b2b), 0.0), 4) AS b2b, round_even(coalesce(sum(net) FILTER (NOT b2b), 0.0), 4) AS b2c, round_even(coalesce(sum(net) FILTER (export), 0.0), 4) AS export,
  CAST(count(*) FILTER (b2b) AS DOUBLE) AS b2b_n, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS buyers,
  round_even(coalesce(sum(net) FILTER (l_returnflag <> 'R'), 0.0), 4) AS outward, round_even(sum(net * l_tax), 4) AS igst,
  round_even(sum(net * l_tax * l_discount * 10), 4) AS itc, round_even(coalesce(sum(net * l_tax * l_discount * 10) FILTER (l_returnflag = 'R'), 0.0), 4) AS itc_rev,
  round_even(sum(net * l_tax * 0.5), 4) AS itc_avail, count(DISTINCT l_partkey) AS parts,
  CAST(min(ms) + to_months(1) AS DATE) + 19 AS due
FROM x_gst_lines GROUP BY gstin, period""",
)
block(
    "x_gst_top",
    "SELECT gstin, period, round_even(max(x), 4) AS top FROM (SELECT gstin, period, o_custkey, sum(net) AS x FROM x_gst_lines GROUP BY ALL) GROUP BY ALL",
)
block(
    "x_gst_p",
    """
SELECT p.*, top, CASE WHEN kept > 0 THEN n % 7 - 3 END AS days_late,
  CASE WHEN kept > 0 AND outward > 0 THEN outward ELSE taxable END AS turnover
FROM x_gst_period p JOIN x_gst_top USING (gstin, period)""",
)
block(
    "x_gst_series",
    """
SELECT *, lag(turnover, 1) OVER w AS l1, lag(turnover, 3) OVER w AS l3, lag(turnover, 12) OVER w AS l12,
  row_number() OVER (PARTITION BY gstin ORDER BY period DESC) AS k, count(*) OVER (PARTITION BY gstin) AS m
FROM x_gst_p WHERE turnover > 0 WINDOW w AS (PARTITION BY gstin ORDER BY period)""",
)
block(
    "x_gst_shape",
    """
SELECT gstin, max(turnover) FILTER (k = 1) AS monthly, sum(turnover) FILTER (k <= 3) AS quarterly,
  CASE WHEN count(*) >= 12 THEN sum(turnover) FILTER (k <= 12) ELSE avg(turnover) * 12 END AS annualised,
  round_even(coalesce(max((turnover - l1) / l1 * 100) FILTER (k = 1), 0.0), 4) AS mom,
  round_even(coalesce(max((turnover - l3) / l3 * 100) FILTER (k = 1), 0.0), 4) AS qoq,
  round_even(coalesce(max((turnover - l12) / l12 * 100) FILTER (k = 1), 0.0), 4) AS yoy,
  CAST(least(4, min(k) FILTER (l1 IS NULL OR turnover >= l1) - 1) AS BIGINT) AS declining
FROM x_gst_series GROUP BY gstin""",
)
block(
    "x_gst_profile",
    """
SELECT gstin, 'ACTIVE' AS gst_status, CASE WHEN late > 0 AND ontime = 0 THEN 'LATE' ELSE 'FILED' END AS return_status,
  round_even(coalesce(delay, 0.0), 1) AS filing_delay_days, round_even(g1_sales, 2) AS gstr1_sales_value,
  round_even(igst, 2) AS gstr3b_net_tax_liability, round_even(b2b, 2) AS b2b_sales_amount, round_even(b2c, 2) AS b2c_sales_amount,
  round_even(100 * b2b / (b2b + b2c), 2) AS b2b_sales_percentage, round_even(export, 2) AS export_sales_amount,
  round_even(itc_avail, 2) AS itc_available_amount, round_even(itc, 2) AS itc_claimed_amount, round_even(itc_rev, 2) AS itc_reversed_amount,
  round_even(greatest(0.0, itc - itc_rev), 2) AS net_itc_amount, CAST(buyers AS BIGINT) AS unique_buyer_count,
  CAST(b2b_n AS BIGINT) AS unique_b2b_buyer_count, top_pct AS top_buyer_sales_percentage,
  CASE WHEN top_pct >= 45 THEN 'HIGH' WHEN top_pct >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS buyer_concentration_level,
  round_even(monthly, 2) AS monthly_turnover, round_even(quarterly, 2) AS quarterly_turnover,
  mom AS turnover_growth_mom, qoq AS turnover_growth_qoq, yoy AS turnover_growth_yoy,
  round_even(abs(least(0.0, yoy)), 2) AS turnover_decline_percentage, declining AS consecutive_declining_quarters,
  CASE WHEN filed > 0 THEN round_even(100 * ontime / filed, 2) ELSE 50.0 END AS filing_regularity_percentage,
  CAST(greatest(0, n_periods - filed) AS BIGINT) AS missed_return_count, CAST(late AS BIGINT) AS late_return_count,
  mismatch AS gstr1_vs_gstr3b_mismatch_pct,
  round_even(datediff('day', CAST(first_period || '-01' AS DATE), DATE '2002-01-01') / 365.25, 2) AS business_vintage_years,
  round_even(annualised, 2) AS annualised_gst_turnover, round_even(annualised / 2.0, 2) AS proposed_loan_amount,
  CAST(2.0 AS DOUBLE) AS gst_turnover_to_loan_ratio, round_even(annualised * 0.40, 2) AS maximum_loan_by_gst_rule, CAST(1.0 AS DOUBLE) AS gst_data_completeness_score,
  n_periods AS periods_covered, parts AS suppliers
FROM (SELECT gstin, count(*) AS n_periods, min(period) AS first_period, count(*) FILTER (kept > 0) AS filed,
    count(*) FILTER (days_late > 0) AS late, count(*) FILTER (days_late <= 0) AS ontime, avg(greatest(0, days_late)) FILTER (days_late IS NOT NULL) AS delay,
    avg(taxable) AS g1_sales, avg(b2b) AS b2b, avg(b2c) AS b2c, avg(export) AS export,
    arg_max(igst, period) FILTER (kept > 0) AS igst, arg_max(itc, period) FILTER (kept > 0) AS itc, arg_max(itc_rev, period) FILTER (kept > 0) AS itc_rev,
    arg_max(itc_avail, period) AS itc_avail, arg_max(buyers, period) AS buyers, arg_max(b2b_n, period) AS b2b_n, arg_max(top, period) AS top,
    arg_max(parts, period) AS parts,
    round_even(coalesce(avg(abs(taxable - outward) / outward * 100) FILTER (kept > 0 AND outward > 0), 0.0), 2) AS mismatch
  FROM x_gst_p GROUP BY gstin)
JOIN x_gst_shape USING (gstin)
JOIN (SELECT gstin, least(95.0, greatest(0.0, round_even(100 * arg_max(top, period) / max(monthly), 2))) AS top_pct
      FROM x_gst_p JOIN x_gst_shape USING (gstin) GROUP BY gstin) USING (gstin)""",
)
block(
    "x_gst_metrics",
    f"""
SELECT gstin, gstr1_vs_gstr3b_mismatch_pct, CAST(missed_return_count AS DOUBLE) AS missed_return_count,
  CAST(late_return_count AS DOUBLE) AS late_return_count, {div0('itc_claimed_amount', 'itc_available_amount')} AS itc_claim_ratio,
  turnover_decline_percentage, CAST(consecutive_declining_quarters AS DOUBLE) AS consecutive_declining_quarters,
  turnover_growth_yoy, top_buyer_sales_percentage
FROM x_gst_profile""",
)
block(
    "x_gst_heads",
    """
SELECT *, CASE WHEN head_score >= 75 THEN 'LOW' WHEN head_score >= 55 THEN 'MEDIUM' ELSE 'HIGH' END AS head_risk,
  maximum_loan_by_gst_rule AS head_loan, filing_regularity_percentage AS head_filing
FROM (SELECT *, 100.0 - CASE WHEN gst_status <> 'ACTIVE' THEN 40.0 ELSE 0.0 END - CASE WHEN filing_regularity_percentage < 80 THEN 20.0 ELSE 0.0 END
   - CASE WHEN missed_return_count > 0 THEN 20.0 ELSE 0.0 END - CASE WHEN turnover_decline_percentage > 25 THEN 20.0 ELSE 0.0 END AS head_score
  FROM x_gst_profile)""",
)

# ------------------------------------------------------------------ cleaning and session features


def _mentions(words) -> str:
    return "(" + " OR ".join(f"contains(lower(narration), '{w}')" for w in words) + ")"


block(
    "x_recover",
    f"""
SELECT *, amount > 0 AS usable_raw, coalesce(amount > 0, false) AS usable,
  round_even(balance - prev_balance, 2) AS delta,
  TRY_CAST(replace(regexp_extract(narration, '{fixed.NARRATION_AMOUNT}', 1), ',', '') AS DOUBLE) AS narr,
  coalesce(txn_type, CASE WHEN {_mentions(fixed.DEBIT_HINTS)} THEN 'DEBIT' WHEN {_mentions(fixed.CREDIT_HINTS)} THEN 'CREDIT' END) AS kind
FROM x_anchored""",
)
block(
    "x_clean",
    """
SELECT account_id, seq, txn_date, narration,
  CASE WHEN usable THEN 'kept' WHEN by_delta OR by_text THEN 'recovered' ELSE 'dropped' END AS status,
  CASE WHEN by_delta THEN 'balance change' WHEN by_text THEN 'narration' END AS method,
  CASE WHEN usable OR by_delta OR by_text THEN NULL WHEN balance IS NOT NULL
    THEN 'no amount; balance shows no change; no amount in narration'
    ELSE 'no amount; no balance to infer a delta; no amount in narration' END AS reason,
  (usable OR by_delta OR by_text) AND balance IS NULL AND prev_balance IS NOT NULL AS imputed,
  CASE WHEN usable THEN amount WHEN by_delta THEN abs(delta) WHEN by_text THEN narr END AS amount,
  CASE WHEN by_delta THEN coalesce(txn_type, CASE WHEN delta > 0 THEN 'CREDIT' ELSE 'DEBIT' END)
       WHEN by_text THEN kind ELSE txn_type END AS txn_type,
  coalesce(balance, prev_balance) AS balance
FROM (SELECT *, NOT usable AND NOT by_delta AND coalesce(narr > 0, false) AND kind IS NOT NULL AS by_text
      FROM (SELECT * , NOT usable AND coalesce(delta <> 0, false) AS by_delta FROM x_recover))""",
)
block("x_cleaned", "SELECT * FROM x_clean WHERE status <> 'dropped'")
block(
    "x_chunks",
    """
SELECT * FROM (SELECT *, CASE WHEN n < 6 THEN 0 ELSE pos // greatest(3, n // 5) END AS chunk,
   CASE WHEN n < 6 THEN n ELSE least(greatest(3, n // 5), n - pos // greatest(3, n // 5) * greatest(3, n // 5)) END AS len
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY account_id) AS n FROM x_cleaned))
WHERE n < 6 OR len >= 3""",
)


def features_sql(source: str, keys: str) -> str:
    base = f"""
SELECT {keys}, count(*) AS n, count(amount) AS n_amt, count(balance) AS n_bal, avg(balance) AS bal_avg, stddev_pop(balance) AS bal_sd,
  round_even(coalesce(sum(amount) FILTER (txn_type = 'DEBIT'), 0.0), 2) AS td, round_even(coalesce(sum(amount) FILTER (txn_type = 'CREDIT'), 0.0), 2) AS tc,
  median(amount) AS med FROM {source} GROUP BY {keys}"""
    drops = f"""
SELECT {keys}, coalesce(max(pb - balance) FILTER (pb > balance), 0.0) AS max_drop FROM
 (SELECT {keys}, balance, lag(balance) OVER (PARTITION BY {keys} ORDER BY seq) AS pb FROM {source} WHERE balance IS NOT NULL) GROUP BY {keys}"""
    large = f"SELECT {keys}, count(*) FILTER (amount > 2 * med) AS n_large FROM {source} JOIN b USING ({keys}) GROUP BY {keys}"
    return f"""
SELECT {keys}, greatest(coalesce(bal_avg, 50000.0), 1.0) AS avg_daily_balance, round_even(least(vol, 5.0), 4) AS balance_volatility,
  round_even(least(tc1 / greatest(td1, 1.0), 10.0), 4) AS credit_debit_ratio, tc1 / 3.0 AS monthly_credit, td1 / 3.0 AS monthly_debit,
  round_even(n / 90.0, 4) AS tx_velocity,
  round_even(least(CASE WHEN n_bal >= 2 THEN max_drop / greatest(coalesce(bal_avg, 50000.0), 1.0) ELSE 0.0 END, 1.0), 4) AS max_drawdown_pct,
  round_even(large, 4) AS large_tx_pct, round_even(least(1.0, vol * 0.5 + large * 0.5), 4) AS irregular_gap_score
FROM (WITH b AS ({base}), d AS ({drops}), l AS ({large})
  SELECT *, CASE WHEN td = 0 THEN 1.0 ELSE td END AS td1, CASE WHEN tc = 0 THEN 1.0 ELSE tc END AS tc1,
   CASE WHEN n_bal >= 2 THEN bal_sd / CASE WHEN bal_avg = 0 THEN 1.0 ELSE bal_avg END ELSE 0.2 END AS vol,
   CASE WHEN n_amt > 0 THEN n_large / n_amt ELSE 0.1 END AS large
  FROM b LEFT JOIN d USING ({keys}) LEFT JOIN l USING ({keys}))"""


def engineered_sql(source: str) -> str:
    return f"""
SELECT *, round_even(greatest(-1.0, least(1.0, (monthly_credit - monthly_debit) / greatest(monthly_credit, 1.0))), 4) AS net_flow_ratio,
  round_even(least(180.0, avg_daily_balance / greatest(monthly_debit / 30.0, 1.0)), 1) AS liquidity_runway_days FROM {source}"""


def minmax_sql(name: str) -> str:
    lo, hi = fixed.FEATURE_BOUNDS[name]
    return f"greatest(0.0, least(1.0, ({name} - {lo}) / CAST({hi} - {lo} AS DOUBLE)))"


block("x_feat", features_sql("x_cleaned", "account_id"))
block("x_feat_eng", engineered_sql("x_feat"))
block("x_chunk_feat0", features_sql("x_chunks", "account_id, chunk"))
block("x_chunk_feat", engineered_sql("x_chunk_feat0"))
block(
    "x_ranking",
    "SELECT row_number() OVER (ORDER BY variance DESC, ord) AS rank, feature, round_even(variance, 5) AS variance FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, '{n}' AS feature, var_pop({minmax_sql(n)}) AS variance FROM x_chunk_feat"
        for i, n in enumerate(fixed.FEATURE_BOUNDS)
    )
    + ")",
)


def unpivot_sql(source: str, names, cols, keys: str = "account_id") -> str:
    """One SELECT per name; `cols` maps an output column to a function of the name."""
    return " UNION ALL ".join(
        f"SELECT {keys}, '{n}' AS feature, " + ", ".join(f"{f(n)} AS {c}" for c, f in cols.items()) + f" FROM {source}"
        for n in names
    )


NORMAL_COLS = {
    "raw": lambda n: f"round_even({n}, 4)",
    "minmax": lambda n: f"round_even({minmax_sql(n)}, 4)",
    "zscore": lambda n: f"round_even(({n} - {fixed.FEATURE_REFERENCE[n][0]}) / CAST({fixed.FEATURE_REFERENCE[n][1]} AS DOUBLE), 4)",
}

# ------------------------------------------------------------------ anomalies and analytics


def anomaly_sql(source: str, keys: str) -> str:
    """Flagged rows of a ledger-shaped source; fences and counts are taken per `keys`."""
    return f"""
WITH r AS (SELECT * FROM {source} WHERE amount > 0 AND NOT regexp_matches(narration, '{fixed.HEADER_JUNK}')),
n AS (SELECT {keys}, count(*) AS kept FROM r GROUP BY {keys} HAVING count(*) >= 8),
c AS (SELECT {keys}, txn_type, quantile_cont(amount, 0.95) AS cut, count(*) AS m FROM r GROUP BY {keys}, txn_type),
f AS (SELECT {keys}, txn_type, greatest(50000.0, 4.0 * quantile_cont(amount, 0.9)) AS fence
      FROM r JOIN c USING ({keys}, txn_type) WHERE m >= 4 AND amount <= cut GROUP BY {keys}, txn_type),
s AS (SELECT {keys}, sig, count(*) AS sig_n, min(amount) AS lo, max(amount) AS hi FROM r WHERE sig <> '' GROUP BY {keys}, sig),
x AS (SELECT r.*, fence, coalesce(amount > fence, false) AND NOT coalesce(sig_n >= 3 OR (sig_n = 2 AND hi - lo <= 0.15 * greatest(amount, 1)), false) AS unusual
      FROM r JOIN n USING ({keys}) LEFT JOIN f USING ({keys}, txn_type) LEFT JOIN s USING ({keys}, sig))
SELECT {keys}, seq, txn_date, narration, amount, round_even(raw, 1) AS score, CASE WHEN raw >= 72 THEN 'HIGH' ELSE 'MEDIUM' END AS level,
  array_to_string(list_filter([CASE WHEN is_bounce THEN 'return or bounce' END, CASE WHEN running < 0 THEN 'balance went negative' END,
    CASE WHEN unusual THEN lower(txn_type) || ' far outside the usual range' END], lambda z: z IS NOT NULL), '; ') AS reasons
FROM (SELECT *, least(99.0, greatest(CASE WHEN is_bounce THEN 80.0 ELSE 0.0 END, CASE WHEN running < 0 THEN 82.0 ELSE 0.0 END,
   CASE WHEN unusual THEN least(88.0, 48.0 + 22.0 * log10(amount / fence + 1.0)) ELSE 0.0 END)) AS raw FROM x)
WHERE raw >= 55"""


block("x_anomalies", anomaly_sql("x_ledger", "account_id"))
block(
    "x_month_run",
    f"""
SELECT a.account_id, seq, txn_date, narration, txn_type, amount, balance, bucket, {tags()}, {sig()} AS sig,
  coalesce(fb, opening_balance) + sum(CASE WHEN balance IS NOT NULL THEN 0.0 WHEN txn_type = 'CREDIT' THEN coalesce(amount, 0) ELSE -coalesce(amount, 0) END)
    OVER (PARTITION BY a.account_id, bucket, g2 ORDER BY seq) AS running
FROM (SELECT *, count(balance) OVER w AS g2, last_value(balance IGNORE NULLS) OVER w AS fb
      FROM (SELECT *, strftime(txn_date, '%Y-%m') AS bucket FROM x_bank) WINDOW w AS (PARTITION BY account_id, bucket ORDER BY seq)) a
JOIN x_account USING (account_id)""",
)
block("x_month_flags", anomaly_sql("x_month_run", "account_id, bucket"))
block(
    "x_month_view",
    """
SELECT account_id, bucket, strftime(min(txn_date), '%b %Y') AS label, count(*) AS volume, day(last_day(min(txn_date))) AS days,
  round_even(round_even(coalesce(sum(amount) FILTER (txn_type = 'CREDIT'), 0.0), 2), 0) AS inflow, round_even(round_even(coalesce(sum(amount) FILTER (txn_type = 'DEBIT'), 0.0), 2), 0) AS outflow,
  round_even(sum(running), 2) / count(running) AS ba, stddev_pop(running) AS bs, min(running) AS bmin, max(running) AS bmax, arg_max(running, seq) AS bl,
  CAST(count(*) FILTER (is_bounce) AS BIGINT) AS bounces,
  CAST(count(*) - count(DISTINCT (lower(trim(narration)), coalesce(amount, -1))) AS BIGINT) AS duplicates
FROM x_month_run GROUP BY ALL""",
)
block(
    "x_month_analytics",
    """
SELECT account_id, bucket, label, inflow, outflow, inflow - outflow AS net,
  CASE WHEN outflow <> 0 THEN round_even(inflow / outflow, 2) WHEN inflow <> 0 THEN 9.99 ELSE 0.0 END AS dscr,
  CASE WHEN outflow <> 0 THEN round_even(bl / outflow, 1) ELSE 0.0 END AS runway_months,
  CASE WHEN inflow - outflow > inflow * 0.3 THEN 'Strong' WHEN inflow - outflow >= 0 THEN 'Healthy' ELSE 'Tight' END AS cash_label,
  volume, round_even(volume / days, 2) AS per_day, duplicates, CAST(coalesce(flagged, 0) AS BIGINT) AS flagged,
  round_even(100 * coalesce(flagged, 0) / volume, 0) AS anomaly_index,
  CASE WHEN round_even(100 * coalesce(flagged, 0) / volume, 0) > 10 THEN 'Review' WHEN coalesce(flagged, 0) > 0 THEN 'Watch' ELSE 'Clean' END AS fraud_label,
  round_even(ba, 0) AS adb, round_even(bmin, 0) AS min_bal, round_even(bmax, 0) AS peak_bal,
  CASE WHEN ba <> 0 THEN round_even(bs / ba, 3) ELSE 0.0 END AS volatility_index, bounces,
  CASE WHEN CASE WHEN ba <> 0 THEN round_even(bs / ba, 3) ELSE 0.0 END < 0.15 THEN 'Very Stable'
       WHEN CASE WHEN ba <> 0 THEN round_even(bs / ba, 3) ELSE 0.0 END < 0.35 THEN 'Stable' ELSE 'Volatile' END AS balance_label
FROM x_month_view LEFT JOIN (SELECT account_id, bucket, least(12, count(*)) AS flagged FROM x_month_flags GROUP BY ALL) USING (account_id, bucket)""",
)
block(
    "x_traj_run",
    f"""
SELECT a.account_id, seq, txn_date, txn_type, amount, balance, strftime(txn_date, '%Y-%m') AS bucket, {tags()},
  coalesce(fill_balance, o) + sum(CASE WHEN balance IS NOT NULL THEN 0.0 WHEN txn_type = 'CREDIT' THEN coalesce(amount, 0) ELSE -coalesce(amount, 0) END)
    OVER (PARTITION BY a.account_id, g ORDER BY seq) AS running
FROM x_anchored a JOIN (SELECT account_id, arg_min(balance, seq) FILTER (balance IS NOT NULL) AS o FROM x_bank GROUP BY 1) USING (account_id)""",
)
block(
    "x_traj_totals",
    """
SELECT b.account_id, b.bucket, count(*) AS n, count(t.txn_date) AS dated, min(t.txn_date) AS d0, max(t.txn_date) AS d1,
  round_even(coalesce(sum(amount) FILTER (txn_type = 'CREDIT'), 0.0), 2) AS tc, round_even(coalesce(sum(amount) FILTER (txn_type = 'DEBIT'), 0.0), 2) AS td,
  CAST(count(*) FILTER (is_bounce) AS BIGINT) AS bounces, coalesce(sum(amount) FILTER (txn_type = 'DEBIT' AND is_cash), 0.0) AS cash_out,
  CASE WHEN count(balance) > 0 THEN count(running) ELSE 0 END AS rn, CASE WHEN count(balance) > 0 THEN avg(running) END AS r_avg,
  CASE WHEN count(balance) > 0 THEN stddev_pop(running) END AS r_sd, CASE WHEN count(balance) > 0 THEN min(running) END AS r_min
FROM (SELECT DISTINCT account_id, bucket FROM x_traj_run) b JOIN x_traj_run t ON t.account_id = b.account_id AND t.bucket <= b.bucket
GROUP BY b.account_id, b.bucket""",
)
block(
    "x_traj_stab",
    """
SELECT b.account_id, b.bucket, CASE WHEN count(*) < 2 THEN 0.6 ELSE greatest(0.0, 1.0 - stddev_pop(credit) / avg(credit)) END AS stability
FROM (SELECT DISTINCT account_id, bucket FROM x_traj_run) b JOIN x_months m ON m.account_id = b.account_id AND m.month <= b.bucket
WHERE credit > 0 GROUP BY ALL""",
)
block("x_traj_in", "SELECT * FROM x_traj_totals LEFT JOIN x_traj_stab USING (account_id, bucket)")
block("x_traj_vec", vector_sql("x_traj_in", "account_id, bucket"))
block("x_traj_score", scored_sql("x_traj_vec"))

# ------------------------------------------------------------------ patterns and monitoring


def long_sql(source: str, names, key: str = "account_id") -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {source}" for n in names)


def declared_sql(domain: str) -> str:
    rows = ", ".join(
        f"({i}, '{m}', '{lab.replace(chr(39), chr(39) * 2)}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
        for i, (m, (lab, a, b)) in enumerate(fixed.PATTERN_METRICS[domain].items())
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(ord, metric, label, f_med, f_mad)"


def profile_sql(long: str, min_samples: int, tails, digits: int) -> str:
    extra = ", ".join(f"round_even(quantile_cont(value, {p}), {digits}) AS {n}" for n, p in tails.items())
    return f"""
SELECT metric, count(value) AS n, round_even(any_value(med), {digits}) AS median,
  round_even(coalesce(nullif(median(abs(value - med)), 0), nullif(stddev_pop(value), 0), 1.0), {digits}) AS mad, {extra}
FROM {long} JOIN (SELECT metric, median(value) AS med FROM {long} GROUP BY 1) USING (metric)
WHERE value IS NOT NULL GROUP BY metric HAVING count(value) >= {min_samples}"""


def compare_sql(domain: str, key: str = "account_id") -> str:
    return f"""
SELECT {key}, metric, value, label, ord, round_even(med, 4) AS baseline, z,
  CASE WHEN z >= 3.5 THEN 'extreme' WHEN z >= 2.0 THEN 'elevated' ELSE 'within' END AS band, basis
FROM (SELECT *, round_even(0.6745 * abs(value - med) / mad2, 2) AS z FROM
  (SELECT l.*, label, ord, coalesce(median, f_med) AS med, greatest(coalesce(mad, f_mad), 1e-9) AS mad2,
     CASE WHEN median IS NOT NULL THEN 'training' ELSE 'typical' END AS basis
   FROM x_long_{domain} l JOIN x_decl_{domain} d USING (metric) LEFT JOIN x_prof_{domain} p USING (metric)))"""


# Signatures of the twins, written apart from the implementation: (name, hard, match, elevated, figure shown, unit).
SIGNATURES = {
    "aa": [
        ("Money in, then straight back out", True, "same_day_inout >= 1", "same_day_ratio > 0.15", "same_day_inout", "time(s)"),
        ("Money moving in circles", True, "same_day_ratio > 0.30", "same_day_ratio > 0.15", "100 * same_day_ratio", "% of deposits left"),
        ("One oversized deposit", True, "largest_credit_pct > 2", "largest_credit_pct > 1", "largest_credit_pct", "x one month's income"),
        ("Cash kept just under ₹50,000", False, "structuring_credits >= 3", "structuring_credits >= 1", "structuring_credits", "cash deposit(s)"),
        ("Same payment repeated fast", False, "rapid_dup >= 3", "rapid_dup >= 2", "rapid_dup", "repeated payment(s)"),
        ("Many payments reversed", False, "reversal_count > 5", "reversal_count > 3", "reversal_count", "reversed payment(s)"),
        ("Too many round-number deposits", False, "round_credits >= 4", "round_credits >= 2", "round_credits", "round deposit(s)"),
    ],
    "upi": [
        ("Money received then moved straight out", True, "rapid_pass_through_count >= 3", "rapid_pass_through_count >= 1", "rapid_pass_through_count", "event(s)"),
        ("Transfers just under a reporting threshold", True, "structuring_count >= 3", "structuring_count >= 1", "structuring_count", "transfer(s)"),
        ("High-risk merchant spend", True, "high_risk_mcc_spend_pct > 20", "high_risk_mcc_spend_pct > 8", "high_risk_mcc_spend_pct", "% high-risk"),
        ("One counterparty dominates P2P flow", False, "single_counterparty_dominance_pct > 85", "single_counterparty_dominance_pct > 60", "single_counterparty_dominance_pct", "% with one party"),
        ("Sudden transaction spike", False, "sudden_spike_ratio > 6", "sudden_spike_ratio > 3", "sudden_spike_ratio", "x the daily average"),
        ("Many failed transactions", False, "failed_ratio > 0.15", "failed_ratio > 0.08", "100 * failed_ratio", "% failed"),
        ("Too many round-number transfers", False, "round_amount_ratio > 0.4", "round_amount_ratio > 0.25", "100 * round_amount_ratio", "% round"),
    ],
    "bbps": [
        ("Duplicate bill payments", True, "duplicate_payment_count >= 2", "duplicate_payment_count >= 1", "duplicate_payment_count", "duplicate(s)"),
        ("Same bill paid twice fast", True, "rapid_repeat_count >= 2", "rapid_repeat_count >= 1", "rapid_repeat_count", "rapid repeat(s)"),
        ("One bill far above normal", True, "bill_spike_ratio > 4", "bill_spike_ratio > 2.5", "bill_spike_ratio", "x the average bill"),
        ("Almost all spend on one utility", False, "single_utility_dominance_pct > 90", "single_utility_dominance_pct > 75", "single_utility_dominance_pct", "% on one utility"),
        ("Too many round-number payments", False, "round_amount_ratio > 0.5", "round_amount_ratio > 0.3", "100 * round_amount_ratio", "% round"),
        ("Vague / unclassified bill narrations", False, "vague_narration_ratio > 0.4", "vague_narration_ratio > 0.2", "100 * vague_narration_ratio", "% unclassified"),
        ("Missed utility payments piling up", False, "missed_payment_count >= 4", "missed_payment_count >= 2", "missed_payment_count", "missed payment(s)"),
    ],
    "gst": [
        ("Sales figures don't match", True, "gstr1_vs_gstr3b_mismatch_pct > 15", "gstr1_vs_gstr3b_mismatch_pct > 8", "gstr1_vs_gstr3b_mismatch_pct", "% gap"),
        ("Claiming more tax credit than allowed", True, "itc_claim_ratio > 1.10", "itc_claim_ratio > 1.02", "itc_claim_ratio", "x available"),
        ("Skipped GST filings", True, "missed_return_count >= 2", "missed_return_count >= 1", "missed_return_count", "return(s) never filed"),
        ("Sales falling sharply", False, "turnover_decline_percentage > 40 OR consecutive_declining_quarters >= 3", "turnover_decline_percentage > 20", "turnover_decline_percentage", "% down"),
        ("Sales jumped unrealistically", False, "turnover_growth_yoy > 200", "turnover_growth_yoy > 120", "turnover_growth_yoy", "% up in a year"),
        ("Depends on a single customer", False, "top_buyer_sales_percentage > 70", "top_buyer_sales_percentage > 50", "top_buyer_sales_percentage", "% of sales"),
    ],
}


def typology_sql(source: str, domain: str, key: str = "account_id") -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, {quoted(name)} AS typology, {str(hard).lower()} AS hard, "
        f"CASE WHEN {match} THEN 'match' WHEN {elevated} THEN 'elevated' ELSE 'none' END AS verdict, "
        f"format('{{:,.2f}}', CAST({shown} AS DOUBLE)) || {quoted(' ' + unit)} AS evidence FROM {source}"
        for i, (name, hard, match, elevated, shown, unit) in enumerate(SIGNATURES[domain])
    )


def verdict_sql(domain: str, key: str = "account_id") -> str:
    return f"""
SELECT {key}, CASE WHEN hard_match THEN 'MATCHES FRAUD TYPOLOGY' WHEN band = 'extreme' OR (soft AND band = 'elevated') THEN 'ELEVATED ANOMALY SIGNATURE'
   WHEN soft OR band = 'elevated' THEN 'SOME ELEVATED SIGNALS' ELSE 'CONSISTENT WITH TRAINING' END AS verdict,
  concern AS concern_score, CASE WHEN concern >= 65 THEN 'concern' WHEN concern >= 35 THEN 'review' ELSE 'good' END AS zone,
  CASE WHEN concern < 35 THEN 'none' WHEN hard_match THEN 'typology' ELSE 'anomaly_metric' END AS reason,
  least(100.0, round_even(wz / 3.5 * 60.0, 1)) AS pattern_score,
  CASE WHEN hard_match THEN 'alert' WHEN soft THEN 'review' ELSE 'clear' END AS fraud_box,
  CASE WHEN band = 'extreme' THEN 'alert' WHEN band = 'elevated' THEN 'review' ELSE 'clear' END AS anomaly_box
FROM (SELECT *, CASE WHEN wz >= 3.5 THEN 'extreme' WHEN wz >= 2.0 THEN 'elevated' ELSE 'within' END AS band,
    CAST(round_even(greatest(CASE WHEN hard_match THEN 100.0 ELSE 0.0 END, least(100.0, wz / 3.5 * 60.0)), 0) AS BIGINT) AS concern
  FROM (SELECT {key}, bool_or(hard AND verdict = 'match') AS hard_match, bool_or(verdict <> 'none') AS soft FROM x_typ_{domain} GROUP BY 1)
  JOIN (SELECT {key}, max(z) AS wz FROM x_cmp_{domain} GROUP BY 1) USING ({key}))"""


PATTERN_SOURCES = {"aa": ("x_context", "account_id"), "upi": ("x_upi_metrics", "account_id"), "bbps": ("x_bill_metrics", "account_id"), "gst": ("x_gst_metrics", "gstin")}
for _d, (_src, _key) in PATTERN_SOURCES.items():
    block(f"x_long_{_d}", long_sql(_src, fixed.PATTERN_METRICS[_d], _key))
    block(f"x_decl_{_d}", declared_sql(_d))
    block(f"x_prof_{_d}", profile_sql(f"x_long_{_d}", 8, {"p95": 0.95}, 5))
    block(f"x_cmp_{_d}", compare_sql(_d, _key))
    block(f"x_typ_{_d}", typology_sql(_src, _d, _key))
    block(f"x_verdict_{_d}", verdict_sql(_d, _key))

block("x_vlong", long_sql("(SELECT *, CAST(NULL AS DOUBLE) AS account_age_days FROM x_vector)", fixed.OUTLIER_FALLBACK))
block("x_vprof", profile_sql("x_vlong", 30, {"p1": 0.01, "p99": 0.99}, 4))


def psi_sql(reference: str, recent: str) -> str:
    qs = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(11))
    return f"""
WITH e AS (SELECT metric, list_sort(list_distinct([{qs}])) AS edges, count(*) AS rn FROM {reference} WHERE value IS NOT NULL GROUP BY 1),
bins AS (SELECT metric, edges, rn, unnest(range(1, 11)) AS bin FROM e),
rb AS (SELECT metric, least(len(list_filter(edges, lambda q: q <= value)), len(edges) - 1) AS bin, count(*) AS rc FROM {reference} JOIN e USING (metric)
   WHERE value BETWEEN edges[1] AND edges[-1] GROUP BY ALL),
cb AS (SELECT metric, least(len(list_filter(edges, lambda q: q <= value)), len(edges) - 1) AS bin, count(*) AS cc FROM {recent} JOIN e USING (metric)
   WHERE value BETWEEN edges[1] AND edges[-1] GROUP BY ALL),
cn AS (SELECT metric, count(value) AS cn FROM {recent} GROUP BY 1),
sh AS (SELECT metric, rn, cn, len(edges) AS k, greatest(coalesce(rc, 0) / rn, 1e-4) AS ev, greatest(coalesce(cc, 0) / cn, 1e-4) AS av
   FROM bins LEFT JOIN rb USING (metric, bin) LEFT JOIN cb USING (metric, bin) JOIN cn USING (metric) WHERE bin < len(edges))
SELECT e.metric, coalesce(any_value(p), 0.0) AS psi FROM e LEFT JOIN
 (SELECT metric, CASE WHEN max(k) >= 3 AND max(rn) >= 20 AND max(cn) >= 10 THEN sum((av - ev) * ln(av / ev)) END AS p FROM sh GROUP BY 1) s USING (metric) GROUP BY 1"""
