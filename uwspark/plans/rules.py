"""Rule and decision queries of the bank-statement domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import figures, rulebook
from ..operators import features, rules
from ..staging import stage
from . import oracle
from .bank import context_of, prepared, scores
from .registry import query

oracle.block("x_bank_rules", oracle.rules_sql("x_context", rulebook.BANK_RULES))
oracle.block("x_bank_tally", oracle.tally_sql("x_bank_rules", family=rulebook.BOUNCE_FAMILY))

_known = {r.id: r for r in rulebook.PRODUCT_RULES}
for _p, _ids in rulebook.PRODUCTS.items():
    oracle.block(f"x_rules_{_p}", oracle.rules_sql("x_context", [_known[i] for i in _ids if i in _known]))
    oracle.block(f"x_tally_{_p}", oracle.tally_sql(f"x_rules_{_p}"))


@query(
    "c13_k04_bank_rules",
    "SELECT account_id, rule_id, status, serious, detail FROM x_bank_rules",
)
def bank_rules(spark, sf_dir):
    _, ctx = context_of(spark, sf_dir)
    return rules.evaluate(ctx, rulebook.BANK_RULES).select("account_id", "rule_id", "status", "serious", "detail")


@query(
    "k04_g04_bank_decision",
    f"SELECT account_id, passed, failed, skipped, serious_fails, gate_failed, {oracle.LADDER} AS decision FROM x_bank_tally",
)
def bank_decision(spark, sf_dir):
    _, ctx = context_of(spark, sf_dir)
    out = rules.bank_decision(rules.evaluate(ctx, rulebook.BANK_RULES, detail=False))
    return out.drop("serious_flags")


@query(
    "j02_default_toggles_decision",
    """SELECT account_id, CASE WHEN status = 'FAIL' THEN 'REJECTED' ELSE 'APPROVED' END AS decision,
      CAST(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END AS BIGINT) AS passed FROM x_bank_rules WHERE gate""",
)
def toggled(spark, sf_dir):
    _, ctx = context_of(spark, sf_dir)
    toggles = rules.catalogue(spark, rulebook.BANK_RULES)
    out = rules.bank_decision(rules.enabled_only(rules.evaluate(ctx, rulebook.BANK_RULES, detail=False), toggles))
    return out.select("account_id", "decision", "passed")


def _outside(p: str) -> list[str]:
    """Listed rules of a product that no evaluator answers."""
    known = {r.id for r in rulebook.PRODUCT_RULES}
    return [r for r in rulebook.PRODUCTS[p] if r not in known and r not in rulebook.OUTCOME_RULES]


@query(
    "k05_product_rules",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS product, account_id, rule_id, status, serious, detail FROM x_rules_{p} UNION ALL
            SELECT '{p}', account_id, unnest([{oracle.quoted(_outside(p))}]), 'SKIP', false, '{figures.UNKNOWN_RULE}' FROM (SELECT DISTINCT account_id FROM x_rules_{p})"""
        for p in rulebook.PRODUCTS
    ),
)
def product_rules(spark, sf_dir):
    _, ctx = context_of(spark, sf_dir)
    parts = [
        rules.product_results(ctx, p).select(F.lit(p).alias("product"), "account_id", "rule_id", "status", "serious", "detail")
        for p in rulebook.PRODUCTS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _product_sql(p: str) -> str:
    return f"""SELECT '{p}' AS product, account_id, decision, CAST(skipped + {len(_outside(p))} AS BIGINT) AS skipped,
      CAST(passed + CASE WHEN decision IN ('CONDITIONAL APPROVAL', 'APPROVED WITH NOTES') THEN 1
         WHEN decision = 'APPROVED' THEN 3 ELSE 1 END AS BIGINT) AS passed,
      serious_fails FROM (SELECT *, {oracle.LADDER} AS decision FROM x_tally_{p})"""


@query("k05_product_decisions", " UNION ALL ".join(_product_sql(p) for p in rulebook.PRODUCTS))
def product_decisions(spark, sf_dir):
    _, ctx = context_of(spark, sf_dir)
    parts = [
        rules.product_decision(rules.product_results(ctx, p, detail=False), p).select(
            "product", "account_id", "decision", "skipped", "passed", "serious_fails"
        )
        for p in rulebook.PRODUCTS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "k19_decision_payload",
    """SELECT account_id, transaction_count, credit_score, risk_grade, probability_of_default,
      array_to_string(list_filter([CASE WHEN nach_bounce_count_90d > 0 THEN 'bounces' END,
        CASE WHEN minimum_balance < 0 THEN 'overdrawn' WHEN minimum_balance < 2000 THEN 'very low minimum balance' END,
        CASE WHEN avg_monthly_inflow > 0 AND avg_monthly_debit > avg_monthly_inflow * 1.05 THEN 'spending exceeds income' END,
        CASE WHEN cash_withdrawal_ratio > 0.20 THEN 'heavy cash withdrawals' END,
        CASE WHEN balance_volatility > 1.0 THEN 'erratic balance' END,
        CASE WHEN income_stability < 0.45 THEN 'irregular inflow' END], lambda x: x IS NOT NULL), '; ') AS factors
    FROM (SELECT s.*, n AS transaction_count, score AS credit_score, grade AS risk_grade,
            round_even(pd / 100, 4) AS probability_of_default FROM x_score s JOIN x_totals USING (account_id))""",
)
def payload(spark, sf_dir):
    led = prepared(spark, sf_dir)
    out = rules.payload(scores(led), features.statement_summary(led))
    return out.select(
        "account_id", "transaction_count", "model_metadata.*", F.array_join("factors", "; ").alias("factors")
    )
