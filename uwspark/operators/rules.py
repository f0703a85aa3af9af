"""Rule engine: context rows x catalogue -> one row per rule, and the decision ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import figures, rulebook
from ..functions.columns import count_if, half_even, sql_text
from ..functions.rulebook import Rule


def evaluate(ctx: DataFrame, rules: Sequence[Rule], key: str = "account_id", detail: bool = True) -> DataFrame:
    """Long table (key, ord, rule_id, label, category, serious, gate, status, detail).

    `detail` says what was measured and which limit it met or passed; decisions need none of it.
    """
    picked, texts, names, most = [], [], set(), 0
    for i, r in enumerate(rules):
        used, said = figures.templates(r)
        names.update(used)
        texts += said
        most = max(most, len(used))
        shown = f", 'figs', array({', '.join(f'_f_{n}' for n in used)})" if used else ", 'figs', cast(array() as array<string>)"
        picked.append(f"named_struct('ord', {i}, 'arm', {figures.arm_sql(r)}{shown if detail else ''})")
    # every figure is printed once, whatever the number of rules that show it
    base = ctx.selectExpr("*", *[f"{figures.printed(n)} as _f_{n}" for n in sorted(names)]) if detail else ctx
    # Groups of twenty keep each generated projection small.
    groups = [f"array({', '.join(picked[i : i + 20])})" for i in range(0, len(picked), 20)]
    found = base.selectExpr(key, f"inline(concat({', '.join(groups)}))")
    of = lambda values, at="ord": f"element_at(array({', '.join(values)}), {at} + 1)"
    filled = ", ".join(f"get(figs, {i})" for i in range(most)) or "''"
    return found.selectExpr(
        key,
        "ord",
        *[f"{of([sql_text(getattr(r, c)) for r in rules])} as {name}" for c, name in (("id", "rule_id"), ("label", "label"), ("category", "category"))],
        *[f"{of([str(getattr(r, c)) for r in rules])} as {c}" for c in ("serious", "gate")],
        f"{of([sql_text(s) for s in figures.STATUS], 'arm')} as status",
        *([f"format_string({of([sql_text(t) for t in texts], f'ord * {len(figures.STATUS)} + arm')}, {filled}) as detail"] if detail else []),
    )


def enabled_only(results: DataFrame, toggles: DataFrame, keys: Sequence[str] = ("rule_id",)) -> DataFrame:
    """Keep the rules switched on; `toggles` (keys, enabled) is a settings table of fixed size."""
    on = toggles.where("enabled").select(*keys).distinct()
    return results.join(F.broadcast(on), list(keys), "left_semi")


def catalogue(spark, rules: Sequence[Rule]) -> DataFrame:
    """The catalogue as a table, with default toggles: only the score gate is on."""
    rows = [(i, r.id, r.label, r.category, r.serious, r.business, r.computable, r.gate) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows,
        "ord int, rule_id string, label string, category string, serious boolean, business boolean, "
        "computable boolean, enabled boolean",
    )


def overlay(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rename rules and switch them; rule ids unknown to the catalogue are added as custom."""
    o = overrides.select("rule_id", F.col("label").alias("_l"), F.col("enabled").alias("_e"))
    return (
        base.join(o, "rule_id", "full")
        .withColumn("label", F.coalesce("_l", "label"))
        .withColumn("enabled", F.coalesce("_e", "enabled", F.lit(True)))
        .withColumn("category", F.coalesce("category", F.lit("Custom")))
        .withColumn("computable", F.coalesce("computable", F.lit(False)))
        .withColumn("serious", F.coalesce("serious", F.lit(False)))
        .withColumn("business", F.coalesce("business", F.lit(False)))
        .drop("_l", "_e")
    )


def tally(results: DataFrame, key: str = "account_id", collapse: Sequence[str] = ()) -> DataFrame:
    """Passed, failed, skipped and distinct serious fails; `collapse` ids count once."""
    failed = F.col("status") == "FAIL"
    serious = failed & F.col("serious")
    family = F.col("rule_id").isin(list(collapse)) if collapse else F.lit(False)
    return results.groupBy(key).agg(
        count_if(F.col("status") == "PASS").alias("passed"),
        count_if(failed).alias("failed"),
        count_if(F.col("status") == "SKIP").alias("skipped"),
        (count_if(serious & ~family) + F.least(F.lit(1), count_if(serious & family))).alias("serious_fails"),
        F.max(F.coalesce(F.col("gate") & (F.col("status") != "PASS"), F.lit(False))).alias("gate_failed"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(serious, F.struct("ord", "label")))), lambda x: x["label"]
            ),
            "; ",
        ).alias("serious_flags"),
    )


def ladder() -> Column:
    """Gate fail or two serious fails reject; one serious fail makes it conditional."""
    return (
        F.when(F.col("gate_failed") | (F.col("serious_fails") >= 2), "REJECTED")
        .when(F.col("serious_fails") == 1, "CONDITIONAL APPROVAL")
        .when(F.col("failed") > 0, "APPROVED WITH NOTES")
        .otherwise("APPROVED")
    )


def bank_decision(results: DataFrame) -> DataFrame:
    return tally(results, collapse=rulebook.BOUNCE_FAMILY).withColumn("decision", ladder())


def product_results(ctx: DataFrame, product: str, with_external: bool = True, detail: bool = True) -> DataFrame:
    """Every listed rule of one product; those that need an outside feed answer SKIP, or are left out if asked for."""
    known = {r.id: r for r in rulebook.PRODUCT_RULES}
    picked = []
    for rid in rulebook.PRODUCTS[product]:
        if rid in known:
            picked.append(known[rid])
        elif rid not in rulebook.OUTCOME_RULES and with_external:
            picked.append(Rule(rid, rid.replace("_", " ").title() + " Rule", "-", "?"))
    return evaluate(ctx, picked, detail=detail)


def product_decision(results: DataFrame, product: str) -> DataFrame:
    """Decision of a product with its three outcome rules added to the counts."""
    out = tally(results).withColumn("decision", ladder())
    d = F.col("decision")
    review = F.when(d.isin("CONDITIONAL APPROVAL", "APPROVED WITH NOTES"), "FAIL").otherwise("PASS")
    approve = F.when(d == "APPROVED", "PASS").otherwise("FAIL")
    reject = F.when(d == "REJECTED", "FAIL").otherwise("PASS")
    out = out.withColumns({"manual_review": review, "auto_approval": approve, "auto_rejection": reject})
    outcomes = ["manual_review", "auto_approval", "auto_rejection"]
    more_pass = sum((F.when(F.col(o) == "PASS", 1).otherwise(0) for o in outcomes), F.lit(0))
    return out.withColumns(
        {
            "product": F.lit(product),
            "passed": (F.col("passed") + more_pass).cast("bigint"),
            "failed": (F.col("failed") + 3 - more_pass).cast("bigint"),
        }
    )


def gst_decision(results: DataFrame, profiles: DataFrame) -> DataFrame:
    score = F.coalesce("head_score", F.lit(0.0))
    return (
        tally(results, key="gstin")
        .join(profiles.select("gstin", "head_score"), "gstin")
        .withColumn(
            "decision",
            F.when(F.col("serious_fails") > 0, "REJECTED")
            .when((F.col("failed") > 0) | (score < 55), "CONDITIONAL APPROVAL")
            .when(score >= 75, "APPROVED")
            .otherwise("APPROVED WITH NOTES"),
        )
    )


def with_final_signal(results: DataFrame, final: tuple[str, str]) -> DataFrame:
    """Add the closing rule: fails when more than two rules failed."""
    total = tally(results).select(
        "account_id", F.lit(99).alias("ord"), F.lit(final[0]).alias("rule_id"), F.lit(final[1]).alias("label"),
        F.lit("").alias("category"), F.lit(True).alias("serious"), F.lit(False).alias("gate"),
        F.when((F.col("passed") + F.col("failed")) == 0, "SKIP")
        .when(F.col("failed") <= 2, "PASS")
        .otherwise("FAIL")
        .alias("status"),
        F.format_string("%d passed, %d failed, %d skipped", "passed", "failed", "skipped").alias("detail"),
    )
    return results.unionByName(total)


def head_decision(results: DataFrame, heads: DataFrame) -> DataFrame:
    """Utility and payment ladder on (risk label, stability value) of the model heads."""
    t = tally(results).join(heads.select("account_id", "risk_label", "stability"), "account_id", "left")
    risk = F.upper(F.coalesce("risk_label", F.lit("")))
    return t.withColumn(
        "decision",
        F.when(F.col("serious_fails") > 0, "REJECTED")
        .when((F.col("failed") > 0) | (risk == "HIGH"), "CONDITIONAL APPROVAL")
        .when((risk == "LOW") & (F.coalesce("stability", F.lit(0.0)) >= 70), "APPROVED")
        .otherwise("APPROVED WITH NOTES"),
    )


# What a rule checks, by the ending of its label (fixed values, first hit wins).
LABEL_ENDINGS = [
    ("validation rule", "Checks that a declared figure is present and plausible."),
    ("matching rule", "Compares the same figure from two sources."),
    ("growth rule", "Looks at how a figure moved against earlier periods."),
    ("stability rule", "Looks at how steady a figure is from month to month."),
    ("regularity rule", "Checks that an expected event happens every period."),
    ("ratio rule", "Compares two amounts as a ratio against a limit."),
    ("count rule", "Counts events and compares them with a limit."),
    ("concentration rule", "Looks at how much depends on one party."),
    ("rule", "Checks one underwriting condition."),
]


def describe(label: str) -> Column:
    """Plain description of a rule from its label ending."""
    out = F.lit("Checks one underwriting condition.")
    for ending, text in reversed(LABEL_ENDINGS):
        out = F.when(F.lower(F.col(label)).endswith(ending), text).otherwise(out)
    return out


def explained(results: DataFrame) -> DataFrame:
    """Outcome word and one readable sentence per result row; no model or service is asked."""
    outcome = F.when(F.col("status") == "PASS", "met").when(
        F.col("status") == "FAIL", F.when(F.col("serious"), "not met, key rule").otherwise("not met")
    ).otherwise("not checked")
    return results.withColumn("outcome", outcome).withColumn(
        "explanation", F.concat_ws(" ", describe("label"), F.concat(F.lit("Outcome: "), "outcome", F.lit(".")), "detail")
    )


def factors(vector: DataFrame) -> DataFrame:
    """What hurt the applicant, as a list of short texts in a fixed order."""
    low = F.col("minimum_balance")
    arms = [
        F.when(F.col("nach_bounce_count_90d") > 0, "bounces"),
        F.when(low < 0, "overdrawn").when(low < 2000, "very low minimum balance"),
        F.when(
            (F.col("avg_monthly_inflow") > 0)
            & (F.col("avg_monthly_debit") > F.col("avg_monthly_inflow") * 1.05),
            "spending exceeds income",
        ),
        F.when(F.col("cash_withdrawal_ratio") > 0.20, "heavy cash withdrawals"),
        F.when(F.col("balance_volatility") > 1.0, "erratic balance"),
        F.when(F.col("income_stability") < 0.45, "irregular inflow"),
    ]
    return vector.withColumn("factors", F.array_compact(F.array(*arms)))


def payload(scored: DataFrame, statements: DataFrame) -> DataFrame:
    """Nested decision document per account: metadata, vector and factors."""
    names = [
        "statement_months", "avg_monthly_inflow", "avg_monthly_debit", "nach_bounce_count_90d", "dscr_ratio",
        "cash_withdrawal_ratio", "balance_volatility", "minimum_balance", "avg_balance", "foir_ratio",
        "income_stability",
    ]
    return factors(scored).join(statements, "account_id").select(
        "account_id",
        "transaction_count",
        F.lit("ANALYZED").alias("status"),
        F.struct(
            F.col("score").alias("credit_score"),
            F.col("grade").alias("risk_grade"),
            half_even(F.col("pd") / 100, 4).alias("probability_of_default"),
        ).alias("model_metadata"),
        F.struct(*names).alias("feature_vector"),
        "factors",
    )


def resolved_toggles(listed: DataFrame, settings: DataFrame, default: bool = True) -> DataFrame:
    """Adds `enabled` to the (product, source, rule_id) rows of a catalogue by the most specific setting.

    `settings` has (product, source, rule_id, enabled, seq), null for any product or source.  A setting of
    product and source beats one of the product alone, that one of the source alone, and that a global one;
    of equally specific settings the one with the highest `seq` counts.  Settings of unknown rules do nothing.
    """
    # one setting per address before any join
    last = settings.groupBy("product", "source", "rule_id").agg(F.max_by("enabled", "seq").alias("enabled"))
    weight = F.when(F.col("s_product").isNotNull(), 2).otherwise(0) + F.when(F.col("s_source").isNotNull(), 1).otherwise(0)
    s = last.select(F.col("product").alias("s_product"), F.col("source").alias("s_source"), "rule_id", F.col("enabled").alias("_on"))
    fits = (F.col("s_product").isNull() | (F.col("s_product") == F.col("product"))) & (F.col("s_source").isNull() | (F.col("s_source") == F.col("source")))
    # at most four settings apply to a row
    hit = listed.join(s, "rule_id").where(fits).groupBy("product", "source", "rule_id").agg(F.max_by("_on", weight).alias("_on"))
    return (
        listed.join(hit, ["product", "source", "rule_id"], "left")
        .withColumn("enabled", F.coalesce("_on", F.lit(default)))
        .drop("_on")
    )
