"""Detail texts of rules on small context rows; tags of narrations."""

from pyspark.sql import functions as F

from uwspark.functions import columns, figures, fixed, rulebook
from uwspark.functions.rulebook import Rule
from uwspark.operators import ledger, rules


def test_details_print_measured_figures(spark):
    catalogue = [
        Rule("a", "A", skip="n_months < 2", fail="inflow_cv >= 0.30"),
        Rule("b", "B", fail="largest_credit_pct > 0.30 OR total_credit < 1000", business=True),
        Rule("c", "C", fail="balance_declining", serious=True),
        Rule("exp_ratio", "D"),
        Rule("e", "E", fail="?"),
        Rule("f", "F", fail="no"),
    ]
    rows = [
        (1, 1, 0.5, 0.455, 1234567.891, True, 0.995, False),
        (2, 12, 0.125, 0.1, -0.001, None, None, False),
        (3, 12, 0.3, 0.31, 5000.0, False, 1.0, True),
    ]
    schema = "account_id long, n_months long, inflow_cv double, largest_credit_pct double, total_credit double, balance_declining boolean, expense_ratio double, is_salaried boolean"
    got = {(r.account_id, r.rule_id): (r.status, r.detail) for r in rules.evaluate(spark.createDataFrame(rows, schema), catalogue).collect()}
    limit = "Fails where largest credit against the inflow of a month > 30 % OR money in < 1000."
    assert got[1, "a"] == ("SKIP", "Not applicable or too little data: months of data 1.")
    assert got[2, "a"] == ("PASS", "Measured inflow variation 0.12. Within the limit.")  # half to even
    assert got[3, "a"] == ("FAIL", "Measured inflow variation 0.30. Fails where inflow variation >= 0.30.")
    assert got[1, "b"] == ("FAIL", f"Measured largest credit against the inflow of a month 45.5 %, money in ₹1,234,567.89. {limit}")
    assert got[2, "b"] == ("FAIL", f"Measured largest credit against the inflow of a month 10.0 %, money in ₹0.00. {limit}")
    assert got[3, "b"] == ("SKIP", "Not applicable to a salaried account.")
    assert got[1, "c"] == ("FAIL", "Measured falling balance yes. Fails where falling balance.")
    assert got[2, "c"] == ("PASS", "Measured falling balance unknown. Within the limit.")
    assert got[1, "exp_ratio"] == ("PASS", "Measured money out against money in 99.5 %.")
    assert got[2, "exp_ratio"] == ("PASS", "Measured money out against money in unknown.")
    assert got[1, "e"] == ("SKIP", figures.UNKNOWN_RULE) and got[1, "f"] == ("PASS", "Informative.")
    plain = rules.evaluate(spark.createDataFrame(rows, schema), catalogue, detail=False)
    assert "detail" not in plain.columns and {(r.account_id, r.rule_id): r.status for r in plain.collect()} == {k: v[0] for k, v in got.items()}


def test_every_rule_with_a_limit_prints_a_figure():
    for rules_of in (rulebook.BANK_RULES, rulebook.PRODUCT_RULES, rulebook.GST_RULES, rulebook.UPI_RULES, rulebook.BBPS_RULES):
        for r in rules_of:
            if r.computable and r.fail != "no":
                assert figures.shown(r)[1], r.id


def test_tags_are_those_of_their_patterns(spark):
    texts = [
        None, "", "ECS RETURN 12", "ecs  ret", "Dishonoured cheque", "insufficient Funds", "ATM", "batman", "cash\twithdrawal", "CASH WD", "cash deposit",
        "car loan", "instament", "InstalMent 3", "standing instr", "auto debit", "x si y", "single", "repay", "GSTPMT", "gstin 1", "goods and  services tax",
        "Self assessment tax", "taxi", "itns 280", "sal-cr", "sal cr", "Sale", "wages", "payrolls", "rent", "parent", "lease payment", "water bill", "water", "mobilebill",
        "DTH", "bbps", "pay@ybl", "UPI/1", "cupid", "charge back", "txn  reversed", "reversals", "ſalary", "Iſ si", "taxİ RENT", "ﬁ nach", "straße emi",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, narration string")
    whole = rows.select("seq", *[F.expr(f"narration rlike {columns.sql_text(p)}").alias(n) for n, p in fixed.TAG_PATTERNS.items()])
    tags = list(fixed.TAG_PATTERNS)
    want = whole.orderBy("seq").collect()
    assert ledger.tagged(rows).select("seq", *tags).orderBy("seq").collect() == want
    assert rows.select("seq", *[c.alias(n) for n, c in columns.narration_tags().items()]).orderBy("seq").collect() == want
    for tag in tags:
        assert any(r[tag] for r in want), tag


def test_a_pattern_is_tried_only_on_texts_with_one_of_its_words(spark):
    # capitals without a word: no pattern may be asked, so none answers
    rows = spark.createDataFrame([("ATM RENT UPI GST EMI TDS SALARY DTH RETURN REVERSAL", "")], "narration string, capitals string")
    got = rows.select(*[c.alias(n) for n, c in columns.narration_tags("narration", "capitals").items()]).first()
    assert set(got) == {False}
