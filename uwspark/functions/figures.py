"""Measured figures in words: what a rule looked at, printed with the same digits everywhere.

A rule prints the columns its conditions name, in their order, each as label and value.  Values are
rounded half to even before they are printed with thousands separators.
"""

from __future__ import annotations

import re

from .rulebook import Rule

#: label and kind of the columns that rules look at
FIGURES: dict[str, tuple[str, str]] = {
    # statement
    "growth": ("inflow growth", "percent"),
    "n_months": ("months of data", "count"),
    "inflow_cv": ("inflow variation", "number"),
    "zero_inflow_months": ("months without inflow", "count"),
    "largest_credit_pct": ("largest credit against the inflow of a month", "percent"),
    "top1_share": ("share of the largest payer", "percent"),
    "top3_share": ("share of the three largest payers", "percent"),
    "top5_share": ("share of the five largest payers", "percent"),
    "top_supplier_share": ("share of the largest payee", "percent"),
    "repeat_payees": ("recurring counterparties", "count"),
    "min_bal": ("lowest balance", "money"),
    "avg_bal": ("average balance", "money"),
    "balance_declining": ("falling balance", "flag"),
    "neg_points": ("rows below zero", "count"),
    "low_bal_points": ("rows with a low balance", "count"),
    "fixed_burden": ("fixed payments a month", "money"),
    "fixed_burden_ratio": ("fixed payments against inflow", "percent"),
    "coverage": ("inflow against fixed payments", "number"),
    "total_credit": ("money in", "money"),
    "total_debit": ("money out", "money"),
    "deficit_months": ("months spent above income", "count"),
    "expense_ratio": ("money out against money in", "percent"),
    "rent_count": ("rent payments", "count"),
    "rent_burden": ("rent against inflow", "percent"),
    "round_credits": ("round deposits", "count"),
    "emi_burden": ("instalments against inflow", "percent"),
    "emi_lenders": ("lenders", "count"),
    "emi_txn_count": ("instalments", "count"),
    "emi_months": ("months with instalments", "count"),
    "monthly_emi": ("instalments a month", "money"),
    "bounce_count": ("returned payments", "count"),
    "reversal_count": ("reversed payments", "count"),
    "dormant": ("dormant", "flag"),
    "active_every_month": ("active every month", "flag"),
    "activity_spike": ("sudden activity", "flag"),
    "gst_count": ("tax payments of the business", "count"),
    "tax_count": ("tax payments", "count"),
    "cash_deposit_ratio": ("cash share of deposits", "percent"),
    "cash_withdrawal_ratio": ("cash share of withdrawals", "percent"),
    "cash_wd_count": ("cash withdrawals", "count"),
    "statement_months": ("months of statement", "count"),
    "upi_credit_count": ("instant payments received", "count"),
    "util_count": ("utility payments", "count"),
    "same_day_inout": ("sums in and out within two days", "count"),
    "same_day_ratio": ("deposits moved straight on", "percent"),
    "rapid_dup": ("quickly repeated payments", "count"),
    "score": ("score", "count"),
    "pd": ("probability of default in per cent", "number"),
    "avg_monthly_inflow": ("inflow a month", "money"),
    "income_stability": ("steadiness of income", "number"),
    "foir_ratio": ("obligations against income in per cent", "number"),
    "dscr_ratio": ("debt service cover", "number"),
    "account_age_days": ("age of the account in days", "count"),
    "tx_per_month": ("rows a month", "number"),
    # tax
    "gstin": ("registration", "text"),
    "gst_status": ("status", "text"),
    "business_vintage_years": ("years in business", "number"),
    "filing_regularity_percentage": ("returns filed in per cent", "number"),
    "late_return_count": ("late returns", "count"),
    "missed_return_count": ("missed returns", "count"),
    "gstr1_vs_gstr3b_mismatch_pct": ("gap between the returns in per cent", "number"),
    "annualised_gst_turnover": ("turnover a year", "money"),
    "monthly_turnover": ("turnover of the last month", "money"),
    "quarterly_turnover": ("turnover of the last quarter", "money"),
    "turnover_growth_yoy": ("growth over a year in per cent", "number"),
    "turnover_decline_percentage": ("decline in per cent", "number"),
    "consecutive_declining_quarters": ("falling quarters in a row", "count"),
    "itc_claimed_amount": ("credit claimed", "money"),
    "itc_available_amount": ("credit available", "money"),
    "net_itc_amount": ("net credit", "money"),
    "top_buyer_sales_percentage": ("sales to the largest buyer in per cent", "number"),
    "buyer_concentration_level": ("concentration of buyers", "text"),
    "gst_turnover_to_loan_ratio": ("turnover against loan", "number"),
    "head_loan": ("highest loan", "money"),
    "gst_data_completeness_score": ("completeness of the data", "number"),
    "head_risk": ("risk band", "text"),
    "head_score": ("underwriting score", "number"),
    "head_filing": ("filing head", "number"),
    # payments and bills
    "available": ("data at hand", "flag"),
    "total_transactions": ("payments", "count"),
    "success_ratio": ("successful payments", "percent"),
    "failed_count": ("failed payments", "count"),
    "p2p_count": ("payments between people", "count"),
    "p2m_count": ("payments to merchants", "count"),
    "unique_payers": ("different payers", "count"),
    "unique_payees": ("different payees", "count"),
    "recurring_payee_count": ("recurring payees", "count"),
    "high_risk_mcc_spend_pct": ("high-risk spend in per cent", "number"),
    "weekend_spend_pct": ("weekend spend in per cent", "number"),
    "p2p_debit_velocity": ("payments to people a day", "number"),
    "avg_ticket_size": ("average payment", "money"),
    "daily_avg_transactions": ("payments a day", "number"),
    "span_months": ("months covered", "count"),
    "utility_accounts": ("utility accounts", "count"),
    "has_electricity": ("electricity bills", "flag"),
    "has_water": ("water bills", "flag"),
    "has_gas": ("gas bills", "flag"),
    "has_broadband": ("broadband bills", "flag"),
    "has_mobile_dth": ("mobile or television bills", "flag"),
    "recurring_types": ("recurring kinds of bills", "count"),
    "punctuality_index": ("punctuality", "number"),
    "missed_payment_count": ("missed bills", "count"),
    "on_time_payment_ratio": ("bills paid in time", "percent"),
    "payments_last_12m": ("bills of the last year", "count"),
    "average_bill_amount": ("average bill", "money"),
}

#: What rules without a limit report.
REPORTED: dict[str, tuple[str, ...]] = {
    "rev_monthly_inflow": ("avg_monthly_inflow",),
    "cf_avg_bal": ("avg_bal",),
    "exp_ratio": ("expense_ratio",),
    "exp_fixed_burden": ("fixed_burden_ratio",),
    "emi_existing_count": ("emi_lenders",),
    "emi_total_burden": ("emi_burden",),
    "bank_frequency": ("tx_per_month",),
    "cash_deposit_ratio": ("cash_deposit_ratio",),
    "upi_receipts": ("upi_credit_count",),
    "income_validation": ("avg_monthly_inflow",),
    "bank_credit_volume": ("total_credit",),
    "bank_debit_volume": ("total_debit",),
    "existing_emi": ("monthly_emi",),
    "income_to_loan": ("avg_monthly_inflow",),
    "loan_to_turnover": ("total_credit",),
    "max_loan_eligibility": ("avg_monthly_inflow",),
    "average_ticket_size": ("avg_ticket_size",),
    "p2p_borrowing_velocity": ("p2p_debit_velocity",),
    "average_bill_amount_consistency": ("average_bill_amount",),
}

SKIPPED = "Not applicable or too little data"
UNKNOWN_RULE = "No evaluator: needs an outside feed or a longer history."


def columns_of(condition: str) -> list[str]:
    """Columns of FIGURES that a condition names, in their order."""
    bare = re.sub(r"'[^']*'", "", condition)
    return [w for w in dict.fromkeys(re.findall(r"\b[a-z][a-z_0-9]*\b", bare)) if w in FIGURES]


def in_words(condition: str) -> str:
    """A condition with the labels of its columns and percentages as they are printed."""
    out = condition
    for name in sorted(columns_of(condition), key=len, reverse=True):
        label, kind = FIGURES[name]
        if kind == "percent":  # limits of a share are printed like the share
            out = re.sub(rf"\b{name}( *[<>=]+ *)(-?[0-9.]+)", lambda m, n=name: f"{n}{m[1]}{float(m[2]) * 100:g} %", out)
        out = re.sub(rf"\b{name}\b", label, out)
    return out


SALARIED, SKIP, FAIL, PASS, UNKNOWN = range(5)
#: Status of each arm.
STATUS = ("SKIP", "SKIP", "FAIL", "PASS", "SKIP")


def arm_sql(rule: Rule) -> str:
    """Which arm of a rule holds, as a number."""
    if not rule.computable:
        return str(UNKNOWN)
    arms = []
    if rule.business:
        arms.append(f"when is_salaried then {SALARIED}")
    if rule.skip != "-":
        arms.append(f"when {rule.skip} then {SKIP}")
    if rule.fail != "no":
        arms.append(f"when {rule.fail} then {FAIL}")
    return f"case {' '.join(arms)} else {PASS} end" if arms else str(PASS)


def shown(rule: Rule) -> tuple[list[str], list[str]]:
    """Columns a rule prints where it is skipped, and where it is not."""
    skip = columns_of(rule.skip) if rule.skip != "-" else []
    own = [*REPORTED.get(rule.id, ()), *(columns_of(rule.fail) if rule.fail not in ("no", "?") else skip)]
    return skip, [n for n in dict.fromkeys(own) if n != "available"]


def templates(rule: Rule) -> tuple[list[str], list[str]]:
    """Columns a rule prints, and the text of each arm with numbered places for them."""
    skip, own = shown(rule)
    names = list(dict.fromkeys([*skip, *own]))
    plain = lambda t: t.replace("%", "%%")
    places = lambda ns: ", ".join(f"{plain(FIGURES[n][0])} %{names.index(n) + 1}$s" for n in ns)
    measured = f"Measured {places(own)}." if own else "Informative."
    texts = [
        "Not applicable to a salaried account.",
        SKIPPED + (f": {places(skip)}." if skip else "."),
        f"{measured} Fails where {plain(in_words(rule.fail))}.",
        measured if rule.fail == "no" else f"{measured} Within the limit.",
        UNKNOWN_RULE,
    ]
    return names, texts


def printed(name: str) -> str:
    """Spark SQL of one value as text; a missing one is `unknown`."""
    rounded = lambda x, d: f"format_number(rint(cast({x} as double) * {float(10**d)}D) / {float(10**d)}D + 0.0D, {d})"
    text = {
        "money": f"concat('₹', {rounded(name, 2)})",
        "percent": f"concat({rounded(f'{name} * 100', 1)}, ' %')",
        "number": rounded(name, 2),
        "count": rounded(name, 0),
        "flag": f"if({name}, 'yes', 'no')",
        "text": name,
    }[FIGURES[name][1]]
    return f"if({name} is null, 'unknown', {text})"
