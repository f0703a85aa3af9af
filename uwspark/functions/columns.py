"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(x: str | Column, digits: int = 0) -> Column:
    """Round half to even.  Scaling and `rint` stay in whole-stage code, unlike decimal rounding."""
    v = c(x).cast("double")
    return F.rint(v) if digits == 0 else F.rint(v * float(10**digits)) / float(10**digits)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, 0 when the divisor is 0 or missing."""
    return F.coalesce(c(num) / F.nullif(c(den).cast("double"), F.lit(0.0)), F.lit(0.0))


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def money_sum(cond: Column, amount: str | Column = "amount") -> Column:
    return F.coalesce(F.sum(F.when(cond, c(amount))), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def signature(narration: str = "narration") -> Column:
    """First three significant words of a narration."""
    stop = ", ".join(sql_text(w) for w in fixed.SIGNATURE_STOPWORDS)
    return F.expr(
        f"array_join(slice(filter(regexp_extract_all(upper({narration}), '([A-Z]{{3,}})', 1), "
        f"w -> w not in ({stop})), 1, 3), ' ')"
    )


def counterparty(sig: str | Column, narration: str | Column) -> Column:
    """Signature of a row, else its whole narration: a cut one would merge different parties."""
    return F.when(c(sig) != "", c(sig)).otherwise(c(narration))


def narration_tags(narration: str = "narration", upper: str | None = None) -> dict[str, Column]:
    """A flag per tag.  A pattern is tried only on texts that hold one of its words, looked up in `upper`, a column of the text in capitals."""
    capitals = upper or f"upper({narration})"

    def tag(name: str, pattern: str) -> Column:
        worded = " or ".join(f"contains({capitals}, {sql_text(w)})" for w in fixed.TAG_WORDS[name])
        return F.expr(f"({worded}) and {narration} rlike {sql_text(pattern)}")

    return {name: tag(name, p) for name, p in fixed.TAG_PATTERNS.items()}


def utility_type(narration: str = "narration") -> Column:
    arms = [f"when {narration} rlike {sql_text(p)} then '{k}'" for k, p in fixed.UTILITY_PATTERNS.items()]
    arms.append(f"when {narration} rlike {sql_text(fixed.BBPS_HINT)} then 'OTHER_BBPS'")
    return F.expr(f"case {' '.join(arms)} end")


def narration_amount(narration: str = "narration") -> Column:
    """Amount printed inside a narration, null when absent or not positive."""
    text = F.regexp_extract(F.coalesce(c(narration), F.lit("")), fixed.NARRATION_AMOUNT, 1)
    value = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    return F.when(value > 0, value)


def _mentions(narration: str, words: list[str]) -> Column:
    text = f"lower(coalesce({narration}, ''))"
    return F.expr(" or ".join(f"contains({text}, {sql_text(w)})" for w in words))


def guessed_type(narration: str = "narration") -> Column:
    return F.when(_mentions(narration, fixed.DEBIT_HINTS), "DEBIT").when(
        _mentions(narration, fixed.CREDIT_HINTS), "CREDIT"
    )


def grade(score: str | Column, low_min: int = 700, medium_min: int = 550) -> Column:
    return F.when(c(score) >= low_min, "LOW").when(c(score) >= medium_min, "MEDIUM").otherwise("HIGH")


def decision_of(grade_col: str | Column) -> Column:
    g = c(grade_col)
    return F.when(g == "LOW", "APPROVED").when(g == "MEDIUM", "CONDITIONAL APPROVAL").otherwise("REJECTED")


def z_band(z: str | Column) -> Column:
    return F.when(c(z) >= 3.5, "extreme").when(c(z) >= 2.0, "elevated").otherwise("within")


def psi_band(psi: str | Column) -> Column:
    return (
        F.when(c(psi) >= fixed.PSI_ALERT, "alert").when(c(psi) >= fixed.PSI_WARN, "warn").otherwise("stable")
    )


def concentration_band(pct: str | Column) -> Column:
    return F.when(c(pct) >= 45, "HIGH").when(c(pct) >= 25, "MEDIUM").otherwise("LOW")


def zone(concern: str | Column) -> Column:
    return F.when(c(concern) >= 65, "concern").when(c(concern) >= 35, "review").otherwise("good")


def month_of(date: str | Column) -> Column:
    return F.date_format(c(date), "yyyy-MM")


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, also where `use` refers to it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)
