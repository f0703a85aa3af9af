"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score.

All work is column expressions inside one scan, without a shuffle.  The matches
of a pattern and the pieces between them are two arrays of one row; positions
are running totals over their lengths, built in blocks so that a text with very
many matches stays linear.

The patterns are written so that Java matches them without backtracking into a
repeated group (possessive where nothing that follows could take the characters)
and without starting again inside a run that has already failed; what they match
is the contract's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import query, table, whole


def _any_case(*words: str) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: str  # a cheap test that every text with a match passes
    score: int  # of a confirmed span, in hundredths
    words: str  # context that adds CONTEXT to the score
    base: bool = True


#: Characters of an account number by country (fixed values).
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

#: The order of kinds is that of the spans with one start.
KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
        60,
        _any_case("mail", "contact"),
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        40,
        _any_case("host", "server", "address"),
    ),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){11}", 70, _any_case("card", "credit", "visa")),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]",
        50,
        _any_case("phone", "call", "mobile", "tel"),
    ),
    Kind(
        "iban",
        "|".join(rf"{c}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTH.items()),
        r"[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11}",
        80,
        _any_case("iban", "bank", "account"),
        base=False,
    ),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, _any_case("ssn", "social"), base=False),
    Kind(
        "local",
        r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
        r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
        30,
        _any_case("phone", "call", "mobile", "tel"),
        base=False,
    ),
]
CONTEXT = 30
ACCEPTED = 60  # an added kind needs this score; base spans always stay
NEAR = 40  # code points on either side that count as near
BLOCK = 128


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    total = F.aggregate(
        F.split(F.reverse(digits), "(?!^)(?!$)"),
        F.struct(F.lit(0).alias("sum"), F.lit(1).alias("times")),
        lambda acc, d: F.struct(
            (acc["sum"] + F.when(d.cast("int") * acc["times"] > 9, d.cast("int") * acc["times"] - 9).otherwise(d.cast("int") * acc["times"])).alias("sum"),
            (3 - acc["times"]).alias("times"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 check of an account number without blanks: the first four characters go to the end, letters count from 10."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.split(turned, "(?!^)(?!$)"),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def confirmed(kind: str, raw: Column) -> Column:
    n = F.length(_digits(raw))
    if kind == "ip":
        return raw.rlike(r"^0*(?:[01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(raw))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.translate(raw, " ", ""))
    return F.lit(True)


def _ends(steps: Column) -> Column:
    """Running totals over an array of lengths: an array of as many."""

    def inside(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("ends"))
        return F.aggregate(
            block,
            zero,
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + x)).alias("ends")),
            lambda acc: acc["ends"],
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.flatten(
        F.aggregate(
            blocks,
            zero,
            lambda acc, block: F.struct(
                (acc["at"] + F.aggregate(block, F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("at"),
                F.concat(acc["out"], F.array(inside(block, acc["at"]))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
    )


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:int>>"


def _proposed(rank: int, kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind: array of (start, rank, kind, end, score)."""
    gaps, raws = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pair = F.arrays_zip(F.slice(gaps, 1, F.size(raws)).alias("gap"), raws.alias("raw"), F.slice(gaps, 2, F.size(raws)).alias("next"))
    found = F.transform(
        pair,
        lambda p: F.struct(
            p["raw"].alias("raw"),
            F.char_length(p["gap"]).cast("bigint").alias("before"),
            F.char_length(p["raw"]).cast("bigint").alias("long"),
            (F.right(p["gap"], F.lit(NEAR)).rlike(kind.words) | F.left(p["next"], F.lit(NEAR)).rlike(kind.words)).alias("near"),
        ),
    )

    def placed(m: Column) -> Column:
        ends = _ends(F.transform(m, lambda x: x["before"] + x["long"]))
        spans = F.transform(
            F.arrays_zip(m.alias("m"), ends.alias("end")),
            lambda x: F.struct(
                (x["end"] - x["m"]["long"]).alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                x["end"].alias("end"),
                F.when(confirmed(kind.name, x["m"]["raw"]), F.lit(kind.score) + F.when(x["m"]["near"], CONTEXT).otherwise(0)).otherwise(-1).alias("score"),
            ),
        )
        return F.filter(spans, lambda s: s["score"] >= (0 if kind.base else ACCEPTED))

    # transform over a one-element array names the matches, so they are found once
    return F.when(text.rlike(kind.maybe), F.transform(F.array(found), placed)[0]).otherwise(F.array().cast(SPAN)).cast(SPAN)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and `found`, an array of (start, rank, kind, end, score) by start, then kind.

    Positions count code points from 0, the end exclusive.  Null and empty texts have no
    spans; whole texts of any length are read.  Rows repeated or with a null id are each
    answered.  An empty table gives an empty result.  Other columns are not read.
    """
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    arrays = base.select("_id", *(_proposed(i, k, text).alias(f"_{k.name}") for i, k in enumerate(KINDS)))
    return arrays.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*(F.col(f"_{k.name}") for k in KINDS))).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of `personal_spans`, with the number of added spans and of spans scored 80 or more."""
    n_base = sum(k.base for k in KINDS)
    found = personal_spans(docs)
    count = lambda test: F.size(F.filter("found", test)).cast("bigint")
    of = lambda rank: lambda s: s["rank"] == rank  # noqa: E731  one argument: a second one would be the position
    return found.select(
        "doc_id",
        *(count(of(i)).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base),
        F.sha2(_joined(F.filter("found", lambda s: s["rank"] < n_base)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count(lambda s: s["rank"] >= n_base).alias("n_added"),
        count(lambda s: s["score"] >= 80).alias("n_likely"),
    )


@query("op6_personal_data")
def op6(spark, sf_dir):
    return personal_report(table(spark, sf_dir, "documents"))
