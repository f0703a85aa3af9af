"""Files as Spark sources: delimited, JSON, pipe tables, free text, admission and scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import fixed, parsing
from ..functions.columns import bound, clip, half_even


def normalised_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with its header normalised; every column stays text until it is cast explicitly."""
    df = spark.read.csv(path, header=True, sep=sep)
    return df.toDF(*[normalised_header(c) for c in df.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row per file, for files admitted under the size limit."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def line_table(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, line_no, line) of non-empty trimmed lines."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(key, F.posexplode(lines).alias("line_no", "line"))


def count_of(text: str | Column, piece: str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.length(t) - F.length(F.replace(t, F.lit(piece), F.lit("")))


def header_delimiter(line: str) -> Column:
    """Delimiter of a statement header: tab, pipe, the semicolon when it outnumbers commas, comma."""
    return (
        F.when(F.contains(F.col(line), F.lit("\t")), "\t")
        .when(F.contains(F.col(line), F.lit("|")), "|")
        .when(count_of(line, ";") > count_of(line, ","), ";")
        .otherwise(",")
    )


def frequent_delimiter(text: str, within: int | None = None) -> Column:
    """Most frequent delimiter of the text (or its first `within` characters), ties in the order tab , ; |."""
    head = F.col(text) if within is None else F.substring(text, 1, within)
    n = {d: count_of(head, d) for d in ("\t", ",", ";", "|")}
    best = F.greatest(*n.values())
    out = None
    for d, k in n.items():
        out = F.when(k == best, d) if out is None else out.when(k == best, d)
    return out


def header_lines(lines: DataFrame, key: str = "file", within: int | None = None) -> DataFrame:
    """First line (of the leading `within` ones, if given) that names a date and an amount column, else the first line."""
    low = F.lower("line")
    hit = low.contains("date") & low.rlike("debit|credit|withdrawal|deposit|amount|balance")
    if within is not None:
        hit = hit & (F.col("line_no") < within)
    return lines.groupBy(key).agg(
        F.coalesce(F.min(F.when(hit, F.col("line_no"))), F.lit(0)).alias("header_no")
    )


def pipe_rows(lines: DataFrame, key: str = "file") -> DataFrame:
    """Rows of a pipe table: two pipes at least, separator rows left out; cells as an array."""
    bare = F.trim(F.btrim("line", F.lit("| ")))
    return (
        lines.where(count_of("line", "|") >= 2)
        .withColumn("row", bare)
        .where(~F.col("row").rlike(r"^[\s:|\-]+$") & (F.col("row") != ""))
        .select(key, "line_no", F.transform(F.split("row", r"\|"), lambda x: F.trim(x)).alias("cells"))
    )


def statement_cells(lines: DataFrame, key: str = "file") -> DataFrame:
    """Delimited statement lines to typed rows, columns found by fuzzy header names.

    The header is joined back as one row per file; a file is bounded by its admission limit.
    """
    heads = (
        lines.join(header_lines(lines, key), key)
        .where("line_no = header_no")
        .withColumn("sep", header_delimiter("line"))
        .select(
            key, "header_no", "sep",
            F.transform(F.expr("split(lower(line), concat('[', sep, ']'))"), lambda x: F.trim(x)).alias("head"),
        )
    )
    rows = lines.join(heads, key).where("line_no > header_no").withColumn(
        "cells", F.transform(F.expr("split(line, concat('[', sep, ']'))"), lambda x: F.trim(F.btrim(x, F.lit("| "))))
    )
    rows = rows.where((F.size("cells") >= 2) & ~F.col("line").rlike(r"^[\s:|\-]+$"))

    def cell(words: Sequence[str]) -> Column:
        test = " or ".join(f"contains(h, '{w}')" for w in words)
        return F.expr(f"try_element_at(cells, cast(nullif(array_position(transform(head, h -> {test}), true), 0) as int))")

    debit, credit = parsing.number(cell(["debit", "withdrawal"])), parsing.number(cell(["credit", "deposit"]))
    kind = cell(["dr/cr", "cr/dr", "drcr", "type", "indicator"])
    typed = parsing.debit_credit(debit, credit, parsing.number(cell(["amount"])), kind)
    narr = cell(["narration", "description", "particulars", "details"])
    out = rows.select(
        key,
        "line_no",
        cell(["date"]).alias("date_raw"),
        F.when(F.coalesce(narr, F.lit("")) != "", narr).otherwise(F.col("line")).alias("narration"),
        typed["txn_type"].alias("txn_type"),
        typed["amount"].alias("amount"),
        parsing.number(cell(["balance"])).alias("balance"),
        F.coalesce(narr, F.lit("")).alias("_narr"),
    )
    keep = F.col("amount").isNotNull() | (F.coalesce("date_raw", F.lit("")) != "") | (F.col("_narr") != "")
    return out.where(keep).drop("_narr").withColumn("txn_date", parsing.statement_date("date_raw"))


def json_arrays(text: str, wrappers: Sequence[str]) -> Column:
    """The records of a bare array, a wrapper object or a single object as an array of maps."""
    rec = "array<map<string,string>>"
    options = {"mode": "PERMISSIVE"}
    bare = F.from_json(text, rec, options)
    wrapped = [F.from_json(F.get_json_object(text, f"$.{w}"), rec, options) for w in wrappers]
    single = F.array(F.from_json(text, "map<string,string>", options))
    is_list = F.ltrim(F.col(text)).startswith("[")
    return F.when(is_list, bare).otherwise(F.coalesce(*wrapped, single))


def json_records(texts: DataFrame, wrappers: Sequence[str], text: str = "text", key: str = "file") -> DataFrame:
    """One map per record of a bare array, a wrapper object or a single object."""
    return texts.select(key, F.posexplode(json_arrays(text, wrappers)).alias("rec_no", "record"))


def picked(record: str, wants: Sequence[str]) -> Column:
    """Value of the first key whose letters contain one of the wanted words."""
    test = " or ".join(f"contains(regexp_replace(lower(e.key), '[^a-z]', ''), '{w}')" for w in wants)
    return F.expr(f"try_element_at(filter(map_entries({record}), e -> {test}), 1).value")


def json_transactions(records: DataFrame, key: str = "file") -> DataFrame:
    """Statement rows from JSON records with loosely named fields."""
    p = lambda *w: picked("record", w)
    debit, credit = parsing.number(p("debit", "withdrawal")), parsing.number(p("credit", "deposit"))
    amt = parsing.number(p("amount", "value"))
    kind = F.upper(F.coalesce(p("type", "drcr", "crdr", "indicator"), F.lit("")))
    minus = (amt < 0) | kind.rlike("^[DW]") | kind.contains("DEBIT")
    return records.select(
        key, "rec_no",
        p("valuedate", "txndate", "transactiondate", "date", "postingdate").alias("date_raw"),
        F.coalesce(p("narration", "description", "remarks", "particulars", "details", "reference"), F.lit("Transaction")).alias("narration"),
        F.when(debit > 0, "DEBIT").when(credit > 0, "CREDIT").when(amt.isNotNull(), F.when(minus, "DEBIT").otherwise("CREDIT")).alias("txn_type"),
        F.when(debit > 0, debit).when(credit > 0, credit).otherwise(F.abs(amt)).alias("amount"),
        parsing.number(p("balance")).alias("balance"),
    ).where("amount is not null")


# ----------------------------------------------------------------- free-text statements

# Patterns of a printed statement line (fixed values).
LINE_DATE = r"^(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\b"
AMOUNT = r"-?\d+(?:,\d{2,3})*\.\d{2}"
FOOTER = (
    r"(?i)\bopening\s+balance\b|\bclosing\s+balance\b|\bclosing\s*:|\bstatement\s+(summary|period)\b"
    r"|\btotal\s+(debit|credit)\b|\bpage\s+\d+\s+of\s+\d+\b|\bgenerated\s+on\b|\btransactions\s*:\s*\d+\b"
)


def text_blocks(text: str) -> Column:
    """Transaction blocks of one statement, as an array, in one fold over its lines inside the JVM.

    The state is the closed blocks, the open one (null if none) and its number of amounts.
    A footer line closes the open block, and so does a dated line once it has two amounts;
    a dated line opens a block, other lines join an open one.
    """
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), tidy), lambda x: x != "")
    none = F.lit(None).cast("string")

    def fold(state: Column, line: Column) -> Column:
        dated = line.rlike(LINE_DATE)
        footer = ~dated & line.rlike(FOOTER)
        closes = footer | (dated & (state["amounts"] >= 2))
        was = F.when(closes, none).otherwise(state["open"])
        before = F.when(closes, 0).otherwise(state["amounts"])
        takes = ~footer & (dated | was.isNotNull())
        return F.struct(
            F.when(closes & state["open"].isNotNull(), F.concat(state["closed"], F.array(state["open"]))).otherwise(state["closed"]).alias("closed"),
            F.when(takes, F.concat_ws(" ", was, line)).otherwise(was).alias("open"),
            F.when(takes, before + F.size(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(0)))).otherwise(before).alias("amounts"),
        )

    start = F.struct(F.array().cast("array<string>").alias("closed"), none.alias("open"), F.lit(0).alias("amounts"))
    end = lambda s: F.when(s["open"].isNotNull(), F.concat(s["closed"], F.array(s["open"]))).otherwise(s["closed"])
    return F.aggregate(lines, start, fold, end)


def text_transactions(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Free-text statements to rows, all in the JVM; one text is the unit of work, the balance direction a window inside it."""
    b = texts.select(
        key, parsing.labelled_amount(text, "opening balance").alias("_open"), F.posexplode(text_blocks(text)).alias("seq", "block")
    )
    amounts = F.transform(
        F.regexp_extract_all("block", F.lit(f"({AMOUNT})"), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit("")).cast("double")
    )
    b = b.withColumn("amts", amounts).where(F.size("amts") >= 2)
    w = W.partitionBy(key).orderBy("seq")
    b = b.withColumn("balance", F.element_at("amts", -1)).withColumn(
        "prev", F.coalesce(F.lag("balance").over(w), F.col("_open"))
    )
    narr = F.regexp_replace("block", r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", "")
    narr = F.regexp_replace(F.regexp_replace(narr, AMOUNT, ""), r"\b\d{10,}\b", "")
    narr = F.btrim(F.regexp_replace(F.regexp_replace(narr, "-{2,}", "-"), r"\s+", " "), F.lit(" -"))
    date = F.regexp_extract("block", LINE_DATE, 1)
    return b.select(
        key, "seq",
        F.when(date != "", date).alias("date_raw"),
        F.when(narr != "", narr).otherwise("Transaction").alias("narration"),
        F.when(F.col("balance") < F.col("prev"), "DEBIT").otherwise("CREDIT").alias("txn_type"),
        F.element_at("amts", -2).alias("amount"),
        "balance",
    )


def label_values(lines: DataFrame, labels: dict[str, str], key: str = "file", least: int = 8) -> DataFrame:
    """Label / value forms: the value is one of the next two lines unless it is a label itself.

    Long result (key, field, value) of the files with at least `least` fields.
    """
    lookup = labels
    table = lines.sparkSession.createDataFrame(list(lookup.items()), "slug string, field string")
    w = W.partitionBy(key).orderBy("line_no")
    # The label list is a fixed table.
    marked = lines.withColumn("slug", parsing.slug("line")).join(F.broadcast(table), "slug", "left")
    nxt = marked.select(
        key, "line_no", "field",
        F.lead("line", 1).over(w).alias("v1"), F.lead("field", 1).over(w).alias("f1"),
        F.lead("line", 2).over(w).alias("v2"), F.lead("field", 2).over(w).alias("f2"),
    ).where("field is not null")
    value = F.when(F.col("f1").isNotNull(), None).when(F.col("v1").isNotNull(), F.col("v1")).when(
        F.col("f2").isNull(), F.col("v2")
    )
    first = (
        nxt.withColumn("value", value).where("value is not null")
        .groupBy(key, "field").agg(F.min_by("value", "line_no").alias("value"))
    )
    enough = first.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(key)
    return first.join(enough, key, "left_semi")


# ----------------------------------------------------------------- admission and scan


def extension(name: str) -> Column:
    return F.when(F.contains(F.col(name), F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def admission(
    files: DataFrame, name: str = "name", content: str = "content", length: str = "length", max_bytes: int | None = None
) -> DataFrame:
    """Add `reason`: why a file is refused, null when it is admitted.  Sizes are not limited unless `max_bytes` is given."""
    ext = extension(name)
    latin = lambda n: F.decode(F.substring(F.col(content), 1, n), "ISO-8859-1")
    whole = F.decode(F.col(content), "ISO-8859-1")
    too_large = F.lit(False) if max_bytes is None else F.col(length) > max_bytes
    is_text = ext.isin("csv", "tsv", "txt", "json", "md")
    return files.withColumn("ext", ext).withColumn(
        "reason",
        F.when(F.col(length) == 0, "empty file")
        .when(too_large, "too large")
        .when(~ext.isin(fixed.ALLOWED_EXTENSIONS), "extension not allowed")
        .when((ext == "pdf") & ~F.ltrim(latin(1024)).startswith("%PDF-"), "not a pdf")
        .when(is_text & (F.instr(whole, "\0") > 0), "binary data in a text file")
        .when((ext == "xlsx") & (latin(2) != "PK"), "not a workbook"),
    )


def lineage(files: DataFrame, content: str = "content", parser: str = "uwspark", version: str = "1") -> DataFrame:
    return files.withColumns(
        {"digest": F.sha2(F.col(content), 256), "parser": F.lit(parser), "parser_version": F.lit(version)}
    )


def delimited_scan(texts: DataFrame, sep: str, key: str = "file", text: str = "text") -> DataFrame:
    """Share of empty cells of a delimited text and the cleanliness drawn from it."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    cells = F.flatten(F.transform(lines, lambda x: F.split(x, f"[{sep}]", -1)))
    total, empty = F.size(cells), F.size(F.filter(cells, lambda x: F.trim(x) == ""))
    missing = F.when(total > 0, empty / total).otherwise(1.0)
    return texts.select(
        key, F.size(lines).cast("bigint").alias("rows"), total.cast("bigint").alias("cells"), empty.cast("bigint").alias("empty_cells"),
        half_even(clip((1 - missing) * 100, 2.0, 99.0)).alias("cleanliness"),
    )


def json_scan(records: DataFrame, key: str = "file") -> DataFrame:
    values = F.map_values("record")
    return records.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.size(values)).alias("fields"),
        F.sum(F.size(F.filter(values, lambda v: v.isNull() | (v == "")))).alias("empty_fields"),
    ).withColumn(
        "cleanliness",
        half_even(clip((1 - F.when(F.col("fields") > 0, F.col("empty_fields") / F.col("fields")).otherwise(0.0)) * 100, 5.0, 99.0)),
    )


def entropy_scan(files: DataFrame, key: str, content: str, length: str, within: int | None = None) -> DataFrame:
    """Shannon entropy of the content (or its first `within` bytes); files without content are left out.

    The 256 byte values are counted inside the row of the file, each in one pass over its bytes.
    """
    data = F.col(content) if within is None else F.substring(F.col(content), 1, within)
    size = F.when(F.col(length) < 2000, 0.5).when(F.col(length) < 20000, 0.85).otherwise(1.0)

    def entropy(text: Column) -> Column:
        # one character a byte
        n = F.length(text)
        counts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: n - F.length(F.replace(text, F.char(b), F.lit(""))))
        share = F.transform(F.filter(counts, lambda k: k > 0), lambda k: k / n)
        return F.aggregate(share, F.lit(0.0), lambda h, p: h - p * F.log2(p))

    ent = files.where(F.octet_length(data) > 0).select(key, length, bound(F.decode(data, "ISO-8859-1"), entropy).alias("h"))
    return ent.select(
        key, half_even("h", 2).alias("entropy"), half_even(clip(F.col("h") / 8 * 100 * size, 8.0, 97.0)).alias("cleanliness")
    )


def completeness(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Share of rows with every key field filled, and mean share of fields filled."""
    full = " and ".join(f"{f} is not null" for f in fields)
    share = " + ".join(f"if({f} is not null, 1, 0)" for f in fields)
    return df.groupBy(key).agg(
        F.expr(f"avg(if({full}, 1.0D, 0.0D))").alias("complete_rows"),
        F.expr(f"avg(({share}) / {float(len(fields))}D)").alias("filled_share"),
    )


def folder_returns(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Return files of a folder merged into one table, and the rows that could not be used."""
    rows = spark.read.csv(glob, header=True, mode="PERMISSIVE").withColumn("file", F.input_file_name())
    rows = rows.toDF(*[normalised_header(c) for c in rows.columns])
    has = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    known = [c for c in rows.columns if c not in ("file",)]
    keys = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in known]))
    out = rows.withColumns(
        {
            "gstin": F.upper(F.trim(F.coalesce(has("gstin"), has("gst_number"), has("gstn")))),
            "period": parsing.tax_period(F.coalesce(has("period"), has("tax_period"), has("return_period"))),
            "return_type": parsing.return_type(keys, has("return_type")),
        }
    )
    ok = F.col("gstin").isNotNull() & F.col("period").isNotNull() & F.col("return_type").isNotNull()
    return out.where(ok), out.where(~ok)
