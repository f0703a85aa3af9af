"""Folders of mixed files: one scan, every file read by its own form, one error row per bad file.

A file is one row (file, content), as the binary file source gives it.  Its form is sniffed from
name and content; delimited texts keep quoted fields, with delimiters, quotes and line ends inside
them.  All parsing is done by expressions inside the JVM, and a file that cannot be used becomes a
row of the report instead of a failed job.  Very large single tables are read with
`files.read_table`, which splits them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import parsing
from ..functions.columns import bound
from . import files as sources

#: The delimiter is the most frequent one of so many leading characters (fixed value).
SNIFFED = 4096
PAYMENT_WRAPPERS = ("transactions", "records", "data", "rows", "upi", "items")
RETURN_WRAPPERS = ("returns", "records", "data", "rows", "filings", "items")

# Printed column of a payment statement -> canonical field (fixed values).
PAYMENT_LABELS = {
    "transaction_id": ("transaction_id", "txn_id", "rrn", "upi_ref_no", "reference_no", "utr"),
    "date": ("date", "txn_date", "transaction_date"),
    "time": ("time", "txn_time", "transaction_time"),
    "type": ("type", "txn_type", "transaction_type", "debit_credit"),
    "amount": ("amount", "txn_amount", "transaction_amount", "amount_inr"),
    "payer_vpa": ("payer_vpa", "from_vpa", "sender_vpa"),
    "payer_name": ("payer_name", "from_name", "sender_name"),
    "payee_vpa": ("payee_vpa", "to_vpa", "receiver_vpa"),
    "payee_name": ("payee_name", "to_name", "receiver_name", "merchant_name"),
    "mode": ("mode", "txn_mode", "payment_mode"),
    "mcc": ("mcc", "merchant_category_code", "category_code"),
    "status": ("status", "txn_status", "transaction_status"),
    "remarks": ("remarks", "note", "narration", "description"),
}
RETURN_EXTRAS = (
    "legal_name", "trade_name", "gst_status", "registration_date", "constitution", "filing_frequency", "return_status",
)

# A field is quoted, with doubled quotes inside, or runs to the next delimiter; § stands for the delimiter.
FIELD = r'(?:"(?:[^"]++|"")*+"[^§\r\n]*+|[^§\r\n]*+)'
RECORD = FIELD + "(?:[§]" + FIELD + ")*+"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, length, content) of all files below `path`; Spark's file sources pass over empty ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.substring_index("path", "/", -1).alias("name"), "length", "content")


def sniffed(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds `reason` (why a file is refused, else null), `text`, `form` (json or delimited) and `sep`.

    Bytes that are no UTF-8 are left out of the text, and so is a byte order mark.
    """
    checked = sources.admission(files, max_bytes=max_bytes)
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    out = checked.withColumn("text", F.when(F.col("reason").isNull(), valid))
    # most texts hold neither, and a look for them is cheaper than a pass over all characters
    decoded = F.when(F.contains("text", F.lit("�")), F.translate("text", "�", "")).otherwise(F.col("text"))
    out = out.withColumn("text", decoded)
    out = out.withColumn("text", F.when(F.startswith("text", F.lit("﻿")), F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")))
    is_json = (F.col("ext") == "json") | F.ltrim("text").substr(1, 1).isin("[", "{")
    other = F.col("ext").isin("pdf", "html", "htm", "xlsx", "xls", "png", "jpg", "jpeg", "docx", "zip")
    out = out.withColumn("reason", F.coalesce("reason", F.when(other, "no table in a file of this kind")))
    return out.withColumn("form", F.when(F.col("reason").isNull(), F.when(is_json, "json").otherwise("delimited"))).withColumn(
        "sep", F.when(F.col("form") == "delimited", sources.frequent_delimiter("text", SNIFFED))
    )


def cells(record: Column, sep: Column) -> Column:
    """Fields of one record as an array, quotes taken off."""
    pattern = F.replace(F.lit(f"[§]({FIELD})"), F.lit("§"), sep)
    unquoted = lambda x: F.when(
        x.startswith('"') & x.rlike('(?s)^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(x)
    return F.transform(F.regexp_extract_all(F.concat(sep, record), pattern, F.lit(1)), unquoted)


def delimited_records(texts: DataFrame, key: str = "file") -> DataFrame:
    """(key, rec_no, record): header -> cell of every line below the first; lines of rules and blanks are left out.

    Cells that a short line lacks are null, cells beyond the header are dropped; of two columns with
    one header the later one counts.
    """
    pattern = F.replace(F.lit(RECORD), F.lit("§"), F.col("sep"))
    lines = F.filter(F.regexp_extract_all("text", pattern, F.lit(0)), lambda x: F.trim(x) != "")
    # header and lines leave the file together, so the text is cut once
    opened = texts.select(
        key,
        "sep",
        F.inline(F.array(bound(lines, lambda x: F.struct(F.try_element_at(x, F.lit(1)).alias("_top"), F.slice(x, 2, F.size(x) + 1).alias("_lines"))))),
    )
    # which cells make the record is settled once a file: the last one of a header that is not empty
    headed = opened.select(key, bound(cells(F.col("_top"), F.col("sep")), lambda h: F.transform(h, parsing.slug)).alias("_head"), "sep", "_lines")
    last = lambda h, i: (h != "") & ~F.array_contains(F.slice(F.col("_head"), i + 2, F.size("_head")), h)
    spots = F.filter(F.sequence(F.lit(1), F.size("_head")), lambda i: last(F.element_at("_head", i), i - 1))
    headed = headed.withColumn("_spots", F.when(F.size("_head") > 0, spots).otherwise(F.array().cast("array<int>")))
    headed = headed.withColumn("_keys", F.transform("_spots", lambda i: F.element_at("_head", i)))
    rows = headed.select(key, "sep", "_spots", "_keys", F.posexplode("_lines").alias("rec_no", "_line"))
    rule = lambda x: F.coalesce(x, F.lit("")).rlike(r"^[-:\s]*$")
    record = lambda c: F.map_from_arrays("_keys", F.transform("_spots", lambda i: F.try_element_at(c, i)))
    found = F.array_compact(F.array(bound(cells(F.col("_line"), F.col("sep")), lambda c: F.when(F.exists(c, lambda x: ~rule(x)), record(c)))))
    return rows.select(key, "rec_no", F.explode(found).alias("record"))


def _mapped(pairs: Column) -> Column:
    """Pairs with a key as a map, the last one of a key; `pairs` is bound."""
    last = F.filter(pairs, lambda p, i: (F.coalesce(p["key"], F.lit("")) != "") & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"].eqNullSafe(p["key"])))
    return F.map_from_entries(last)


def records(files: DataFrame, wrappers: Sequence[str], max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, rec_no, record) of all files, and the sniffed files; record keys are slugs of the headers."""
    seen = sniffed(files, max_bytes)
    table = delimited_records(seen.where("form = 'delimited'"))
    return table.unionByName(_objects(seen.where("form = 'json'"), wrappers)), seen


def _objects(texts: DataFrame, wrappers: Sequence[str]) -> DataFrame:
    """(file, rec_no, record) of JSON files; the keys of the first record are turned into slugs once a file, for all records that have the same."""
    own = lambda r: F.struct(r.alias("_records"), F.map_keys(F.try_element_at(r, F.lit(1))).alias("_own"))
    opened = texts.select("file", F.inline(F.array(bound(sources.json_arrays("text", wrappers), own))))
    opened = opened.withColumn("_slugs", F.transform("_own", parsing.slug))
    plain = (F.size(F.array_distinct("_slugs")) == F.size("_slugs")) & ~F.array_contains("_slugs", F.lit(""))
    rows = opened.withColumn("_plain", plain).select("file", "_own", "_slugs", "_plain", F.posexplode("_records").alias("rec_no", "_record"))
    rows = rows.where("_record is not null")
    entries = F.transform(F.map_entries("_record"), lambda e: F.struct(parsing.slug(e["key"]).alias("key"), e["value"].alias("value")))
    alike = F.col("_plain") & (F.map_keys("_record") == F.col("_own"))
    record = F.when(alike, F.map_from_arrays("_slugs", F.map_values("_record"))).otherwise(bound(entries, _mapped))
    return rows.select("file", "rec_no", record.alias("record"))


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def payment_rows(recs: DataFrame) -> DataFrame:
    """Typed payment rows: those with date, amount and type; blanks are null, the rest gets its defaults.

    Of several columns of one field the last one in the file counts.
    """
    columns = F.map_keys("record")

    def field(name: str) -> Column:
        known = F.array(*[F.lit(x) for x in PAYMENT_LABELS[name]])
        hits = F.filter(columns, lambda k: F.array_contains(known, k))
        return F.try_element_at("record", F.try_element_at(hits, F.lit(-1)))

    raw = recs.select("file", "rec_no", *[field(f).alias(f) for f in PAYMENT_LABELS])
    typed = raw.select(
        "file",
        "rec_no",
        _text(F.col("transaction_id")).alias("transaction_id"),
        F.when(F.col("date") != "", F.trim("date")).alias("date"),
        _text(F.col("time")).alias("time"),
        parsing.payment_type("type").alias("type"),
        F.round(parsing.first_number("amount"), 2).alias("amount"),
        *[_text(F.col(c)).alias(c) for c in ("payer_vpa", "payer_name", "payee_vpa", "payee_name")],
        parsing.payment_mode("mode", "mcc").alias("mode"),
        F.when(F.col("mcc") != "", F.trim("mcc")).alias("mcc"),
        parsing.payment_status("status").alias("status"),
        _text(F.col("remarks")).alias("remarks"),
    )
    return typed.where("date is not null and amount is not null and type is not null")


def return_rows(recs: DataFrame) -> DataFrame:
    """Typed return rows: identifier, period, type and the amounts of that type; rows without one of the three go.

    Dates stay text cells until `tax_date` reads them; amounts are numbers or null.
    """
    at = lambda r, k: F.try_element_at(r, F.lit(k))
    blank = lambda v: F.trim(v).isin("", "nan", "NA", "None")
    filled = lambda r, *names: F.coalesce(*[F.nullif(at(r, n), F.lit("")) for n in names])

    def head(r: Column) -> Column:
        return F.struct(
            F.upper(F.trim(filled(r, "gstin", "gst_number", "gstn"))).alias("gstin"),
            parsing.tax_period(filled(r, "period", "tax_period", "return_period")).alias("period"),
            parsing.return_type(F.map_keys(r), at(r, "return_type")).alias("return_type"),
        )

    # bound: written out side by side they make a method so long that the JVM does not compile it;
    # the head is an array of one struct, so that the filter does not work it out a second time
    typed = recs.select("file", "rec_no", "record", F.inline(F.array(bound(F.col("record"), head)))).where(
        "gstin is not null and period is not null and return_type is not null"
    )
    r = F.col("record")
    fields = sorted({f for fs in parsing.RETURN_FIELDS.values() for f in fs})
    owners = {f: [t for t, fs in parsing.RETURN_FIELDS.items() if f in fs] for f in fields}
    raw = typed.select(
        "file", "rec_no", "gstin", "period", "return_type",
        *[F.when(F.col("return_type").isin(owners[f]), at(r, f)).alias(f) for f in fields], *[filled(r, x).alias(x) for x in RETURN_EXTRAS],
    )

    text = lambda v: F.when(~blank(v), v)
    amount = lambda v: F.when(~blank(v), parsing.number(v))
    dated = raw.withColumns({f: bound(F.col(f), text if f.endswith("_date") else amount) for f in fields})
    return dated.withColumns({f: parsing.tax_date(f) for f in fields if f.endswith("_date")})


def report(seen: DataFrame, recs: DataFrame, used: DataFrame) -> DataFrame:
    """(file, form, sep, records, used, error): one row per file, `error` null where rows were taken."""
    count = lambda df, name: df.groupBy("file").agg(F.count(F.lit(1)).alias(name))
    out = seen.select("file", "form", "sep", "reason").join(count(recs, "records"), "file", "left").join(count(used, "used"), "file", "left")
    out = out.na.fill(0, ["records", "used"])
    error = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("records") == 0, "no records found")
        .when(F.col("used") == 0, "no usable row")
    )
    return out.select("file", "form", "sep", "records", "used", error.alias("error"))


def payments(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Payment rows of a folder, and its report."""
    recs, seen = records(files, PAYMENT_WRAPPERS, max_bytes)
    rows = payment_rows(recs)
    return rows, report(seen, recs, rows)


def returns(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return rows of a folder merged over its files, and its report."""
    recs, seen = records(files, RETURN_WRAPPERS, max_bytes)
    rows = return_rows(recs)
    return rows, report(seen, recs, rows)


def folder_summary(rows: DataFrame) -> DataFrame:
    """One row for a folder of returns: records, businesses and how many returns of each type."""
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("gstin").alias("businesses"),
        F.count_distinct("file").alias("files"),
        *[F.count_if(F.col("return_type") == t).alias(t.lower()) for t in parsing.RETURN_FIELDS],
    )
