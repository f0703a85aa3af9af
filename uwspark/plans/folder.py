"""Folders of mixed files, written from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import half_even
from ..operators import gst
from ..sources import folder
from ..sources.adapters import gst_return, read
from ..staging import shared, stage
from . import oracle
from .registry import query
from .sources import AS_OF

#: Forms of the files by key: quoted commas, tabs, quoted semicolons, pipe table, wrapped and bare JSON.
FORMS = ["csv", "tsv", "csv", "md", "json", "json"]


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _file(k: Column, kind: Column, head: list[str], row: list[Column], lines: Column, wrapper: str) -> tuple[Column, Column]:
    """Name and text of the file of key `k`: `lines` are structs with the fields `row`, printed in the form `kind`."""

    def text(sep: str, quote: bool, edge: str = "") -> Column:
        cell = lambda x, f: _quoted(x[f]) if quote else x[f]
        printed = F.transform(lines, lambda x: F.concat(F.lit(edge), F.concat_ws(sep, *[cell(x, f) for f in row]), F.lit(edge)))
        top = [edge + sep.join(head) + edge]
        if edge:
            top.append("|".join(["", *["---"] * len(head), ""]))
        return F.concat_ws("\r\n" if quote else "\n", F.array(*[F.lit(t) for t in top]), printed)

    objects = F.transform(lines, lambda x: F.struct(*[x[f].alias(h) for f, h in zip(row, head)]))
    forms = [text(",", True), text("\t", False), text(";", True), text("|", False, "|")]
    forms += [F.to_json(F.struct(objects.alias(wrapper))), F.to_json(objects)]
    out = F.element_at(F.array(*[F.lit(x) for x in FORMS]), (kind + 1).cast("int"))
    body = None
    for i, f in enumerate(forms):
        body = F.when(kind == i, f) if body is None else body.when(kind == i, f)
    bad = (
        F.when(k % 23 == 1, F.struct(F.lit("txt").alias("ext"), F.lit("nothing but prose\n").alias("text")))
        .when(k % 29 == 1, F.struct(F.lit("pdf").alias("ext"), F.lit("%PDF-1.7 pages").alias("text")))
        .when(k % 31 == 1, F.struct(F.lit("csv").alias("ext"), F.lit("").alias("text")))
        .when(k % 37 == 1, F.struct(F.lit("json").alias("ext"), F.lit('[{"date": ').alias("text")))
        .when(k % 41 == 1, F.struct(F.lit("exe").alias("ext"), F.lit("MZ").alias("text")))
    )
    return F.concat(F.lit("f"), k.cast("string"), F.lit("."), F.coalesce(bad["ext"], out)), F.coalesce(bad["text"], body)


def _binary(df: DataFrame, name: Column, text: Column) -> DataFrame:
    data = F.encode(text, "UTF-8")
    return df.select(name.alias("file"), name.alias("name"), data.alias("content"), F.octet_length(data).cast("bigint").alias("length"))


PAY_HEAD = ["Txn ID", "Transaction Date", "Debit/Credit", "Amount (INR)", "To VPA", "Merchant Name", "MCC", "Txn Status", "Narration"]
PAY_ROW = ["id", "date", "type", "amount", "vpa", "payee", "mcc", "status", "note"]


def payment_files(spark, sf_dir) -> DataFrame:
    """One file per customer with a line per order."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    payee = F.concat(F.lit('Shop "A", B; '), F.when(F.col("o_custkey") % 6 == 2, "C|D ").when(F.col("o_custkey") % 6 == 0, "E\nF ").otherwise(""), "o_orderpriority")
    line = F.struct(
        F.concat(F.lit("T"), k.cast("string")).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        pick(["DEBIT", "CR", "sent", "Received", "unknown", ""]).alias("type"),
        F.when(k % 9 == 0, "n/a").otherwise(F.concat(F.lit("₹"), F.format_number("o_totalprice", 2))).alias("amount"),
        F.concat(F.lit("m"), (k % 20).cast("string"), F.lit("@upi")).alias("vpa"),
        payee.alias("payee"),
        F.when(k % 3 == 0, "5411").otherwise("").alias("mcc"),
        pick(["success", "FAILED", "odd", "", "Pending"]).alias("status"),
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")).alias("note"),
    )
    files = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), line.alias("l")))).alias("all"))
    lines = F.transform("all", lambda x: x["l"])
    return _binary(files, *_file(F.col("o_custkey"), F.col("o_custkey") % 6, PAY_HEAD, PAY_ROW, lines, "transactions"))


def payments_read(spark, sf_dir):
    """(rows, report) of the payment folder, staged once a session."""
    files = shared(spark, sf_dir, "payment_files", lambda: payment_files(spark, sf_dir))
    return folder.payments(files)


_BAD = "c % 23 = 1 OR c % 29 = 1 OR c % 31 = 1 OR c % 37 = 1 OR c % 41 = 1"
_NAME = """'f' || c || '.' || CASE WHEN c % 23 = 1 THEN 'txt' WHEN c % 29 = 1 THEN 'pdf' WHEN c % 31 = 1 THEN 'csv' WHEN c % 37 = 1 THEN 'json' WHEN c % 41 = 1 THEN 'exe'
  ELSE ['csv', 'tsv', 'csv', 'md', 'json', 'json'][CAST(c % 6 + 1 AS INTEGER)] END"""
_PAID = f"""SELECT {_NAME} AS file, c, k, 'T' || k AS transaction_id, strftime(o_orderdate, '%Y-%m-%d') AS "date", ['DEBIT', 'CREDIT', 'DEBIT', 'CREDIT'][CAST(k % 6 + 1 AS INTEGER)] AS type,
    CASE WHEN k % 9 <> 0 THEN round(o_totalprice, 2) END AS amount, 'm' || (k % 20) || '@upi' AS payee_vpa,
    'Shop "A", B; ' || CASE c % 6 WHEN 2 THEN 'C|D ' WHEN 0 THEN 'E' || chr(10) || 'F ' ELSE '' END || o_orderpriority AS payee_name,
    CASE WHEN k % 3 = 0 THEN 'P2M' ELSE 'P2P' END AS mode, CASE WHEN k % 3 = 0 THEN '5411' END AS mcc,
    ['SUCCESS', 'FAILED', 'SUCCESS', 'SUCCESS', 'PENDING'][CAST(k % 5 + 1 AS INTEGER)] AS status, o_orderstatus AS remarks
  FROM (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders)"""


@query(
    "a18_b02_b07_payment_folder",
    f"""SELECT file, transaction_id, "date", type, amount, payee_vpa, payee_name, mode, mcc, status, remarks FROM ({_PAID}) WHERE NOT ({_BAD}) AND type IS NOT NULL AND amount IS NOT NULL""",
)
def payment_folder(spark, sf_dir):
    rows, _ = payments_read(spark, sf_dir)
    return rows.drop("rec_no", "time", "payer_vpa", "payer_name")


@query(
    "a18_payment_folder_report",
    f"""SELECT file, CASE WHEN c % 23 = 1 THEN 'delimited' WHEN c % 29 = 1 OR c % 31 = 1 OR c % 41 = 1 AND c % 37 <> 1 THEN NULL WHEN c % 37 = 1 OR c % 6 IN (4, 5) THEN 'json' ELSE 'delimited' END AS form,
      CASE WHEN c % 23 = 1 THEN chr(9) WHEN {_BAD} OR c % 6 IN (4, 5) THEN NULL ELSE [',', chr(9), ';', '|'][CAST(c % 6 + 1 AS INTEGER)] END AS sep,
      CASE WHEN {_BAD} THEN 0 ELSE count(*) END AS records, CASE WHEN {_BAD} THEN 0 ELSE count(*) FILTER (type IS NOT NULL AND amount IS NOT NULL) END AS used,
      CASE WHEN c % 23 = 1 THEN 'no records found' WHEN c % 29 = 1 THEN 'no table in a file of this kind' WHEN c % 31 = 1 THEN 'empty file' WHEN c % 37 = 1 THEN 'no records found'
        WHEN c % 41 = 1 THEN 'extension not allowed' WHEN count(*) FILTER (type IS NOT NULL AND amount IS NOT NULL) = 0 THEN 'no usable row' END AS error
    FROM ({_PAID}) GROUP BY file, c""",
)
def payment_report(spark, sf_dir):
    return payments_read(spark, sf_dir)[1]


# ------------------------------------------------------------------ tax returns

RETURN_HEAD = {
    "GSTIN": "gstin", "Tax Period": "period", "Return Type": "return_type", "Filing Date": "filing_date", "Due Date": "due_date",
    "Taxable Value": "taxable_value", "B2B Value": "b2b_value", "B2C Value": "b2c_value", "Export Value": "export_value",
    "B2B Invoice Count": "b2b_invoice_count", "Unique Buyer Count": "unique_buyer_count", "Top Buyer Value": "top_buyer_value",
    "Outward Taxable Value": "outward_taxable_value", "Outward IGST": "outward_igst", "ITC Total": "itc_total",
    "ITC Reversed": "itc_reversed", "ITC Available Total": "itc_available_total", "Supplier Count": "supplier_count",
}


def return_files(spark, sf_dir) -> DataFrame:
    """One file per business with a line per return, in the same forms as the payment files."""
    r = gst_return(spark, sf_dir).withColumn("k", F.substring("gstin", 4, 10).cast("bigint"))
    names = list(RETURN_HEAD.values())
    # a printed number keeps all its digits
    line = F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])
    # the returns move as numbers and are printed where their file is made
    files = r.repartition("k").groupBy("k").agg(F.sort_array(F.collect_list(line)).alias("all"))
    return _binary(files, *_file(F.col("k"), F.col("k") % 6, list(RETURN_HEAD), names, F.col("all"), "returns"))


def returns_read(spark, sf_dir):
    files = shared(spark, sf_dir, "return_files", lambda: return_files(spark, sf_dir))
    return folder.returns(files)


oracle.block(
    "x_returns",
    """SELECT gstin, period, 'GSTR1' AS return_type, NULL::DATE AS filing_date, NULL::DATE AS due_date, taxable AS taxable_value, b2b AS b2b_value, b2c AS b2c_value,
      export AS export_value, b2b_n AS b2b_invoice_count, buyers AS unique_buyer_count, top AS top_buyer_value, NULL::DOUBLE AS outward_taxable_value,
      NULL::DOUBLE AS outward_igst, NULL::DOUBLE AS itc_total, NULL::DOUBLE AS itc_reversed, NULL::DOUBLE AS itc_available_total, NULL::DOUBLE AS supplier_count FROM x_gst_p
    UNION ALL SELECT gstin, period, 'GSTR3B', CAST(due + CAST(days_late AS INTEGER) AS DATE), CAST(due AS DATE), NULL, NULL, NULL, NULL, NULL, NULL, NULL, outward, igst, itc, itc_rev, NULL, NULL FROM x_gst_p WHERE kept > 0
    UNION ALL SELECT gstin, period, 'GSTR2B', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, itc_avail, CAST(parts AS DOUBLE) FROM x_gst_p""",
)
_GOOD = "c % 23 <> 1 AND c % 29 <> 1 AND c % 31 <> 1 AND c % 37 <> 1 AND c % 41 <> 1"
_RETURNS = f"(SELECT *, {_NAME} AS file FROM (SELECT *, CAST(substr(gstin, 4, 10) AS BIGINT) AS c FROM x_returns)) WHERE {_GOOD}"


@query("a18_return_folder", f"SELECT file, {', '.join(RETURN_HEAD.values())} FROM {_RETURNS}")
def return_folder(spark, sf_dir):
    rows, _ = returns_read(spark, sf_dir)
    return rows.select("file", *RETURN_HEAD.values())


@query(
    "a18_return_folder_summary",
    f"""SELECT count(*) AS records, count(DISTINCT gstin) AS businesses, count(DISTINCT file) AS files,
      {', '.join(f"count(*) FILTER (return_type = '{t}') AS {t.lower()}" for t in ('GSTR1', 'GSTR3B', 'GSTR2A', 'GSTR2B'))} FROM {_RETURNS}""",
)
def return_summary(spark, sf_dir):
    return folder.folder_summary(returns_read(spark, sf_dir)[0])


@query(
    "a18_return_folder_profiles",
    f"""SELECT gstin, round_even(annualised_gst_turnover, 2) AS annualised_gst_turnover, missed_return_count, late_return_count FROM x_gst_profile
      WHERE gstin IN (SELECT gstin FROM {_RETURNS})""",
)
def return_profiles(spark, sf_dir):
    """The folder rolled up: one tax profile per business, from the returns of its files."""
    rows = stage(returns_read(spark, sf_dir)[0])
    p = gst.profiles(rows.select(*RETURN_HEAD.values()), AS_OF)
    return p.select("gstin", half_even("annualised_gst_turnover", 2).alias("annualised_gst_turnover"), "missed_return_count", "late_return_count")
