"""File sources on small hand-made files."""

import datetime as dt

from uwspark.functions import parsing
from uwspark.sources import files


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_delimited_statement_with_preamble(spark):
    text = "HDFC Bank\nAccount Holder: A B\nTxn Date;Narration;Debit;Credit;Balance\n01/02/2024;UPI X;100.50;;900\n02 Feb 2024;SALARY;;5,000.00;5900\n;;;;\n"
    t = spark.createDataFrame([("f", text)], "file string, text string")
    out = files.statement_cells(files.line_table(t)).orderBy("line_no")
    assert rows(out, "narration", "txn_type", "amount", "balance", "txn_date") == [
        ("UPI X", "DEBIT", 100.5, 900.0, dt.date(2024, 2, 1)), ("SALARY", "CREDIT", 5000.0, 5900.0, dt.date(2024, 2, 2)),
    ]


def test_text_statement_blocks(spark):
    text = (
        "Opening Balance: 1,000.00\n01/01/2024 POS SHOP\n  100.00 900.00\n02/01/2024 NEFT IN 50.00\n950.00\n"
        "03/01/2024 ATM 200.00 750.00\nPage 1 of 1\nnoise 5.00 6.00\n"
    )
    t = spark.createDataFrame([("f", text)], "file string, text string")
    out = files.text_transactions(t).orderBy("seq")
    assert rows(out, "date_raw", "narration", "txn_type", "amount", "balance") == [
        ("01/01/2024", "POS SHOP", "DEBIT", 100.0, 900.0),
        ("02/01/2024", "NEFT IN", "CREDIT", 50.0, 950.0),
        ("03/01/2024", "ATM", "DEBIT", 200.0, 750.0),
    ]


def test_json_shapes(spark):
    texts = [("a", '[{"date":"01/01/2024","amount":"-5"}]'), ("b", '{"data":[{"txnDate":"x","debit":"7"},{"credit":"8"}]}'), ("c", '{"amount":"1,000"}')]
    t = spark.createDataFrame(texts, "file string, text string")
    out = files.json_transactions(files.json_records(t, ["transactions", "data"])).orderBy("file", "rec_no")
    assert rows(out, "file", "txn_type", "amount") == [("a", "DEBIT", 5.0), ("b", "DEBIT", 7.0), ("b", "CREDIT", 8.0), ("c", "CREDIT", 1000.0)]


def test_admission_reasons(spark):
    data = [("a.csv", b""), ("a.exe", b"x"), ("a.pdf", b"nope"), ("b.pdf", b"  %PDF-1.7"), ("a.txt", b"ab\x00c"), ("a.xlsx", b"zip"), ("b.xlsx", b"PK\x03"), ("ok.json", b"{}")]
    f = spark.createDataFrame([(n, bytearray(c), len(c)) for n, c in data], "name string, content binary, length int")
    assert dict(rows(files.admission(f), "name", "reason")) == {
        "a.csv": "empty file", "a.exe": "extension not allowed", "a.pdf": "not a pdf", "b.pdf": None,
        "a.txt": "binary data in a text file", "a.xlsx": "not a workbook", "b.xlsx": None, "ok.json": None,
    }


def test_folder_of_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("GSTIN,Period,taxable_value,b2b_value\n27abc,2024-1,100,60\n,2024-2,5,5\n")
    good, bad = files.folder_returns(spark, str(tmp_path / "*.csv"))
    assert rows(good, "gstin", "period", "return_type") == [("27ABC", "2024-01", "GSTR1")]
    assert bad.count() == 1


def test_table_header_is_normalised(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" Customer Id ,Age\n1,2\n")
    assert files.read_table(spark, str(tmp_path / "t.csv")).columns == ["customer_id", "age"]


def test_label_form_needs_enough_fields(spark):
    body = "GSTIN\n27X\nLegal Name\nAcme\nGST Status\nACTIVE\nMonthly Turnover\nB2B Sales\n5\nITC Claimed\n6\nMissed Returns\n0\nFiling Frequency\nMONTHLY\nNet ITC\n3"
    t = spark.createDataFrame([("f", body), ("g", "GSTIN\n1")], "file string, text string")
    got = dict(rows(files.label_values(files.line_table(t), parsing.TAX_LABELS), "field", "value"))
    assert got["gstin"] == "27X" and got["b2b_sales_amount"] == "5" and "monthly_turnover" not in got and len(got) == 8


def test_dates(spark):
    cases = {
        "01/02/2024": dt.date(2024, 2, 1), "1-2-24": dt.date(2024, 2, 1), "2024/02/01": dt.date(2024, 2, 1), "1 Feb 2024": dt.date(2024, 2, 1),
        "Feb 1, 2024": dt.date(2024, 2, 1), "31 Sept 24": dt.date(2024, 9, 28), "31/02/2024": None, "junk": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", parsing.statement_date("raw").alias("d"))
    assert {r.raw: r.d for r in df.collect()} == cases


def test_entropy_of_bytes(spark):
    import collections
    import math
    import random

    rnd = random.Random(8)
    contents = [bytes(rnd.randrange(256) for _ in range(n)) for n in (1, 5, 300, 2500, 30000)] + [b"", bytes(range(256)), b"\x00" * 50]
    df = spark.createDataFrame([(i, bytearray(d), len(d)) for i, d in enumerate(contents)], "f int, content binary, length int")
    got = {r.f: r.entropy for r in files.entropy_scan(df, "f", "content", "length").collect()}
    assert set(got) == {i for i, d in enumerate(contents) if d}
    for i, d in enumerate(contents):
        if d:
            want = -sum(v / len(d) * math.log2(v / len(d)) for v in collections.Counter(d).values())
            assert abs(got[i] - want) <= 0.0051
