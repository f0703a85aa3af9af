"""Folders of mixed files against Python's csv and json readers."""

import csv
import io
import json
import random

from uwspark.sources import folder

HEAD = ["Txn ID", "Date", "Type", "Amount", "Merchant Name", "MCC", "Mode", "Status", "Remarks", "Date"]


def rows_of(text, sep):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return rows[0], rows[1:]


def brute_cells(text, sep):
    head, rows = rows_of(text, sep)
    slugs = ["_".join(w for w in "".join(c if c.isalnum() else " " for c in h.lower()).split()) for h in head]
    return [{s: (r[i] if i < len(r) else None) for i, s in enumerate(slugs) if s} for r in rows]


def write(tmp_path, files):
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path)


def test_cells_like_the_csv_module(spark, tmp_path):
    rnd = random.Random(11)
    words = ["a", "b c", 'say ""x""', "x,y", "p;q", "t\tu", "m|n", "line\nend", "", " pad ", "é₹", 'in"side']
    texts = {}
    for i in range(40):
        sep = "\t,;|"[i % 4]
        head = ["h1", "H 2!", "", "h3", "h3"]
        lines = [sep.join(head)]
        for _ in range(6):
            cells = []
            for _ in range(rnd.choice([3, 5, 6])):
                w = rnd.choice(words)
                plain = not set(w) & set('\t,;|\n"') or w == 'in"side'
                cells.append(w if plain and rnd.random() < 0.7 else '"' + w.replace('""', '"').replace('"', '""') + '"')
            lines.append(sep.join(cells))
        texts[f"f{i}.csv"] = (sep * 9).join(["", ""]) and rnd.choice(["\n", "\r\n"]).join(lines) + "\n"
    path = write(tmp_path, texts)
    got = {}
    seps = {}
    recs, seen = folder.records(folder.read_folder(spark, path), ())
    for r in seen.collect():
        seps[r.name] = r.sep
    for r in sorted(recs.collect(), key=lambda r: (r.file, r.rec_no)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.record)
    for name, text in texts.items():
        want = [w for w in brute_cells(text, seps[name]) if any(set(str(v).strip()) - set("-: ") for v in w.values() if v)]
        # extra cells can keep a line whose named cells are empty
        mine = [g for g in got.get(name, []) if any(set(str(v).strip()) - set("-: ") for v in g.values() if v)]
        assert mine == want, name


def test_payment_folder(spark, tmp_path):
    row = '"T1",2024-01-02,Sent,"₹1,234.567",Shop; A,5411,,ok?, note ,2024-01-03'
    files = {
        "a/one.csv": ",".join(HEAD) + "\n" + row + "\n\n,,,,,,,,,\nT2,2024-01-05,x,9,,,,,,2024-01-05\nT3,2024-01-05,credit,none,,,,,,2024-01-05\n",
        "bom.txt": "﻿date\ttype\tamount\n05/01/2024\tCR\t-7\n",
        "table.md": "| Date | Type | Amount |\n|:--|---|--:|\n| 2024-02-01 | dr | 5.5 |\n",
        "wrapped.json": json.dumps({"meta": 1, "records": [{"Txn Date": "2024-03-01", "Txn Type": "DEBIT", "Txn Amount": 12.5, "mcc": None}]}),
        "bare.json": json.dumps([{"date": "2024-03-02", "type": "C", "amount": "3"}, {"date": "", "type": "C", "amount": "3"}]),
        "single.txt": json.dumps({"date": "2024-03-03", "type": "R", "amount": "1e"}),
        "broken.json": '[{"date": "2024',
        "binary.csv": b"date,type\x00,amount\n1,2,3\n",
        "latin.csv": "date;type;amount;remarks\n2024-04-01;D;4;caf".encode() + b"\xe9\n",
        "prose.txt": "just words\nand more of them\n",
        "head_only.csv": "date,type,amount\n",
        "none.csv": "",
        "scan.pdf": b"%PDF-1.4",
        "tool.exe": b"MZ",
    }
    rows, report = folder.payments(folder.read_folder(spark, write(tmp_path, files)))
    by_file = {}
    for r in rows.collect():
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append(r)
    assert {k: [(str(r.date), r.type, r.amount) for r in v] for k, v in by_file.items()} == {
        "one.csv": [("2024-01-03", "DEBIT", 1234.57)],
        "bom.txt": [("05/01/2024", "CREDIT", 7.0)],
        "table.md": [("2024-02-01", "DEBIT", 5.5)],
        "wrapped.json": [("2024-03-01", "DEBIT", 12.5)],
        "bare.json": [("2024-03-02", "CREDIT", 3.0)],
        "single.txt": [("2024-03-03", "CREDIT", 1.0)],
        "latin.csv": [("2024-04-01", "DEBIT", 4.0)],
    }
    one = by_file["one.csv"][0]
    assert (one.transaction_id, one.payee_name, one.mcc, one.mode, one.status, one.remarks) == ("T1", "Shop; A", "5411", "P2M", "SUCCESS", "note")
    assert by_file["latin.csv"][0].remarks == "caf"
    errors = {r.file.rsplit("/", 1)[1]: r.error for r in report.collect()}
    assert {k: v for k, v in errors.items() if v} == {
        "broken.json": "no records found",
        "binary.csv": "binary data in a text file",
        "prose.txt": "no usable row",
        "head_only.csv": "no records found",
        "scan.pdf": "no table in a file of this kind",
        "tool.exe": "extension not allowed",
    }


def test_return_folder(spark, tmp_path):
    files = {
        "g1.csv": "GST Number,Tax Period,Taxable Value,B2B Value,Filing Date\n 27abc ,2024-1,\"1,000.5\",NA,01/02/2024\n,2024-01,1,1,\n27abc,no,1,1,\n",
        "g3.json": json.dumps({"filings": [{"gstin": "27ABC", "return_period": "01-2024", "return_type": "gstr-3b", "net_itc": "5", "taxable_value": "9"}]}),
        "unknown.csv": "gstin,period,colour\n27ABC,2024-01,red\n",
    }
    rows, report = folder.returns(folder.read_folder(spark, write(tmp_path, files)))
    got = {(r.gstin, r.period, r.return_type): r for r in rows.collect()}
    assert set(got) == {("27ABC", "2024-01", "GSTR1"), ("27ABC", "2024-01", "GSTR3B")}
    first, third = got["27ABC", "2024-01", "GSTR1"], got["27ABC", "2024-01", "GSTR3B"]
    assert (first.taxable_value, first.b2b_value, str(first.filing_date)) == (1000.5, None, "2024-02-01")
    assert (third.net_itc, third.taxable_value) == (5.0, None)
    s = folder.folder_summary(rows).first()
    assert (s.records, s.businesses, s.files, s.gstr1, s.gstr3b, s.gstr2a) == (2, 1, 2, 1, 1, 0)
    assert {r.file.rsplit("/", 1)[1]: (r.records, r.used, r.error) for r in report.collect()} == {
        "g1.csv": (3, 1, None), "g3.json": (1, 1, None), "unknown.csv": (1, 0, "no usable row"),
    }


def test_long_and_wide_file(spark, tmp_path):
    text = "date,type,amount,remarks\n" + "".join(f'2024-01-01,D,{i + 1},"{"word " * 50}""{i}"""\n' for i in range(4000))
    rows, _ = folder.payments(folder.read_folder(spark, write(tmp_path, {"long.csv": text})))
    assert rows.count() == 4000 and rows.agg({"amount": "sum"}).first()[0] == sum(range(1, 4001))


def test_headers_are_settled_once_a_file(spark, tmp_path):
    """Repeated, empty and missing headers and keys; the last one of a name counts, also where it is empty."""
    files = {
        "twice.csv": "GSTIN,Period,Taxable Value,,taxable-value,B2B Value\nA1,2024-01,1,7,2,3\nA2,2024-02,1,7\n--,:-, ,,-,\nA3,2024-03,1,7,2,3,extra\n",
        "mixed.json": json.dumps(
            [
                {"gstin": "B1", "period": "2024-01", "taxable_value": "1", "b2b_value": "2"},
                {"gstin": "B2", "period": "2024-02", "Taxable Value": "3", "taxable_value": "4", "b2b_value": "5"},
                {"b2b_value": "6", "gstin": "B3", "period": "2024-03", "taxable_value": "Rs. 7,000"},
            ]
        ),
        "keys.json": json.dumps({"rows": [{"gst in": "no", "GSTIN": "C0", "gstin": "C1", "period": "2024-01", "!": "x", "taxable_value": "1", "b2b_value": "NaN"}] * 2}),
        "same.json": '[{"gstin":"D1","period":"2024-01","taxable_value":"1","b2b_value":"nan"},{"gstin":"D2","period":"2024-02","taxable_value":"Infinity","b2b_value":"2%"}]',
    }
    found = folder.read_folder(spark, write(tmp_path, files))
    rows = folder.returns(found)[0].collect()
    assert sorted((r.gstin, r.rec_no, r.return_type, r.taxable_value, r.b2b_value) for r in rows) == [
        ("A1", 0, "GSTR1", 2.0, 3.0),
        ("A2", 1, "GSTR1", None, None),
        ("A3", 3, "GSTR1", 2.0, 3.0),
        ("B1", 0, "GSTR1", 1.0, 2.0),
        ("B2", 1, "GSTR1", 4.0, 5.0),
        ("B3", 2, "GSTR1", 7000.0, 6.0),
        ("C1", 0, "GSTR1", 1.0, None),
        ("C1", 1, "GSTR1", 1.0, None),
        ("D1", 0, "GSTR1", 1.0, None),
        ("D2", 1, "GSTR1", float("inf"), 2.0),
    ]
    texts = folder.sniffed(found).where("form = 'delimited'")
    # no line looks for the names of its cells
    assert "map_from_entries" not in folder.delimited_records(texts)._jdf.queryExecution().executedPlan().toString()
