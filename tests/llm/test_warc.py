import base64
import contextlib
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from uwspark.llm import warc

FAKE = (
    "WARC/1.1\r\nWARC-Type: response\r\nX-Row: 666\r\nContent-Type: application/http\r\nContent-Length: 24\r\n\r\n"
    "HTTP/1.1 200 OK\r\n\r\nfakes\r\n\r\n"
)
SCHEMA = "page_id bigint, url string, html string, file int, `offset` string, headers int, _id int, value string"


@contextlib.contextmanager
def conf(spark, **values):
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


def folder():
    return tempfile.mkdtemp(prefix="uwspark-warc-") + "/archive"


def parse(data):
    """Records of one archive by the plain rule: (offset, headers, block)."""
    out, at = [], 0
    while data[at : at + 7] == b"WARC/1.":
        head = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at:head].split(b"\r\n")[1:] if line)
        end = head + int(fields[b"Content-Length"])
        out.append((at, fields, data[head:end]))
        at = end + 4
    return out, at


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        refers = first.get(body, i)
        copy = refers != i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((str(i), len(body), digest, "revisit" if copy else "response", refers if copy else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", f"<html>page {i % 17} é\r\n\r\n</html>") for i in range(60)]
ROWS += [(100 + i, "u", "one page that very many rows have") for i in range(90)]
ROWS += [(200, None, None), (201, "", ""), (None, "http://x/WARC/1.1\r\n\r\nWARC/1.0", "only"), (None, "u", "one page that very many rows have")]
ROWS += [(202, "u", "x" + "\r\n\r\n" + FAKE), (203, "u", "\r\n\r\n" + FAKE * 3), (204, "u", FAKE), (205, "u", "long " * 40000 + "\r\n\r\nWARC/1.0\r\n")]
ROWS += [(206, "a", "same id"), (206, "a", "same id"), (206, "b", "same id"), (207, "c", "same id")]


@pytest.mark.parametrize("split,block", [("128m", 1 << 26), ("900b", 700), ("64b", 50)])
def test_round_trip(spark, split, block):
    rows = ROWS if split != "64b" else [r for r in ROWS if len(r[2] or "") < 1000]
    path = folder()
    warc.write(warc.records_of(frame(spark, rows).repartition(3)), path)
    with conf(spark, **{"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1b"}):
        got = warc.read(spark, path, block_bytes=block).collect()
    by_row = {}
    for r in got:
        fields = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:])
        by_row.setdefault(fields.get("X-Row", "None"), []).append((fields, bytes(r.payload)))
    assert sum(len(v) for v in by_row.values()) == len(rows) and "666" not in by_row
    want = {}
    for i, _, html in rows:
        want.setdefault(str(i), []).append((html or "").encode())
    for i, entries in by_row.items():
        stored = [p for f, p in entries if f["WARC-Type"] == "response"]
        assert all(p in want[i] for p in stored)
        assert all(p == b"" for f, p in entries if f["WARC-Type"] == "revisit")


def test_digests(spark):
    path = folder()
    for least in (0, 8):
        path = folder()
        warc.write(warc.records_of(frame(spark, ROWS).repartition(4), least=least), path)
        records = warc.read(spark, path, {"n": F.octet_length, "d": warc.base32_sha1}, block_bytes=5000)
        out = []
        for r in records.collect():
            f = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:])
            copy = f["WARC-Type"] == "revisit"
            if not copy:
                assert f["X-Payload-Length"] == str(r.n) and f["WARC-Payload-Digest"] == "sha1:" + r.d
            digest = f["WARC-Payload-Digest"][5:]
            out.append((f.get("X-Row", "None"), int(f["X-Payload-Length"]), digest, f["WARC-Type"], int(f["X-Refers-To-Row"]) if copy else None))
        assert sorted(out, key=str) == brute(ROWS, least)


def test_files_follow_the_format(spark):
    import glob

    path = folder()
    warc.write(warc.records_of(frame(spark, ROWS).repartition(3)), path)
    ids, refers = {}, []
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        records, end = parse(data)
        assert end == len(data)
        for _, f, block in records:
            assert len(block) == int(f[b"Content-Length"])
            ids.setdefault(f[b"WARC-Record-ID"], f)
            if f[b"WARC-Type"] == b"revisit":
                refers.append((f[b"WARC-Refers-To"], f[b"X-Refers-To-Row"]))
    assert refers and all(ids[i][b"X-Row"] == row for i, row in refers)


def test_foreign_files(spark):
    import os

    path = folder()
    os.makedirs(path)
    record = lambda text, extra="": f"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: {len(text)}\r\n{extra}\r\n{text}\r\n\r\n"
    good = record("a\r\n\r\nWARC/1.0\r\nb") + record("") + record("plain")
    for name, text in {
        "good": good,
        "cut_short": good + record("x" * 50)[:60],
        "wrong_length": record("one") + record("two").replace("length: 3", "length: 9") + record("never"),
        "no_start": "garbage" + good,
        "empty": "",
        "no_length": "WARC/1.0\r\nWARC-Type: resource\r\n\r\nabc\r\n\r\n" + good,
    }.items():
        with open(f"{path}/{name}", "w", newline="") as f:
            f.write(text)
    got = {}
    for r in warc.read(spark, path, block_bytes=40).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.offset, bytes(r.payload)))
    three = [b"a\r\n\r\nWARC/1.0\r\nb", b"", b"plain"]
    assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {
        "good": three,
        "cut_short": three,
        "wrong_length": [b"one", b"two\r\n\r\nWAR"[:9]],
    }
    assert [o for o, _ in sorted(got["good"])] == [o for o, _, _ in parse_lower(good)]


def parse_lower(text):
    out, at = [], 0
    while text[at : at + 7] == "WARC/1.":
        head = text.index("\r\n\r\n", at) + 4
        n = int(text[at:head].split("content-length: ")[1].split("\r\n")[0])
        out.append((at, None, None))
        at = head + n + 4
    return out


def test_empty_table(spark):
    path = folder()
    warc.write(warc.records_of(frame(spark, ROWS).limit(0)), path)
    assert warc.read(spark, path).count() == 0
