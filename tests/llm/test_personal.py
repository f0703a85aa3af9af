import hashlib
import re

from uwspark.llm import personal as P

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, raw):
    d = re.sub("[^0-9]", "", raw)
    if kind == "ip":
        return all(int(x) <= 255 for x in raw.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


TEXTS = [
    None, "", "nothing here", "a@b.c_d@e.f x@y z@q.r.", "é😀 mail me: jo+e@mail-1.example.com, ok",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.002.03.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (743) 555-3824 +49 30 123456 +1 ( +12345678901234567", "+33 1.22.33.44.55 4111111111111111@x.yz",
    "card 4000056655665556 ip 10.0.0.1 mail a.b@c.de phone +1-202-555-0143 " * 40,
    "9" * 5000 + " " + "1 " * 3000, "a" * 20000 + "@", "1." * 5000, "+" + "1 " * 5000 + "(",
]


def test_base_spans(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "k"), (4, TEXTS[4], "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, found string")
    got = {(r.doc_id, i): r for i, r in enumerate(P.personal_report(df.coalesce(1)).collect())}
    assert len(got) == len(rows)
    for (doc, i), r in got.items():
        want = brute(rows[i][1])
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k, _ in BASE], rows[i][1][:80]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in dict(BASE)] == [x for x in want.split(",") if x]
    assert P.personal_report(df.limit(0)).count() == 0


def test_base_spans_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in P.personal_report(docs).collect():
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()


def test_added_kinds_and_scores(spark):
    texts = [
        "my iban DE89 3704 0044 0532 0130 00 THANKS",
        "GB82WEST12345698765432",
        "DE89 3704 0044 0532 0130 01",
        "social security 123-45-6789",
        "part 123-45-6789",
        "call me: 202-555-0143",
        "code 202-555-0143",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.found] for r in P.personal_spans(df).collect()}
    assert got[0] == [("iban", 8, 35, 110)] and got[1] == [("iban", 0, 22, 80)] and got[2] == []
    assert [s[0] for s in got[3]] == ["ssn"] and got[4] == []
    assert [s[0] for s in got[5]] == ["local"] and got[6] == []
