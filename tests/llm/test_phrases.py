import re
from collections import Counter

import pytest

from uwspark.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, row int, word string, n int, item string, `at` int"


def brute(rows, least=10, longest=3, share=50, top=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, p), a in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                covered[lang, p[i : i + k]] = max(covered[lang, p[i : i + k]], a)
    out = {}
    for (lang, p), a in frequent.items():
        if 100 * covered[lang, p] >= share * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA).repartition(5)


ROWS = [(i, "The New York times, the new york Times. new\tYORK!\nice cream", "en") for i in range(30)]
ROWS += [(100 + i, f"ice cream {i} a b c d. a b c x, a b a b a b a b", None if i % 2 else "und") for i in range(14)]
ROWS += [(200, None, "en"), (201, "", "en"), (202, " \t\n.,", "fr"), (203, "Äpfel äpfel Äpfel " * 15, "de"), (None, "no id at all", "en")]
ROWS += [(204, "stop word " * 30000 + "stop. word", "en"), (205, "\x01a \x01a b \x01a", "en")]
ROWS += [(206, "same row twice same row twice", "es")] * 9


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("least,longest,share", [(10, 3, 50), (3, 4, 80), (2, 2, 50)])
def test_edge_cases(spark, limit, least, longest, share):
    got = phrases.collocations(frame(spark, ROWS), least, longest, share, limit=limit).collect()
    assert sorted(map(tuple, got)) == brute(ROWS, least, longest, share)


def test_top_and_ties(spark):
    rows = [(i, ", ".join(f"w{j} v{j}" for j in range(40)), "en") for i in range(12)]
    got = phrases.collocations(frame(spark, rows), top=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, top=7) and len(got) == 7


def test_empty(spark):
    assert phrases.collocations(frame(spark, ROWS).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [(1, "too few words", "en")])).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("uwspark_")]


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    wide = lambda v: F.lit(v).cast("decimal(14,0)")
    a, b, c = 12_345_678_901_234, 23_456_789_012_345, 34_567_890_123_456
    row = spark.range(1).select(
        F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(b) * wide(c)).alias("x")
    )
    assert row.first().x == 1_000_000 * a * a // (b * c)


def test_beyond_the_limit_rows_stay_and_relations_go(spark):
    import os

    from uwspark.staging import shared_dir

    counts = [(i, 10**6 if i < 3 else 40 if i < 13 else 10 + i) for i in range(40)]  # (id, n)
    items = spark.createDataFrame([(f"w{i}", i, n) for i, n in counts], "word string, id long, n long")
    top = lambda limit: {i for i, n in counts if n >= phrases._broadcast_from(items, limit)}
    assert len(top(3)) == 3 and len(top(8)) == 8 and len(top(19)) == 12 and len(top(30)) == 30  # eleven items of one count come together
    assert top(0) == {i for i, n in counts if 256 * n >= sum(n for _, n in counts)}
    rows = spark.createDataFrame([(r, a, f"w{(r * 7 + a) % 50}") for r in range(60) for a in range(0, 40, 3)], "row long, at int, word string")
    for limit in (0, 19):
        got = phrases._attached(rows.repartition(4, "row"), items, ["word"], limit)
        assert sorted(map(tuple, got.collect())) == sorted((r.row, r.at, int(r.word[1:])) for r in rows.collect() if int(r.word[1:]) < 40)
    where = f"{shared_dir(spark)}/uwspark-{spark.sparkContext.applicationId}"
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    assert phrases.collocations(frame(spark, ROWS), limit=4).count()
    kept = [f for f in set(os.listdir(where)) - before if f.startswith("uwspark_")]
    assert not kept  # relations, which the counts have used up
    assert all("_key" not in spark.read.parquet(f"{where}/{f}").columns for f in set(os.listdir(where)) - before)  # occurrences with their texts
