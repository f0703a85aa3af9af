import hashlib
import re

from uwspark.llm.exact import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(bare, []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare], key=lambda x: x[:3])[3]
        out.append((str(i), str(keep), len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out)


def test_edge_cases(spark):
    hot = "a text that very many rows have"
    rows = [(i, hot + " " * (i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (None, hot), (None, "only here")]
    rows += [(103, "é x"), (104, "éx"), (105, "éx"), (106, "a b"), (107, "ab"), (107, "ab"), (108, "word " * 20000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, keep_id int, _run int").repartition(4)
    for bits in (1, 3):
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, fan_bits=bits).collect())
        assert got == brute(rows)
    assert exact_dedup(df.limit(0)).count() == 0
