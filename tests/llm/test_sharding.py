import zlib
from collections import Counter, defaultdict

from uwspark.llm.sharding import interleave


def check(rows, out, shards=16):
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    if len(rows) >= shards:
        assert set(sizes) == set(range(shards))
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in out) == want


def test_edge_cases(spark):
    rows = [(i, f"text {i} é", "hot" if i % 3 else f"s{i % 7}") for i in range(500)]
    rows += [(None, None, None), (None, "", None), (7, "text 7 é", "hot"), (7, "text 7 é", "hot"), (600, "long " * 50000, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, shard int")
    check(rows, interleave(df).collect())
    check(rows, interleave(df, blocks=3).collect())
    check(rows[:5], interleave(df.where("doc_id < 5")).collect())
    assert interleave(df.limit(0)).count() == 0


def test_every_shard_has_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = interleave(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total, by = Counter(r.source for r in out), Counter((r.shard, r.source) for r in out)
    assert all(abs(by[s, src] - n / 16) <= 2 for src, n in total.items() for s in range(16))
    again = {r.doc_id: (r.shard, r.slot) for r in interleave(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in out}
