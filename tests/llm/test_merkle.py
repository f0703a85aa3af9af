import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from uwspark.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(digests):
    """(root, siblings of every leaf, sides of every leaf) by the plain definition."""
    at, paths, level = list(range(len(digests))), [[] for _ in digests], digests
    while len(level) > 1:
        for leaf, i in enumerate(at):
            other = i ^ 1
            paths[leaf].append((2, "") if other >= len(level) else (1 if i % 2 else 0, level[other]))
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted results."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(((r[0] is None, r[0] or 0, leaf(r)), r) for r in groups[g]) for g in order}
    trees = {g: tree([k[2] for k, _ in leaves[g]]) for g in order}
    root, over = tree([trees[g][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, (k, r) in enumerate(leaves[g]):
            path = trees[g][1][i] + over[n]
            forged = (*r[:3], None if r[3] is None else r[3] + 1, r[4])
            node = leaf(forged) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else k[2]
            for side, other in path:
                node = h(other + node) if side == 1 else h(node + other)
            out.append((str(r[0]), k[2], trees[g][0], root, h("".join(o for _, o in path)), node, node == root))
    return sorted(out)


def run(docs, height):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    forged = merkle.leaf_of([*fields[:3], F.col("n_chars") + 1, fields[4]])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.manifest(docs, merkle.leaf_of(fields), carry={"claimed": F.when(hit, forged).otherwise(merkle.leaf_of(fields))}, height=height)
    cols = ["id", "digest", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return m, sorted((str(r[0]), *r[1:]) for r in merkle.verified(m, "claimed").select(*cols).collect())


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, root string, _tree int"


@pytest.mark.parametrize("height", [1, 3, 8])
def test_edge_cases(spark, height):
    rows = [(i, "web", "en", i * 3, f"text {i}") for i in range(75)]  # one group with most rows
    rows += [(200, "web", "de", 1, "é ü"), (201, None, None, None, None), (None, "a", None, 4, ""), (202, "", "", 0, "")]
    rows += [(203, "a", "fr", i % 2, "word " * 20000) for i in range(5)]  # one id repeated, equal rows among them
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    m, got = run(df, height)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}
    blocks = m.blocks().collect()
    assert max(b.members for b in blocks) <= 1 << height
    assert sum(b.members for b in blocks if not b.crown and b.layer == 0) == len(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "s", "en", 2, "t", 1, "x", 2)], SCHEMA)
    _, got = run(df, 8)
    assert got == brute([(1, "s", "en", 2, "t")]) and got[0][1] == got[0][2] == got[0][3]
    m, none = run(df.limit(0), 8)
    assert none == [] and m.blocks() is None


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 40}", i, str(i)) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert run(df, 2)[1] == brute(rows)


def test_layout():
    # the order of a tree of four levels: two levels on top, then the four subtrees below
    assert [a.tolist() for a in merkle.addresses(4)] == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]
    for levels in range(1, 10):
        every = [int(x) for a in merkle.addresses(levels) for x in a]
        assert sorted(every) == list(range((1 << levels) - 1))


def test_siblings_by_address():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    nodes = merkle.climb(digests, 4)
    root, paths = tree([d.hex() for d in digests])
    assert nodes[:32].hex() == root
    assert [merkle.siblings(nodes, 4, 11, i) for i in range(11)] == paths
