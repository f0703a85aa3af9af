import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from uwspark.llm import simhash as S
from uwspark.llm.components import components


def brute_fp(text, k=3):
    words = ("" if text is None else text).translate({c: c + 32 for c in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = defaultdict(list)
    for i, d in enumerate(ids):
        best[find(i)].append(d)
    return [min((d for d in best[find(i)] if d is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("radius", [0, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    b = np.r_[a[:40] ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)), rng.integers(0, 1 << 63, 111, dtype=np.uint64)]
    blocks = -(-len(b) // 64)
    q = np.repeat(a, blocks)
    blk = np.tile(np.arange(blocks), len(a))
    want = np.full(len(q), S.FULL)
    near = S._lanes(S.within(q[:, None], blk, want, S.planes_of(b[:, None]), radius)).reshape(len(a), -1)[:, : len(b)]
    true = np.array([[(int(x) ^ int(y)).bit_count() <= radius for y in b] for x in a])
    assert (near.astype(bool) == true).all()


def test_small_groups_share_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    group = np.repeat(np.arange(50), 5)
    fps = np.repeat(base, 5) ^ rng.choice(np.array([0, 1, 3, 7, 15, 31], np.uint64), 250)
    i, j = S.small_links(fps[:, None], group, 3)
    true = {(x, y) for x in range(250) for y in range(x) if group[x] == group[y] and (int(fps[x]) ^ int(fps[y])).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == true


def test_fingerprint_matches_definition():
    for t in ["", " \n", "One", "one two", "A b C d é É", "x " * 7 + "y", "ÉCOLE école z q r"]:
        assert S.fingerprint(t) == brute_fp(t)


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 9), (12, 11), (11, 10), (10, 2), (20, 21), (3, 5)]
    got = {(r.u, r.v) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(5, 3), (9, 3), (12, 2), (11, 2), (10, 2), (21, 20)}


@pytest.mark.parametrize("lanes", [4096, 8])
def test_links_of_hot_buckets(spark, lanes):
    rng = random.Random(7)
    center = rng.getrandbits(63)
    fps = {center}
    while len(fps) < 150:
        x = center
        for _ in range(rng.choice([1, 2, 3, 6])):
            x ^= 1 << rng.randrange(63)
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(63) for _ in range(50)})
    links = S.near_links(spark.createDataFrame([(x,) for x in fps], "_fp bigint"), 3, lanes)
    forest = {r.u: r.v for r in components(links).collect()}
    got = [forest.get(x, x) for x in fps]
    assert got == brute_components(fps, fps, 3)


def test_wide_fingerprints(spark):
    """Near copies of 0.8 and more on five-word shingles meet, other texts do not."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, same = [], []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(100, 300))]
        rows.append((3 * i, " ".join(base)))
        close = list(base)
        for _ in range(len(base) // 60):  # each change touches five of the shingles: similarity about 0.85
            close[rng.randrange(len(base))] = rng.choice(words)
        rows.append((3 * i + 1, " ".join(close)))
        far = list(base)
        for at in range(0, len(far), 6):
            far[at] = rng.choice(words)
        rows.append((3 * i + 2, " ".join(far)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.near_duplicates(df, words=5, radius=S.WIDE_RADIUS, parts=2).collect()}
    assert sum(got[3 * i + 1].component_id == 3 * i for i in range(60)) >= 58
    assert all(got[3 * i].component_id == 3 * i and got[3 * i + 2].component_id == 3 * i + 2 for i in range(60))
    assert all(got[i].fingerprint == "%032x" % S.fingerprint(t, 5, 2) for i, t in rows)
    a, b = S.fingerprint("one two three", 3, 2), S.fingerprint("one two three", 3)
    assert a & (1 << 64) - 1 == b


def test_near_duplicates_edge_cases(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "é", "zeta", "eta", "theta"]
    long = " ".join(rng.choice(words) for _ in range(3000))
    texts = [None, "", " \t", long, long + " end", long, "one two", "ONE two", "q"]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    rows = [(i if i != 6 else None, t, "x", "y") for i, t in enumerate(texts)] + [(3, long, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _fp string, component_id string")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ids, fps = [r[0] for r in rows], [brute_fp(r[1]) for r in rows]
    want = sorted(zip([str(i) for i in ids], ["%016x" % f for f in fps], map(str, brute_components(ids, fps, 3))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert S.near_duplicates(df.limit(0)).count() == 0
