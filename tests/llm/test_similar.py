import random
from collections import defaultdict

import pytest

import corpus_pipeline as C
from uwspark.llm import similar


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """Rows kept: the first of every component of pairs of 0.8 and more."""
    order = sorted(set((i is None, i or 0, t or "") for i, t in rows))
    sets, root = [shingles(t) for _, _, t in order], list(range(len(order)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(order)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, row in enumerate(order):
        groups[find(i)].append(row)
    return groups.values()


def planted(rng):
    """Texts at many similarities to a base, and a large group around one text."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]

    def changed(base, n):
        out = list(base)
        for at in rng.sample(range(len(out)), n):
            out[at] = rng.choice(words)
        return " ".join(out)

    texts = []
    for _ in range(60):
        base = say(rng.randint(60, 300))
        texts += [" ".join(base), *(changed(base, max(1, int(len(base) * x))) for x in (0.01, 0.02, 0.03, 0.05, 0.07, 0.1))]
    base = say(200)
    return texts + [" ".join(base)] + [changed(base, 4) for _ in range(60)]


@pytest.mark.parametrize("lanes", [similar.LANES, 7])
def test_near_copies_against_exact_similarity(spark, lanes):
    rng = random.Random(11)
    rows = list(enumerate(planted(rng)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(9001, None), (9002, ""), (9003, "three words only"), (9004, "Three words only")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r._id for r in similar.first_of_each(df, lanes=lanes).collect()}
    want = {g[0][1] for g in brute(rows)}
    assert got == want, (sorted(got - want)[:9], sorted(want - got)[:9])
    assert 150 < len(want) < 420
    assert similar.first_of_each(df.limit(0)).count() == 0


def test_stage_keeps_what_is_less_similar(spark):
    """Fingerprints of five-word shingles within 25 bits may stand for a similarity far below 0.8."""
    rng = random.Random(12)
    rows = list(enumerate(planted(rng)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id for r in C.keep_one_of_each(spark, df, "").collect()}
    assert got == {g[0][1] for g in brute(rows)}


def test_stage_finds_pairs_at_the_limit(spark):
    """Pairs at exactly 0.8: n = 45 k shingles, k changed words of five shingles each."""
    rng = random.Random(13)
    rows = []
    for i in range(400):
        k = rng.choice([1, 2, 4, 7])
        base = ["%x" % rng.getrandbits(40) for _ in range(45 * k + 4)]
        close = list(base)
        for c in range(k):
            close[20 + 45 * c] = "%x" % rng.getrandbits(40)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(close))]
    assert all(jaccard(shingles(rows[i][1]), shingles(rows[i + 1][1])) == 0.8 for i in range(0, 800, 2))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in C.keep_one_of_each(spark, df, "").collect()) == list(range(0, 800, 2))


def test_near_copies_meet_by_fingerprint(spark):
    """Without any min-hash band: copies within three bits have a key in common, other texts have not."""
    rng = random.Random(14)
    rows = []
    for i in range(40):
        base = ["%x" % rng.getrandbits(40) for _ in range(800)]
        rows += [(f"a{i}", " ".join(base)), (f"b{i}", " ".join([*base, "%x" % rng.getrandbits(40)]))]
    prints = {n: similar.simhash.fingerprint(t) for n, t in rows}
    df = spark.createDataFrame([(n.encode(), f - (f >> 63 << 64)) for n, f in prints.items()], "_set binary, _fp bigint")
    keys = {bytes(r._set).decode(): r._key for r in similar.met_by_fingerprint(df).collect()}
    close = [i for i in range(40) if bin(prints[f"a{i}"] ^ prints[f"b{i}"]).count("1") <= similar.RADIUS]
    assert len(close) > 20 and all((keys[f"a{i}"] == keys[f"b{i}"]) == (i in close) for i in range(40))
    assert len({keys[f"a{i}"] for i in range(40)}) == 40
