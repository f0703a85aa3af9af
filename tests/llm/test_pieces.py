import math
from collections import Counter

import numpy as np
import pytest

from uwspark.llm import pieces as P


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.Vocabulary.load())


def segmentations(encoder, text):
    """All paths over a short text with their probabilities."""
    vocabulary = P.Vocabulary.load()
    weight = {p: (r + P.RANK_SHIFT) ** -P.POWER for p, r in zip(vocabulary.pieces, vocabulary.ranks) if r >= 0}
    ids = {p: i for i, p in enumerate(vocabulary.pieces)}
    byte = (len(vocabulary.pieces) + P.RANK_SHIFT) ** -P.POWER
    line = (" " + text).replace("▁", "\0").replace(" ", "▁").replace("\0", "\U0010ffff")

    def paths(at):
        if at == len(line):
            return [((), 1.0)]
        out = []
        for end in range(at + 1, min(len(line), at + 16) + 1):
            p = line[at:end]
            if p in weight:
                out += [((ids[p], *rest), weight[p] * w) for rest, w in paths(end)]
        if line[at] not in weight:
            raw = line[at].replace("\U0010ffff", "▁").encode()
            own = tuple(vocabulary.first_byte + b for b in raw)
            out += [((*own, *rest), byte ** len(raw) * w) for rest, w in paths(at + 1)]
        return out

    found = paths(0)
    total = sum(w for _, w in found)
    return {p: w / total for p, w in found}


@pytest.mark.parametrize("text", ["aaaa", "the cat", "x▁é漢", "  a\nb"])
def test_all_segmentations_and_their_probabilities(encoder, text):
    want = segmentations(encoder, text)
    got = P.sample(encoder, [text], np.array([11], np.uint64), len(want) + 3)[0]
    assert len(got) == len(want) and {tuple(s[0]) for s in got} == set(want)
    for ids, log_p, _, inclusion in got:
        assert math.isclose(log_p, math.log(want[tuple(ids)]), abs_tol=1e-9) and inclusion == 1
        assert encoder.decode(ids.tolist()) == text
    values = [s[2] for s in got]
    assert values == sorted(values, reverse=True)


def test_samples_follow_the_law_without_replacement(encoder):
    n = 20000
    want = segmentations(encoder, "aaaa")
    got = P.sample(encoder, ["aaaa"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(3), 2)
    first = Counter(tuple(s[0][0]) for s in got)
    both = Counter((tuple(s[0][0]), tuple(s[1][0])) for s in got)
    close = lambda seen, p: abs(seen / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    assert all(close(first[a], p) for a, p in want.items())
    assert all(close(both[a, b], p * q / (1 - p)) for a, p in want.items() for b, q in want.items() if a != b)
    # inclusion scores weigh the samples back to the law
    for a, p in want.items():
        hit = [math.exp(s[1]) / s[3] for own in got for s in own if tuple(s[0]) == a]
        assert abs(sum(hit) / n - p) < 0.03


def test_values_do_not_depend_on_the_batch(encoder):
    """Bit by bit: ids, log-probability, perturbed value and inclusion of a text alone, in a batch, in another order."""
    rng = np.random.default_rng(5)
    words = ["the", "cat", "aaaa", "läuft", "漢字", "x▁é", "internationalisation", "0xff", "…", "sat"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(120)] + ["", "word " * 3000]
    keys = rng.integers(0, 1 << 63, len(texts)).astype(np.uint64)
    bits = lambda own: [(s[0].tolist(), *(float(v).hex() for v in s[1:])) for s in own]
    batch = [bits(x) for x in P.sample(encoder, texts, keys, 4)]
    assert batch == [bits(P.sample(encoder, [t], keys[i : i + 1], 4)[0]) for i, t in enumerate(texts)]
    order = rng.permutation(len(texts))
    other = P.sample(encoder, [texts[i] for i in order], keys[order], 4)
    assert all(bits(x) == batch[i] for x, i in zip(other, order))


class Counted:
    """An array that counts the elements looked up in it."""

    def __init__(self, values):
        self.values, self.looked_up = values, 0

    def __getitem__(self, at):
        self.looked_up += len(at)
        return self.values[at]


def test_a_character_is_looked_up_only_while_a_piece_may_begin_like_this(encoder, monkeypatch):
    """Work per character is that of the pieces there, not of the longest piece of the vocabulary."""
    units = [" " + "qzxj" * 2000, " internationalisation", "  ", " é漢😀"]
    want = P.Lattice(encoder, units)
    counted = Counted(encoder.bucket)
    monkeypatch.setattr(encoder, "bucket", counted)
    got = P.Lattice(encoder, units)
    assert counted.looked_up < 8 * sum(map(len, units)) < 2 * encoder.longest * sum(map(len, units))
    assert (got.kind == want.kind).all() and (got.q == want.q).all()


def test_beginnings_of_all_pieces_are_open(encoder):
    """No piece is lost: every one is an edge over its own characters."""
    vocabulary = P.Vocabulary.load()
    usable = [(i, p) for i, (p, r) in enumerate(zip(vocabulary.pieces, vocabulary.ranks)) if r >= 0]
    lattice = P.Lattice(encoder, [p.replace("▁", " ") for _, p in usable])
    first = lattice.first[lattice.start]
    assert [i for i, _ in usable] == lattice.kind[first].tolist() and (lattice.next[first] == len(lattice.first)).all()


def test_decoded_bytes_are_compared_run_by_run(encoder):
    ids = np.array([encoder.first_byte + b for b in "é😀".encode()], np.int32)
    assert encoder.decodes(ids, np.array([0, 2, 2, 6]), [b"", "é".encode(), b"", "😀".encode()]) == [True] * 4
    assert encoder.decodes(ids, np.array([1, 6]), ["é".encode(), "😀".encode()]) == [False, False]
    assert encoder.decodes(P.NO_IDS, np.array([0, 0]), [b"", b"x"]) == [True, False]


def test_rows(spark, encoder):
    long = "word▁ é😀 " * 4000
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "null key"), (1, "hello world"), (4, long), (5, " "), (6, "x" * 3000), (7, "漢字" * 400)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id bigint, text string, _key string, sample int").coalesce(1)
    got = P.encoded(df, samples=3).collect()
    assert all(r.exact for r in got)
    text = dict(rows)
    for r in got:
        assert encoder.decode(r.ids) == (text[r.doc_id] or "") and r.n_pieces == len(r.ids)
    by = Counter((r.doc_id, tuple(r.ids)) for r in got)
    assert all(n == (2 if d == 1 else 1) for (d, _), n in by.items())
    assert [r.n_pieces for r in got if r.doc_id in (2, 3)] == [0, 0]
    other = {(r.doc_id, r.sample): r.ids for r in P.encoded(df.repartition(5), samples=3).collect()}
    assert all(other[r.doc_id, r.sample] == r.ids for r in got)
    assert P.encoded(df.limit(0)).count() == 0


def test_rows_do_not_depend_on_the_characters_walked_together(spark):
    texts = ["alpha beta gamma", None, "", "delta " * 40, "épsilon 字 zeta", "eta", "alpha beta gamma", " "]
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = lambda **how: sorted(map(str, P.encoded(docs, **how).collect()))
    want = rows()
    assert len(want) >= len(texts)
    for chars in (1, 20, 300):
        assert rows(batch_chars=chars) == want
        assert rows(batch_chars=chars, digest=True) == rows(digest=True)


def test_texts_are_cut_at_the_wanted_characters():
    assert [*P._cuts([3, 0, 4, 9, 1], 5)] == [(0, 3), (3, 4), (4, 5)]
    assert [*P._cuts([0, 0], 5)] == [(0, 2)] and not [*P._cuts([], 5)]
