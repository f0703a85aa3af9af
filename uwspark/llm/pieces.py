"""SentencePiece encoding with sampled segmentations, and decoding.

A segmentation is a path through the lattice of vocabulary pieces over a text; its
probability is the product of the probabilities of its pieces.  The vocabulary is
given, not trained: a piece of merge rank r has the weight 1 / (r + RANK_SHIFT) of
Zipf's law, raised to `power`, and characters without a piece become byte pieces.

Samples without replacement are the paths with the k largest Gumbel-perturbed
log-probabilities, found by best-first search.  The search space is the tree of
decisions along the lattice.  The largest perturbed value inside any set of paths
is a Gumbel variable located at the log of the set's mass, which the backward sums
give exactly, so it is the heuristic of an A-star search that expands nothing in
vain.  Popping a set follows one path to its end; every decision on the way leaves
behind the set of paths that decide otherwise there, with a maximum truncated at
the popped one.  The next value after the k-th is the threshold of the inclusion
scores: a path with log-probability p was included with 1 - exp(-exp(p - t)).

No piece continues past a space, so a lattice is a chain of small ones, one per
unit (spaces and what follows them); a batch builds the lattice of each different
unit once, and walks all units of all texts side by side.  Random numbers come
from a counter hash of (seed, row key, sample, unit, decision), so a row gives the
same result in any batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import query, table, whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 20240
POWER = 1.0
RANK_SHIFT = 10
BATCH_CHARS = 1 << 19
UNIT = re.compile(r" *[^ ]+| +")
SPACE, LITERAL = 0x2581, 0x110000  # the meta symbol of a space; the stand-in of that symbol in a text
NO_IDS = np.zeros(0, np.int32)
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Vocabulary:
    """Piece strings by id; `ranks` are merge ranks, negative for pieces that never occur in a text."""

    pieces: tuple[str, ...]
    ranks: tuple[int, ...]
    first_byte: int

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        rank = lambda i: -1 if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) else int(min(-p.get_score(i), n))
        return Vocabulary(tuple(p.id_to_piece(i) for i in range(n)), tuple(rank(i) for i in range(n)), p.piece_to_id("<0x00>"))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, power: float = POWER):
        usable = [(i, p) for i, (p, r) in enumerate(zip(vocabulary.pieces, vocabulary.ranks)) if r >= 0]
        self.longest = max(len(p) for _, p in usable)
        hashes, begun = self._string_hashes([p for _, p in usable])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for i, _ in usable], np.int32)[order]
        weight = np.array([vocabulary.ranks[i] for i, _ in usable], np.float64)[order]
        self.weights = -power * np.log(weight + RANK_SHIFT)
        self.byte_weight = -power * np.log(len(vocabulary.pieces) + RANK_SHIFT)
        self.first_byte = vocabulary.first_byte
        # hashes by their first 20 bits, at most `crowd` of them together
        self.bucket = np.searchsorted(self.hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.crowd = int(np.diff(self.bucket).max())
        self.hashes = np.r_[self.hashes, np.zeros(self.crowd, np.uint64)]
        # where a longer piece may begin like this: the first bits of the hashes of all beginnings
        self.open = np.zeros(1 << 20, bool)
        self.open[(begun >> np.uint64(44)).astype(np.int64)] = True
        self.bytes_of = [p.replace("▁", " ").encode() for p in vocabulary.pieces]
        for b in range(256):
            self.bytes_of[self.first_byte + b] = bytes([b])
        self.byte_strings = pa.array(self.bytes_of, pa.large_binary())

    @staticmethod
    def _string_hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of pieces, and of their beginnings of one character and more."""
        sizes = np.array([len(p) for p in pieces])
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        start = np.cumsum(sizes) - sizes
        whole, begun, h, live = np.empty(len(pieces), np.uint64), [], np.zeros(len(pieces), np.uint64), np.arange(len(pieces))
        for k in range(int(sizes.max())):
            h = h * MULTIPLIER + chars[start[live] + k]
            last = sizes[live] == k + 1
            whole[live[last]] = h[last] * SPREAD
            live, h = live[~last], h[~last]
            begun.append(h * SPREAD)
        return whole, np.concatenate(begun)

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; the space that encoding puts before it is taken away."""
        raw = self.decoded_bytes(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode()

    def decoded_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decodes(self, ids: np.ndarray, ends: np.ndarray, raw: list[bytes]) -> list[bool]:
        """Whether the runs of ids that stop at `ends` have the bytes `raw`."""
        if not len(ids):
            return [not x for x in raw]
        _, offsets, data = self.byte_strings.take(pa.array(ids)).buffers()
        cuts, view = np.frombuffer(offsets, np.int64)[np.r_[0, ends]].tolist(), memoryview(data)
        return [bytes(view[lo:hi]) == x for lo, hi, x in zip(cuts, cuts[1:], raw)]


class Lattice:
    """Edges over the characters of different units, state by state, longest piece first.

    States are numbered by the characters left in their unit: those with one come first, and
    every edge leads to a smaller number or, at the end of its unit, to the number of states.
    """

    def __init__(self, encoder: Encoder, units: list[str]):
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).copy()
        chars[chars == SPACE] = LITERAL
        chars[chars == 32] = SPACE
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        n = len(chars)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters from here to the end of the unit
        place = np.argsort(left.astype(np.min_scalar_type(int(left.max()))), kind="stable")  # where a state's character is
        cut = np.cumsum(np.bincount(left))  # states with so many characters left, or fewer
        state_at = np.empty(n + 1, np.int64)
        state_at[place] = np.arange(n)
        state_at[n] = n
        self.start = state_at[ends - sizes]
        code = chars + np.uint64(1)
        pieces = []  # (states, targets, places in the vocabulary) by length
        here, at, sums = np.arange(n), place, np.zeros(n, np.uint64)  # where a piece of this length may begin
        for size in range(1, encoder.longest + 1):
            sums = sums * MULTIPLIER + code[at + (size - 1)]
            h = sums * SPREAD
            slot = (h >> np.uint64(44)).astype(np.int64)
            found = encoder.bucket[slot]
            some = np.flatnonzero(found < encoder.bucket[slot + 1])
            own, found = h[some], found[some]
            for _ in range(encoder.crowd - 1):
                other = np.flatnonzero(encoder.hashes[found] != own)
                if not len(other):
                    break
                found[other] += encoder.hashes[found[other]] < own[other]
            hit = encoder.hashes[found] == own
            some = some[hit]
            state, target = here[some], state_at[at[some] + size]
            target[: np.searchsorted(state, cut[size])] = n
            pieces.append((state, target, found[hit]))
            more = encoder.open[slot]
            more[: np.searchsorted(here, cut[size])] = False
            more = np.flatnonzero(more)
            here, at, sums = here[more], at[more], sums[more]
            if not len(here):
                break
        none = np.ones(n, bool)
        none[pieces[0][0]] = False
        degree = none.astype(np.int64)
        for state, _, _ in pieces:
            degree[state] += 1
        stop = np.cumsum(degree)
        self.first, self.degree = stop - degree, degree
        n_edges = int(stop[-1])
        self.kind, self.log_q, self.next = np.empty(n_edges, np.int32), np.empty(n_edges), np.empty(n_edges, np.int64)
        free = self.first.copy()
        for state, target, found in reversed(pieces):  # longest first
            e = free[state]
            free[state] += 1
            self.kind[e] = encoder.ids[found]
            self.log_q[e] = encoder.weights[found]
            self.next[e] = target
        state = np.flatnonzero(none)  # characters without a piece: their bytes
        own = chars[place[state]].astype(np.int64)
        own[own == LITERAL] = SPACE
        e = free[state]
        self.kind[e] = -1 - own
        self.log_q[e] = encoder.byte_weight * (1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF))
        self.next[e] = np.where(state < cut[1], n, state_at[place[state] + 1])
        mass = np.zeros(n + 1)  # log of the summed weights of all paths from a state to the end of its unit
        edge_cut = np.r_[0, stop][cut].tolist()
        cut = cut.tolist()
        for lo, hi, a, b in zip(cut, cut[1:], edge_cut, edge_cut[1:]):
            x, own = self.log_q[a:b], degree[lo:hi]
            group = self.first[lo:hi] - a
            x += mass[self.next[a:b]]
            top = np.maximum.reduceat(x, group)
            top += np.log(np.add.reduceat(np.exp(x - np.repeat(top, own)), group))
            mass[lo:hi] = top
            x -= np.repeat(top, own)
        np.minimum(self.log_q, 0.0, out=self.log_q)
        self.q = np.exp(self.log_q)
        self.take = self.q.copy()
        self.take[stop - 1] = 2.0  # the last edge of a state takes what is left
        self.q[self.first[degree == 1]] = 1.0


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def counter(key: np.ndarray, unit: np.ndarray, step: np.ndarray, salt: int) -> np.ndarray:
    """A number per (key, unit, step, salt); the next step is SPREAD further."""
    x = key + unit.astype(np.uint64) * MULTIPLIER
    x += step.astype(np.uint64) * SPREAD
    x += np.uint64(salt * 0x8CB92BA72F3D8DD7 & (1 << 64) - 1)
    return x


def fraction(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of counters."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(key: np.ndarray, unit: np.ndarray, step: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1), one per (key, unit, step, salt)."""
    return fraction(counter(key, unit, step, salt))


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(value: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """A Gumbel value conditioned to lie under `limit`."""
    low, high = np.minimum(value, limit), np.maximum(value, limit)
    return low - np.log1p(np.exp(low - high))


def walk(lattice: Lattice, state: np.ndarray, key: np.ndarray, unit: np.ndarray, step: np.ndarray, salt: int):
    """Follow every state to the end of its unit: (edges, their numbers), unit after unit."""
    n = len(state)
    live, taken = np.arange(n), []
    count = np.zeros(n, np.int64)
    x = counter(key, unit, step, salt)
    while len(live):
        u = fraction(x)
        e = lattice.first[state]
        # the shares of a state are taken off one by one: no sum runs over other states or texts
        beyond = np.flatnonzero(u >= lattice.take[e])
        while len(beyond):
            u[beyond] -= lattice.take[e[beyond]]
            e[beyond] += 1
            beyond = beyond[u[beyond] >= lattice.take[e[beyond]]]
        taken.append((live, e))
        count[live] += 1
        state = lattice.next[e]
        on = state < len(lattice.first)
        live, state, x = live[on], state[on], x[on] + SPREAD
    at = np.cumsum(count) - count
    edges = np.empty(int(count.sum()), np.int64)
    for depth, (who, e) in enumerate(taken):
        edges[at[who] + depth] = e
    return edges, count


@dataclass
class Path:
    """Paths of one pop over all texts: decisions in order, text after text."""

    doc: np.ndarray
    unit: np.ndarray
    step: np.ndarray
    edge: np.ndarray
    left: np.ndarray  # perturbed maximum of what was decided against here; minus infinity where nothing was
    prefix: np.ndarray  # log-probability before the decision


def _finish(lattice: Lattice, keys: np.ndarray, top: np.ndarray, doc, unit, step, edge, fresh, rest, salt: int) -> Path:
    """`fresh` marks decisions whose rest belongs to this path; `rest` is its mass, negative for all but the edge."""
    log_q = lattice.log_q[edge]
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    prefix = np.empty(len(doc))
    for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(doc)].tolist()):  # text by text, so that a batch changes no value
        np.cumsum(log_q[lo:hi], out=prefix[lo:hi])
    prefix -= log_q
    left = np.full(len(doc), -np.inf)
    rest = np.where(rest < 0, 1.0 - lattice.q[edge], rest)
    some = np.flatnonzero(fresh & (rest > 0))
    if len(some):
        own = doc[some]
        g = prefix[some] + np.log(rest[some]) + gumbel(uniform(keys[own], unit[some], step[some], salt + 1))
        left[some] = truncated(g, top[own])
    return Path(doc, unit, step, edge, left, prefix)


def _segment_best(path: Path, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest `left` of every text, where)."""
    best, where = np.full(n, -np.inf), np.zeros(n, np.int64)
    if len(path.doc):
        starts = np.flatnonzero(np.r_[True, path.doc[1:] != path.doc[:-1]])
        top = np.maximum.reduceat(path.left, starts)
        hit = np.flatnonzero(path.left == np.repeat(top, np.diff(np.r_[starts, len(path.doc)])))
        d = path.doc[hit]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        best[path.doc[starts]], where[d[first]] = top, hit[first]
    return best, where


def sample(encoder: Encoder, texts: list[str], keys: np.ndarray, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Of every text, distinct segmentations in the order of their perturbed values: (ids, log-probability, perturbed, inclusion)."""
    units = [UNIT.findall(" " + text) if text else [] for text in texts]
    per_doc = np.array([len(u) for u in units], np.int64)
    n = len(texts)
    if not per_doc.any():
        return [[(NO_IDS, 0.0, 0.0, 1.0)] for _ in texts]
    index = {u: i for i, u in enumerate(dict.fromkeys(chain.from_iterable(units)))}
    lattice = Lattice(encoder, list(index))
    word = np.fromiter(map(index.__getitem__, chain.from_iterable(units)), np.int64, int(per_doc.sum()))
    del units, index
    doc = np.repeat(np.arange(n), per_doc)
    base = np.cumsum(per_doc) - per_doc
    unit = np.arange(len(word)) - base[doc]
    start = lattice.start[word]
    top = gumbel(uniform(keys, np.zeros(n, np.int64), np.zeros(n, np.int64), 3))
    edge, count = walk(lattice, start, keys[doc], unit, np.zeros(len(word), np.int64), 0)
    of = np.repeat(np.arange(len(word)), count)
    step = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
    everywhere, nothing = np.ones(len(edge), bool), np.full(len(edge), -1.0)
    paths = [_finish(lattice, keys, top, doc[of], unit[of], step, edge, everywhere, nothing, 0)]
    tops, taken = [np.where(per_doc > 0, top, -np.inf)], {}
    for k in range(1, samples + 1):
        bests = [_segment_best(p, n) for p in paths]
        values = np.array([b for b, _ in bests])
        source = values.argmax(axis=0)
        top = values.max(axis=0)
        tops.append(top)
        if k == samples:
            break
        go = np.flatnonzero(top > -np.inf)
        parts, heads = [], []
        for d in go.tolist():
            p, at = paths[source[d]], int(bests[source[d]][1][d])
            p.left[at] = -np.inf
            old = taken.pop((int(source[d]), at), []) + [int(p.edge[at])]
            s = int(np.searchsorted(lattice.first, p.edge[at], "right")) - 1
            options = np.arange(lattice.first[s], lattice.first[s] + lattice.degree[s])
            q = lattice.q[options]
            q[np.isin(options, old)] = 0
            u = float(uniform(keys[d : d + 1], p.unit[at : at + 1], p.step[at : at + 1], 4 * k + 2)[0]) * q.sum()
            new = int(options[min(int(np.searchsorted(np.cumsum(q), u, "right")), int(np.flatnonzero(q)[-1]))])
            lo = int(np.searchsorted(p.doc, d))
            q[options == new] = 0
            heads.append((d, p, lo, at, new, old, float(q.sum())))
        if not heads:
            paths.append(Path(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0), np.zeros(0)))
            continue
        # what follows: the rest of the unit decided anew, then all later units
        begin_doc, begin_unit, begin_state, begin_step = [], [], [], []
        for d, p, _, at, new, _, _ in heads:
            u = int(p.unit[at])
            later = np.arange(base[d] + u + 1, base[d] + per_doc[d])
            state, step_, units = start[later], np.zeros(len(later), np.int64), unit[later]
            if lattice.next[new] < len(lattice.first):
                state, step_, units = (
                    np.concatenate(x) for x in (([lattice.next[new]], state), ([p.step[at] + 1], step_), ([u], units))
                )
            begin_doc.append(np.full(len(state), d))
            begin_unit.append(units)
            begin_state.append(state)
            begin_step.append(step_)
        sizes = np.array([len(x) for x in begin_doc])
        bd, bu, bs, bt = (np.concatenate(x).astype(np.int64) for x in (begin_doc, begin_unit, begin_state, begin_step))
        edge, count = walk(lattice, bs, keys[bd], bu, bt, 4 * k)
        of = np.repeat(np.arange(len(bs)), count)
        step = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + bt[of]
        cut = np.cumsum(np.r_[0, count])[np.cumsum(np.r_[0, sizes])]
        offset = 0
        for (d, p, lo, at, new, old, remaining), a, b in zip(heads, cut[:-1].tolist(), cut[1:].tolist()):
            head = slice(lo, at + 1)
            edges = np.concatenate((p.edge[head], edge[a:b]))
            edges[at - lo] = new
            fresh = np.ones(len(edges), bool)
            fresh[: at - lo] = False
            rest = np.full(len(edges), -1.0)
            rest[at - lo] = remaining
            units, steps = np.concatenate((p.unit[head], bu[of[a:b]])), np.concatenate((p.step[head], step[a:b]))
            parts.append((np.full(len(edges), d), units, steps, edges, fresh, rest))
            taken[(k, offset + at - lo)] = old
            offset += len(edges)
        paths.append(_finish(lattice, keys, top, *(np.concatenate(x) for x in zip(*parts)), salt=4 * k))
    out: list[list] = [[] if size else [(NO_IDS, 0.0, 0.0, 1.0)] for size in per_doc.tolist()]
    threshold = tops[-1]
    for k, p in enumerate(paths):
        if not len(p.doc):
            continue
        starts = np.flatnonzero(np.r_[True, p.doc[1:] != p.doc[:-1]])
        stops = np.r_[starts[1:], len(p.doc)]
        ids, cuts = _ids(encoder, lattice.kind[p.edge], stops)
        log_p = p.prefix[stops - 1] + lattice.log_q[p.edge[stops - 1]]
        own = p.doc[starts]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(log_p - threshold[own]))
        lo = 0
        for d, hi, a, b, c in zip(own.tolist(), cuts.tolist(), log_p.tolist(), tops[k][own].tolist(), inclusion.tolist()):
            out[d].append((ids[lo:hi], a, b, c))
            lo = hi
    return out


def _ids(encoder: Encoder, kind: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids with bytes spelled out, and where every text ends in them."""
    spelt = np.flatnonzero(kind < 0)
    if not len(spelt):
        return kind, stops
    code = -1 - kind[spelt].astype(np.int64)
    size = np.ones(len(kind), np.int64)
    size[spelt] = own = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    ids = np.repeat(kind, size)
    raw = np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)
    ids[np.arange(len(raw)) + np.repeat(spelt - np.arange(len(spelt)), own)] = raw.astype(np.int32) + encoder.first_byte
    return ids, stops + np.r_[0, np.cumsum(own - 1)][np.searchsorted(spelt, stops)]


def _cuts(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that have `limit` characters together, or what is left."""
    lo = size = 0
    for hi, n in enumerate(sizes, 1):
        size += n
        if size >= limit or hi == len(sizes):
            yield lo, hi
            lo, size = hi, 0


def encoded(
    docs: DataFrame,
    samples: int = SAMPLES,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    digest: bool = False,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """One row per input row and sample: id, sample (from 0, by perturbed value), n_pieces, log_prob, perturbed, inclusion,
    exact (decoding gives the text back), and ids or, with `digest`, ids_sha256 (of 32-bit little-endian ids).

    A text with fewer segmentations than `samples` has one row for each.  A null text is
    an empty one; it has one segmentation without pieces.  The row key is the id, so rows
    repeated with one id and text are sampled alike; a null id is a key of its own.  An
    empty table gives an empty result.  Other columns are not read.  Texts are walked together
    until they have `batch_chars` characters: fewer take less memory in a task and more time,
    and give the same rows.
    """
    vocabulary = Vocabulary.load(model)  # of fixed size; travels with the task
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_key"), whole(text_col).alias("_text"))
    name = "ids_sha256" if digest else "ids"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b in batches:
            keys = np.array([xxhash.xxh64_intdigest("" if k is None else "k" + k, seed) for k in b.column("_key").to_pylist()], np.uint64)
            for lo, hi in _cuts(pc.utf8_length(b.column("_text")).to_pylist(), batch_chars):
                texts = b.column("_text").slice(lo, hi - lo).to_pylist()
                found = sample(encoder, texts, keys[lo:hi], samples)
                flat = [(i, k, *s) for i, own in enumerate(found) for k, s in enumerate(own)]
                raw = [(" " + t).encode() if t else b"" for t in texts]  # with the leading space
                row, number, ids, log_p, perturbed, inclusion = zip(*flat)
                flat_ids, ends = np.concatenate(ids), np.cumsum([*map(len, ids)])
                if digest:
                    values = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
                else:
                    values = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat_ids.astype(np.int32)))
                columns = {
                    "sample": pa.array(number, pa.int32()),
                    "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "log_prob": pa.array(log_p, pa.float64()),
                    "perturbed": pa.array(perturbed, pa.float64()),
                    "inclusion": pa.array(inclusion, pa.float64()),
                    "exact": pa.array(encoder.decodes(flat_ids, ends, [raw[i] for i in row]), pa.bool_()),
                    name: values,
                }
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(lo, hi - lo).take(pa.array(row)), *columns.values()], ["_id", *columns])

    schema = f"_id {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, inclusion double, exact boolean, " + (
        "ids_sha256 string" if digest else "ids array<int>"
    )
    return rows.mapInArrow(step, schema).withColumnRenamed("_id", id_col)


@query("op8_sampled_pieces")
def op8(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), digest=True)
