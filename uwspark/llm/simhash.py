"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared only inside buckets: with radius r the 64 bits are cut
into r + 2 bands, and two fingerprints within the radius agree on at least two of
them, so each fingerprint goes to one bucket per pair of bands (10 for r = 3, on
25 or 26 bits each).  Equal fingerprints are one member, whatever their number.

A similarity below that of three bits in 64 needs another cut: the wide form has
128-bit fingerprints, which tell a Jaccard similarity of 0.8 from chance, and
TABLES keys of KEY_BITS bits chosen at random (but fixed) from them; the comparison
inside the buckets is the same.  The wide form loses pairs: of fingerprints that
differ in 18, 20, 22 and 25 bits the tables miss 0.6, 2.9, 7.7 and 21 %, and with
WIDE_RADIUS 0.90 of the pairs at exactly 0.8 are linked (20,000 and 5,000 simulated
pairs).  `uwspark.llm.similar` finds and confirms pairs by their shingles instead.

Inside a bucket 64 fingerprints form a block stored as 64 bit planes.  A query is
compared with a whole block at a time: the differing bits of plane after plane
are added into vertical carry-save counters, and a block is abandoned as soon as
every lane is beyond the radius.  Small buckets share a block.  A bucket larger
than LANES is dealt by a hash into chunks, and every pair of chunks becomes a cell
of its own, so no task holds a whole bucket.  A cell returns a spanning forest of
its links and not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from uwspark.staging import stage

from .common import attach_spread, query, table, whole
from .components import components

SEED = 42
LANES = 4096
TABLES, KEY_BITS = 64, 16
#: Of 128 bits over five-word shingles; 0.8 in Jaccard similarity means 18 with a deviation of 4, chance 64.
WIDE_RADIUS = 25
ENTRIES = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = 3, parts: int = 1) -> int:
    """Unsigned SimHash of 64 bits a part over word shingles, A-Z lower-cased; zero without words."""
    tokens = text.encode().lower().split()  # bytes: ASCII only, for both
    if not tokens:
        return 0
    shingles = zip(*(tokens[i:] for i in range(words))) if len(tokens) >= words else [tokens]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64)
    out = 0
    for part in range(parts):
        if part:  # further hashes of a shingle from its first one
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part)
            hashes ^= hashes >> np.uint64(32)
            hashes *= np.uint64(0xD6E8FEB86659FD93)
            hashes ^= hashes >> np.uint64(32)
        set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out |= int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0]) << 64 * part
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, parts: int = 1) -> DataFrame:
    """(_id, _fp), one row per document; `_fp` is a long, or with more parts an array of longs."""
    kept = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint(t.as_py(), words, parts).to_bytes(8 * parts, "little") for t in b.column("_text"))
            fps = pa.array(np.frombuffer(raw, np.int64))
            if parts > 1:
                fps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, parts), pa.int32()), fps)
            yield pa.RecordBatch.from_arrays([b.column("_id"), fps], ["_id", "_fp"])

    return kept.mapInArrow(of, f"_id {dict(kept.dtypes)['_id']}, _fp {'bigint' if parts == 1 else 'array<bigint>'}")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints [n, parts], padded to whole blocks: [64 parts, blocks]; lane i of a block is bit i."""
    n, parts = fps.shape
    blocks = -(-n // 64)
    padded = np.zeros((blocks * 64, parts), np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8 * parts), axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def within(queries: np.ndarray, block: np.ndarray, want: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of `block[i]` among `want[i]` whose distance to `queries[i]` is at most `radius`, as bit masks."""
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    digits = radius.bit_length()
    counters = [np.zeros(len(queries), np.uint64) for _ in range(digits)]
    over = ~want
    for p in range(len(planes)):
        carry = planes[p][block] ^ (np.uint64(0) - ((queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)))
        for c in counters:  # carry-save: add one bit to every lane's counter
            c ^= carry
            carry = carry & ~c
        over |= carry
        if p % 8 == 7:
            # lanes whose counter passed the radius before the counter overflowed
            beyond = over.copy()
            equal = np.full(len(queries), FULL)
            for d in reversed(range(digits)):
                if not radius >> d & 1:
                    beyond |= equal & counters[d]
                    equal &= ~counters[d]
                else:
                    equal &= counters[d]
            over = beyond
            open_ = over != FULL
            if not open_.all():
                live, queries, block, over = live[open_], queries[open_], block[open_], over[open_]
                counters = [c[open_] for c in counters]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _lanes(masks: np.ndarray) -> np.ndarray:
    return np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i > j) of equal group within the radius; groups of at most 64 members, sorted by group."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    place, at = np.empty(len(fps), np.int64), 0
    for s, n in zip(starts.tolist(), sizes.tolist()):  # whole groups into blocks of 64 lanes
        if at % 64 + n > 64:
            at += 64 - at % 64
        place[s : s + n] = np.arange(at, at + n)
        at += n
    laid, owner = np.zeros((at, fps.shape[1]), np.uint64), np.full(at, -1)
    laid[place], owner[place] = fps, np.arange(len(fps))
    first = np.repeat(place[starts], sizes) % 64
    lane = place % 64
    want = (np.uint64(1) << lane.astype(np.uint64)) - (np.uint64(1) << first.astype(np.uint64))  # earlier lanes of the group
    ask = np.flatnonzero(want)
    if not len(ask):
        return ask, ask
    near = within(fps[ask], place[ask] // 64, want[ask], planes_of(laid), radius)
    q, lanes = np.nonzero(_lanes(near))
    return ask[q], owner[place[ask[q]] // 64 * 64 + lanes]


def large_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between `a` and `b` (the same array: inside it), as index pairs into a ++ b."""
    same = a is b
    planes, blocks = planes_of(b), -(-len(b) // 64)
    real = np.full(blocks, FULL)
    if len(b) % 64:
        real[-1] = (np.uint64(1) << np.uint64(len(b) % 64)) - np.uint64(1)
    shift = 0 if same else len(a)
    label = np.arange(len(b) + shift)
    left, right = [], []
    for lo in range(0, len(a), max(1, ENTRIES // blocks)):
        part = a[lo : lo + max(1, ENTRIES // blocks)]
        near = within(np.repeat(part, blocks, axis=0), np.tile(np.arange(blocks), len(part)), np.tile(real, len(part)), planes, radius)
        masks = near.reshape(len(part), blocks)
        for i in np.flatnonzero(masks.any(axis=1)).tolist():
            near_i = np.flatnonzero(_lanes(masks[i]).ravel()) + shift
            labels = np.unique(np.r_[label[lo + i], label[near_i]])
            if len(labels) > 1:
                left += labels[1:].tolist()
                right += [int(labels[0])] * (len(labels) - 1)
                label[np.isin(label, labels[1:])] = labels[0]
    return np.array(left, np.int64), np.array(right, np.int64)


def _cell_links(fps: np.ndarray, cell: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole cells, sorted by cell."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    small = np.repeat((sizes <= 64), sizes) & (side < 0)
    if small.any():
        own, groups = fps[small], cell[small]
        for lo in range(0, len(own), ENTRIES):  # cut at the end of a group
            start = lo if lo == 0 else lo + int(np.searchsorted(groups[lo:], groups[lo - 1], "right")) if groups[lo] == groups[lo - 1] else lo
            end = min(len(own), lo + ENTRIES)
            if end < len(own) and groups[end] == groups[end - 1]:
                end += int(np.searchsorted(groups[end:], groups[end], "right"))
            if start < end:
                i, j = small_links(own[start:end], groups[start:end], radius)
                yield own[start:end][i], own[start:end][j]
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if small[s]:
            continue
        members, sides = fps[s : s + n], side[s : s + n]
        if (sides < 0).all():
            a = b = members
        else:
            a, b = members[sides == 0], members[sides == 1]
        if len(a) and len(b):
            i, j = large_links(a, b, radius)
            both = members if a is b else np.concatenate((a, b))
            yield both[i], both[j]


def _masks(radius: int, parts: int) -> list[int]:
    """Bits that fingerprints must have in common to meet, one mask per table."""
    if parts == 1:
        cuts = np.linspace(0, 64, radius + 3).astype(int).tolist()
        bands = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts[:-1], cuts[1:])]
        return [a | b for a, b in combinations(bands, 2)]
    rng = np.random.default_rng(SEED)
    return [sum(1 << int(b) for b in rng.choice(64 * parts, KEY_BITS, replace=False)) for _ in range(TABLES)]


def _bucket_keys(fp: list[Column], radius: int) -> Column:
    """One 64-bit key per table; the table's number is in the key."""
    keys = []
    for number, mask in enumerate(_masks(radius, len(fp))):
        part = [mask >> 64 * i & (1 << 64) - 1 for i in range(len(fp))]
        signed = [m - (1 << 64) if m >> 63 else m for m in part]
        keys.append(F.xxhash64(F.lit(number), *(c.bitwiseAND(F.lit(m).cast("bigint")) for c, m in zip(fp, signed))))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int, lanes: int = LANES, parts: int = 1) -> DataFrame:
    """(u, v): links that connect all distinct `_fp` values within the radius as the full pair graph would.

    With one part no pair within the radius is missed; with more some are, see the module's note.
    """
    own = [f"_f{i}" for i in range(parts)]
    split = fps.select(*((F.col("_fp") if parts == 1 else F.col("_fp")[i]).alias(c) for i, c in enumerate(own)))
    members = split.select(*own, F.explode(_bucket_keys([F.col(c) for c in own], radius)).alias("_key"))
    shared = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / lanes).cast("int")
    dealt = members.join(shared, "_key").select(*own, "_key", chunks.alias("_c")).select(
        *own, "_key", "_c", F.pmod(F.xxhash64(*own), F.col("_c")).cast("int").alias("_own")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_other")
    cells = dealt.select(*own, "_key", "_own", other).select(
        *own,
        F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_cell"),
        F.when(F.col("_own") == F.col("_other"), -1).when(F.col("_own") < F.col("_other"), 0).otherwise(1).cast("tinyint").alias("_side"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros((0, parts), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8))
        for b in _with_end(batches):
            if b is not None:
                values = np.stack([b.column(c).to_numpy() for c in own], axis=1).view(np.uint64)
                new = (values, b.column("_cell").to_numpy(), b.column("_side").to_numpy())
                rest = tuple(np.concatenate(x) for x in zip(rest, new))
            fp, cell, side = rest
            done = len(cell) if b is None else int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if done:
                for u, v in _cell_links(fp[:done], cell[:done], side[:done], radius):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([_node(u), _node(v)], ["u", "v"])
            rest = (fp[done:], cell[done:], side[done:])

    return cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(
        compare, "u bigint, v bigint" if parts == 1 else "u binary, v binary"
    )


def _node(fps: np.ndarray) -> pa.Array:
    """A fingerprint as one orderable value."""
    if fps.shape[1] == 1:
        return pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64))
    return pa.array([bytes(x) for x in fps], pa.binary())


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, parts: int = 1
) -> DataFrame:
    """One row per input row: its id, fingerprint (16 hex digits a part), component_id, and rows with that fingerprint.

    Documents are linked when their fingerprints differ in at most `radius` bits;
    component_id is the smallest id reachable.  A null text is an empty one and has
    fingerprint zero, linked like any other.  A null id never becomes a component_id
    unless its component has no other; rows repeated with one id are each answered.  An
    empty table gives an empty result.  Other columns are not read.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words, parts))
    fps = stage(rows.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    forest = components(near_links(fps, radius, parts=parts))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    if parts == 1:
        node, shown = F.col("_fp"), hexed(F.col("_fp"))
    else:  # the bytes that `_node` writes, least significant first
        swapped = lambda c: F.array_join(F.reverse(F.split(hexed(c), "(?<=\\G..)(?!$)")), "")
        node = F.unhex(F.concat(*(swapped(F.col("_fp")[i]) for i in range(parts))))
        shown = F.concat(*(hexed(F.col("_fp")[i]) for i in reversed(range(parts))))
    rooted = fps.withColumn("_node", node).join(
        forest.select(F.col("u").alias("_node"), F.col("v").alias("_root")), "_node", "left"
    ).withColumn("_root", F.coalesce("_root", "_node"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    values = stage(rooted.join(least, "_root").select("_fp", "component_id", "_n"))
    return attach_spread(rows, values.withColumn("n_equal", F.col("_n")), "_fp", "_n").select(
        F.col("_id").alias(id_col),
        shown.alias("fingerprint"),
        "component_id",
        "n_equal",
    )


@query("op1_simhash")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
