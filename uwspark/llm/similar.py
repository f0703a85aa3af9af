"""Near copies by SimHash fingerprints and, for what those leave, min-hash bands; the shingle sets confirm them.

Two texts are near copies when their sets of word shingles (64-bit hashes) have a
Jaccard similarity of 0.8 or more.  Texts whose fingerprints are connected by the links
of `simhash.near_links` meet; it misses no pair within its radius.  Copies further apart
than that meet in one of BANDS keys of ROWS minima each: a pair at 0.8 meets in no band
in 3 of a million cases, at every length of text, and less often above.  No candidate is
linked before its sets are compared.

Equal sets are one member.  A large group is not compared pair by pair: each member
is first compared with the most central member it meets, the one with the most
neighbours.  Then all members that meet and are not yet connected are compared, buckets
of more than LANES members in pairs of chunks, so no task holds a bucket.  The sets of
a cell of two chunks are compared at once as a product of matrices, and the cell answers
with a spanning forest of what it found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from uwspark.staging import stage

from . import simhash
from .common import whole
from .components import components

SEED = 42
BANDS, ROWS = 32, 5
#: Differing bits of fingerprints that meet; `op1_simhash` links at the same.
RADIUS = 3
LANES = 512
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted different hashes of the word shingles, A-Z lower-cased; a shorter text is one shingle, no words are none."""
    tokens = text.encode().lower().split()  # bytes: ASCII only, for both
    if not tokens:
        return np.zeros(0, np.uint64)
    grams = zip(*(tokens[i:] for i in range(words))) if len(tokens) >= words else [tokens]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(g), SEED) for g in grams), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band; none of an empty set."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        mixed = hashes[lo : lo + 1024, None] * _ODD + _ADD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
        least = np.minimum(least, mixed.min(axis=0))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _MIX[:, 0]


def _sketches(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sets, prints, keys, ends = [], [], [], [np.zeros(0, np.uint64)], [0]
            for t in b.column("_text").to_pylist():
                own = shingles(t, words)
                texts.append(hashlib.md5(t.encode()).digest())
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(simhash.fingerprint(t))
                keys.append(band_keys(own))
                ends.append(ends[-1] + len(keys[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(texts, pa.binary()), pa.array(sets, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists],
                ["_id", "_digest", "_set", "_fp", "_keys"],
            )

    return of


def _sets(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [pa.array(shingles(t, words).view(np.int64)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_set"), pa.array(own, pa.list_(pa.int64()))], ["_set", "_shingles"])

    return of


def met_by_fingerprint(prints: DataFrame) -> DataFrame:
    """(_set, _key): sets whose fingerprints (_set, _fp) are connected by links within the radius have a key in common."""
    forest = components(simhash.near_links(prints.select("_fp").distinct(), RADIUS))
    rooted = prints.join(forest, prints["_fp"] == forest["u"], "left")
    return rooted.select("_set", F.xxhash64(F.coalesce("v", "_fp")).alias("_key")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of 0.8 or more, in whole numbers."""
    a, b = (sets.select(F.col("_set").alias(n), F.col("_shingles").alias(f"_{n}")) for n in "uv")
    both = F.size(F.array_intersect("_u", "_v"))
    return pairs.join(a, "u").join(b, "v").where(9 * both >= 4 * (F.size("_u") + F.size("_v"))).select("u", "v")


def _central(meet: DataFrame) -> DataFrame:
    """(u, v): of every member the most central one that it meets."""
    score = meet.groupBy("_set").agg(F.sum("_n").alias("_score"))
    hub = meet.join(score, "_set").groupBy("_key").agg(F.max(F.struct("_score", "_set")).alias("_hub"))
    own = meet.join(hub, "_key").groupBy("_set").agg(F.max("_hub").alias("_hub"))
    return own.select(F.col("_set").alias("u"), F.col("_hub._set").alias("v")).where("u <> v")


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    seen = np.zeros(len(near), bool)
    heads, tails = [], []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root], reached = True, [root]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(near[at] & ~seen)
            seen[new] = True
            heads += [at] * len(new)
            tails += new.tolist()
            reached += new.tolist()
    return np.array(heads, np.int64), np.array(tails, np.int64)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of one cell: products of the incidence matrix, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one member is in no intersection
    kept = times[column] > 1
    place = np.cumsum(times > 1) - 1
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _cell_links(cell: pa.Table) -> pa.Table:
    """A spanning forest of the similar pairs of one cell, its members' known connections taken as given."""
    sets = [np.asarray(s.values.to_numpy(), np.int64) for s in cell["_shingles"].combine_chunks()]
    size = np.array([len(s) for s in sets])
    label = cell["_label"].combine_chunks().dictionary_encode().indices.to_numpy()
    near = 9 * _common(sets) >= 4 * (size[:, None] + size[None, :])
    np.fill_diagonal(near, False)
    same = label[:, None] == label[None, :]
    u, v = _forest(near & ~same)
    names = cell["_set"].combine_chunks()
    return pa.table({"u": names.take(pa.array(u)), "v": names.take(pa.array(v))})


def _apart(meet: DataFrame, joined: DataFrame, sets: DataFrame, lanes: int) -> DataFrame:
    """(u, v): confirmed links that connect, with `joined`, all similar members that meet.

    Members of a bucket that are not all connected yet are compared inside their cells, two chunks of the
    bucket at a time; a cell returns a spanning forest, so no pair is ever a row.
    """
    label = F.coalesce("v", "_set").alias("_label")
    labelled = stage(meet.join(joined, meet["_set"] == joined["u"], "left").select("_key", "_set", label))
    mixed = labelled.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_label").alias("_a"), F.max("_label").alias("_b"))
    chunks = F.ceil(F.col("_n") / lanes).cast("int").alias("_c")
    dealt = labelled.join(mixed.where("_a <> _b").select("_key", chunks), "_key").withColumn("_own", F.pmod(F.xxhash64("_set"), F.col("_c")).cast("int"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_other")).select(
        F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_cell"), "_set", "_label"
    )
    # buckets of the same members are one cell
    who = cells.groupBy("_cell").agg(F.sum(F.xxhash64("_set").cast("decimal(38,0)")).alias("_who"), F.count(F.lit(1)).alias("_k"))
    once = who.groupBy("_who", "_k").agg(F.min("_cell").alias("_cell")).select("_cell")
    full = cells.join(once, "_cell").join(sets, "_set").select("_cell", "_set", "_label", "_shingles")
    return full.groupBy("_cell").applyInArrow(_cell_links, "u binary, v binary").distinct()


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, lanes: int = LANES) -> DataFrame:
    """(_id, _digest, _n), one row per group of near copies: id and text (MD5) of its first document, and rows with both.

    First is the smallest id, null after all others, then the smallest digest.  A null text
    is an empty one; texts without words are one group.  Rows are told apart by id and
    text, so rows without an id or with the id of others are documents of their own.
    """
    base = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    kind = dict(base.dtypes)["_id"]
    rows = base.mapInArrow(_sketches(words), f"_id {kind}, _digest binary, _set binary, _fp bigint, _keys array<bigint>")
    texts = stage(rows.groupBy("_id", "_digest", "_set", "_fp").agg(F.count(F.lit(1)).alias("_n"), F.first("_keys").alias("_keys")))
    least = F.min(F.struct(F.col("_id").isNull().alias("_last"), "_id", "_digest", "_n")).alias("_least")
    nodes = stage(texts.groupBy("_set").agg(least, F.first("_keys").alias("_keys")))
    prints = stage(texts.select("_set", "_fp").distinct())
    members = met_by_fingerprint(prints).unionByName(nodes.select("_set", F.explode("_keys").alias("_key")))
    shared = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    meet = stage(members.join(shared, "_key"))
    wanted = nodes.join(meet.select("_set").distinct(), "_set").select("_set", F.col("_least._id").alias("_who"), F.col("_least._digest").alias("_what"))
    here = base.withColumn("_digest", F.unhex(F.md5(F.col("_text").cast("binary"))))
    found = here.join(wanted, F.col("_id").eqNullSafe(F.col("_who")) & (F.col("_digest") == F.col("_what"))).groupBy("_set").agg(F.min("_text").alias("_text"))
    sets = stage(found.mapInArrow(_sets(words), "_set binary, _shingles array<bigint>"))
    star = stage(_confirmed(_central(meet), sets))
    joined = components(star)
    links = stage(_apart(meet, joined, sets, lanes))
    forest = components(joined.unionByName(links))
    root = F.coalesce("v", "_set").alias("_root")
    rooted = nodes.join(forest, nodes["_set"] == forest["u"], "left").select(root, "_least")
    return rooted.groupBy("_root").agg(F.min("_least").alias("_least")).select("_least._id", "_least._digest", "_least._n")
