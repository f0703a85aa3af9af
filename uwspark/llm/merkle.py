"""Merkle manifest of a data set, its trees stored in the van Emde Boas layout.

Every row is a leaf; the leaves of a group (a language) in the order of their ids are
the leaves of one binary tree, and the roots of the groups are the leaves of the tree
above.  While a level has several nodes, every two consecutive ones become their hash;
the last one of an odd level is hashed alone.

A tree is cut into aligned subtrees of `height` levels.  Each is one row of a block
table, a blob of 32-byte nodes in the van Emde Boas order: the upper half of the levels
first, then the subtrees that hang below it one after another, each laid out by the same
rule.  The address of a node follows from its level and index alone, so building and
sibling look-ups read short runs of the blob whatever the cache.  The roots of the blocks
are the leaves of the next layer of blocks, until every group has a single one.

Places of the leaves come from a range partitioning of (group, id) and one running total
per group and partition.  A task holds one block at a time, so a group with a third of
all rows is as many tasks as it has blocks.  The way down attaches to every block the
path above it, one row a block, and ends with one path per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from uwspark.staging import stage

from .common import partitions, query, table

#: Levels of hashing inside one block: 256 leaves, 16 kB of nodes.
HEIGHT = 8
NODE = 32
#: Where the sibling stands: after the node, before it, or nowhere.
AFTER, BEFORE, ALONE = 0, 1, 2
TREE = ["_none", "_tree"]
PATH = "array<struct<side: int, sibling: string>>"
STEPS = pa.list_(pa.struct([("side", pa.int32()), ("sibling", pa.string())]))
NOTHING = pa.array([], pa.string())


# --------------------------------------------------------------------------- one block


@lru_cache(None)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Address of every node, by depth from the root, of a full tree of `levels` levels."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    lower = levels - upper
    tops, parts = addresses(upper), addresses(lower)
    first, size = (1 << upper) - 1, (1 << lower) - 1
    below = []
    for depth, inner in enumerate(parts):
        index = np.arange(1 << (upper + depth))
        below.append(first + (index >> depth) * size + inner[index & ((1 << depth) - 1)])
    return (*tops, *below)


def climb(leaves: Sequence[bytes], height: int) -> bytes:
    """All nodes of a subtree of `height` levels over its first leaves, in the layout; missing nodes are zero."""
    where = addresses(height + 1)
    out = bytearray(NODE * ((2 << height) - 1))
    level = list(leaves)
    for depth in range(height, -1, -1):
        for node, address in zip(level, where[depth].tolist()):
            out[address * NODE : (address + 1) * NODE] = node
        hexes = [node.hex() for node in level]
        level = [hashlib.sha256("".join(hexes[i : i + 2]).encode()).digest() for i in range(0, len(hexes), 2)]
    return bytes(out)


def siblings(nodes: bytes, height: int, count: int, leaf: int) -> list[tuple[int, str]]:
    """(side, sibling) of a leaf and its ancestors up to the root of the subtree, read by address."""
    where = addresses(height + 1)
    out = []
    for depth in range(height, 0, -1):
        other = leaf ^ 1
        if other < count:
            at = int(where[depth][other]) * NODE
            out.append((BEFORE if leaf & 1 else AFTER, nodes[at : at + NODE].hex()))
        else:
            out.append((ALONE, ""))
        leaf, count = leaf >> 1, (count + 1) >> 1
    return out


def _block(leaves: pa.Table) -> pa.Table:
    """The block row of one group of leaves: (tree, block, height, members, nodes, root)."""
    first = leaves.slice(0, 1)
    rows = sorted(zip(leaves["pos"].to_pylist(), leaves["digest"].to_pylist()))
    height = first["height"][0].as_py()
    nodes = climb([bytes.fromhex(d) for _, d in rows], height)
    root = nodes[:NODE].hex()  # the root is the first node of the layout
    return pa.table(
        {
            **{c: first[c] for c in (*TREE, "block", "height")},
            "members": pa.array([len(rows)], pa.int32()),
            "nodes": pa.array([nodes], pa.binary()),
            "root": [root],
        }
    )


BLOCK = "_none boolean, _tree string, block bigint, height int, members int, nodes binary, root string"


def _down(blocks: pa.Table) -> pa.Table:
    """The paths of the leaves of one block: (tree, pos, path, top, all)."""
    b = blocks.to_pylist()[0]
    above = [(s["side"], s["sibling"]) for s in b["path"]]
    paths = [siblings(b["nodes"], b["height"], b["members"], i) + above for i in range(b["members"])]
    n = b["members"]
    return pa.table(
        {
            **{c: pa.array([b[c]] * n, blocks.schema.field(c).type) for c in TREE},
            "pos": pa.array([(b["block"] << b["height"]) + i for i in range(n)], pa.int64()),
            "path": pa.array([[{"side": s, "sibling": d} for s, d in p] for p in paths], STEPS),
            "top": pa.array([b["top"]] * n, pa.string()),
            "all": pa.array([b["all"]] * n, pa.string()),
        }
    )


DOWN = f"_none boolean, _tree string, pos bigint, path {PATH}, top string, all string"


# --------------------------------------------------------------------------- trees


def placed(leaves: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Leaves with `pos`, their place inside (_none, _tree), and `size`, the leaves of that tree."""
    spread = leaves.repartitionByRange(partitions(leaves.sparkSession), *TREE, *order)
    run = stage(
        spread.sortWithinPartitions(*TREE, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    starts = run.groupBy(*TREE, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    prior = W.partitionBy(*TREE).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(
        *TREE,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_start"),
        F.sum("_n").over(W.partitionBy(*TREE)).alias("size"),
    )
    return (
        run.join(starts, [*TREE, "_part"])
        .withColumn("pos", (F.col("_start") + F.col("_at") - F.col("_first")).cast("bigint"))
        .drop("_part", "_at", "_first", "_start")
    )


def build(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Block tables from the leaves up: leaves are (tree, pos, digest, size); the last layer has one block a tree."""
    span = 1 << height
    largest = leaves.agg(F.max("size")).first()[0] or 0
    layers, level = [], leaves
    while largest:
        # a tree that fits one block ends there, at its own height; others fill all levels
        own = F.when(F.col("size") > span, height).when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
        rows = level.select(*TREE, F.shiftright("pos", height).alias("block"), "pos", "digest", own.cast("int").alias("height"))
        layers.append(stage(rows.groupBy(*TREE, "block").applyInArrow(_block, BLOCK)))
        if largest <= span:
            break
        sizes = level.select(*TREE, "size").distinct().where(F.col("size") > span)
        up = F.shiftright(F.col("size") + (span - 1), height)
        level = layers[-1].join(sizes, TREE).select(*TREE, F.col("block").alias("pos"), F.col("root").alias("digest"), up.alias("size"))
        largest = (largest + span - 1) >> height
    return layers


def tops(layers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree: the blocks of a layer that no block above covers."""
    out = None
    for i, layer in enumerate(layers):
        own = layer.select(*TREE, "root")
        if i + 1 < len(layers):
            own = own.join(layers[i + 1].select(*TREE).distinct(), TREE, "left_anti")
        out = own if out is None else out.unionByName(own)
    return out


def descend(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Block rows of the lowest layer with `path`, `top` and `all` above them.

    `above` has (tree, path, top, all): what continues over the root of each tree.
    """
    known = None
    for i in range(len(layers) - 1, -1, -1):
        first = above if i + 1 == len(layers) else above.join(layers[i + 1].select(*TREE).distinct(), TREE, "left_anti")
        paths = first.select(*TREE, F.lit(0).cast("bigint").alias("block"), "path", "top", "all")
        if known is not None:
            down = known.groupBy(*TREE, "block").applyInArrow(_down, DOWN)
            paths = paths.unionByName(down.withColumnRenamed("pos", "block"))
        known = layers[i].join(paths, [*TREE, "block"])
    return known


def _rows_down(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """Rows of one block with the path of each."""
    if not rows.num_rows:
        return rows.append_column("path", pa.array([], STEPS)).append_column("subroot", NOTHING).append_column("root", NOTHING)
    below = _down(blocks)
    first = blocks["block"][0].as_py() << blocks["height"][0].as_py()
    at = pa.array([p - first for p in rows["pos"].to_pylist()], pa.int64())
    out = rows.append_column("path", below["path"].take(at))
    return out.append_column("subroot", below["top"].take(at)).append_column("root", below["all"].take(at))


# --------------------------------------------------------------------------- interface


def leaf_of(columns: Sequence[Column]) -> Column:
    """Hash of a row: every value as byte count, colon and text, `-` for null."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""

    def step(node: Column, s: Column) -> Column:
        other = s["sibling"]
        return F.sha2(F.when(s["side"] == BEFORE, F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, leaf, step)


def proof_of(path: Column) -> Column:
    """Hash of the siblings of a path, concatenated from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """Leaves with their places and the block tables of the group trees and of the tree above, all staged."""

    leaves: DataFrame
    layers: list[DataFrame]
    crown: list[DataFrame]
    groups: DataFrame
    height: int = HEIGHT

    def blocks(self) -> DataFrame:
        """One table of all blocks, to be stored next to the data: (crown, layer, tree, block, height, members, nodes, root)."""
        out = None
        for crown, layers in ((False, self.layers), (True, self.crown)):
            for i, layer in enumerate(layers):
                part = layer.select(F.lit(crown).alias("crown"), F.lit(i).alias("layer"), *layer.columns)
                out = part if out is None else out.unionByName(part)
        return out

    def proofs(self) -> DataFrame:
        """Every leaf row with `path`, `subroot` and `root`."""
        rows = self.leaves.withColumn("block", F.shiftright("pos", self.height))
        if not self.layers:
            return rows.select(
                "*", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root")
            )
        whole = tops(self.crown).select("root").first()[0]  # one digest
        start = tops(self.crown).select(*TREE, F.array().cast(PATH).alias("path"), F.col("root").alias("top"), F.lit(whole).alias("all"))
        last = descend(self.crown, start).groupBy(*TREE, "block").applyInArrow(_down, DOWN)
        above = self.groups.join(last.select("pos", "path"), "pos").select(
            *TREE, "path", F.col("digest").alias("top"), F.lit(whole).alias("all")
        )
        blocks = descend(self.layers, stage(above))
        key = [*TREE, "block"]
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", path {PATH}, subroot string, root string"
        return rows.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(_rows_down, schema)


def manifest(
    docs: DataFrame,
    leaf: Column,
    group_col: str = "lang",
    id_col: str = "doc_id",
    carry: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> Manifest:
    """Manifest of all rows; `carry` names columns that stay with the leaves, `height` is that of a block.

    Trees are ordered by group, null first, then by its bytes; leaves by id, null last, then by
    leaf hash, so rows repeated under one id are leaves of their own and equal ones are
    interchangeable.  A null group is a group of its own, apart from the empty string.  Null and
    empty values have hashes of their own.  An empty table has no blocks and no proofs.  Columns
    not named, whatever they are called, are not read.
    """
    spark: SparkSession = docs.sparkSession
    group = F.col(group_col)
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            group.isNotNull().alias("_none"),  # false sorts first: null groups
            F.coalesce(group, F.lit("")).alias("_tree"),
            leaf.alias("digest"),
            *[c.alias(name) for name, c in (carry or {}).items()],
        ).withColumn("_place", F.monotonically_increasing_id())
    )
    # the place spreads rows that are equal in everything else
    leaves = stage(placed(rows, [F.col("id").isNull(), F.col("id"), F.col("digest"), F.col("_place")]).drop("_place"))
    layers = build(leaves, height)
    if not layers:
        return Manifest(leaves, [], [], leaves, height)
    roots = tops(layers).select(
        F.lit(True).alias("_none"),
        F.lit("").alias("_tree"),
        F.col("_none").alias("g0"),
        F.col("_tree").alias("g1"),
        F.col("root").alias("digest"),
    )
    crown_leaves = stage(placed(stage(roots), [F.col("g0"), F.col("g1")]))
    groups = crown_leaves.select(F.col("g0").alias("_none"), F.col("g1").alias("_tree"), "pos", "digest")
    return Manifest(leaves, layers, build(crown_leaves.drop("g0", "g1"), height), groups, height)


def verified(m: Manifest, claimed: str = "digest") -> DataFrame:
    """Every leaf with its proof, the root that follows from the `claimed` leaf, and whether that is the root."""
    return m.proofs().select(
        "*", proof_of(F.col("path")).alias("proof_sha256"), fold(F.col(claimed), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
with recursive
part as (
  select doc_id, lang,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as honest,
    coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as forged,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    list_reduce(list_prepend(4294967295::bigint, list_transform(generate_series(1, length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) as crc
  from documents),
leaf as (
  select doc_id, lang, sha256(head || honest || tail) as leaf,
    case when xor(crc, 4294967295) % 7 = 0 then sha256(head || forged || tail) else sha256(head || honest || tail) end as claimed,
    row_number() over (partition by lang order by doc_id nulls last, sha256(head || honest || tail)) - 1 as pos,
    count(*) over (partition by lang) as size
  from part),
tree as (
  select lang, 0 as level, pos, leaf as digest, size from leaf
  union all
  select lang, level + 1, pos, sha256(string_agg(digest, '' order by p)), (any_value(size) + 1) // 2
  from (select lang, level, pos // 2 as pos, pos as p, digest, size from tree where size > 1)
  group by lang, level, pos),
roots as (
  select lang, digest as subroot, level as depth, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as size
  from tree where size = 1),
crown as (
  select 0 as level, pos, subroot as digest, size from roots
  union all
  select level + 1, pos, sha256(string_agg(digest, '' order by p)), (any_value(size) + 1) // 2
  from (select level, pos // 2 as pos, pos as p, digest, size from crown where size > 1) group by level, pos),
walk as (
  select l.doc_id, l.pos as id, l.lang, l.leaf, l.claimed as node, '' as sibs, l.pos as pos, 0 as level, r.depth, r.pos as crown_pos
  from leaf l join roots r on l.lang is not distinct from r.lang
  union all
  select doc_id, id, w.lang, leaf,
    case when t.digest is null then sha256(node) when w.pos % 2 = 1 then sha256(t.digest || node) else sha256(node || t.digest) end,
    sibs || coalesce(t.digest, ''), w.pos // 2, w.level + 1, depth, crown_pos
  from walk w left join tree t on t.lang is not distinct from w.lang and t.level = w.level and t.pos = xor(w.pos, 1)
  where w.level < depth),
over_it as (
  select doc_id, id, lang, leaf, node, sibs, crown_pos as pos, 0 as level from walk where level = depth
  union all
  select doc_id, id, lang, leaf,
    case when c.digest is null then sha256(node) when o.pos % 2 = 1 then sha256(c.digest || node) else sha256(node || c.digest) end,
    sibs || coalesce(c.digest, ''), o.pos // 2, o.level + 1
  from over_it o left join crown c on c.level = o.level and c.pos = xor(o.pos, 1)
  where o.level < (select max(level) from crown)),
top as (select digest as root, level as depth from crown where size = 1)
select o.doc_id, o.leaf, r.subroot, top.root, sha256(o.sibs) as proof_sha256, o.node as folded_root, o.node = top.root as verified
from over_it o, top join roots r on true
where o.level = top.depth and r.lang is not distinct from o.lang
"""


@query("op13_merkle_manifest", SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    forged = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = manifest(docs, leaf_of(fields), carry={"claimed": F.when(hit, leaf_of(forged)).otherwise(leaf_of(fields))})
    return verified(m, "claimed").select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")
