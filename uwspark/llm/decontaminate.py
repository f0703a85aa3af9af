"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens that a fixed mask keeps; the tokens it ignores
may differ.  The mask 11010011 has a seed untouched by any two substitutions
inside 13 tokens, wherever they fall (checked over all placements in the tests),
so joining the seeds of both sides finds every alignment that can pass.  Around a
hit the two token sequences are laid side by side and compared token by token:
an item is found in a document when 13 aligned tokens in a row agree in at least
11; an item of 8 to 12 tokens must agree in all.  A shorter item has no seed: the hash of
its whole token sequence is looked up among the hashes of all runs of that many tokens.
Letters of scripts written without blanks are tokens of their own.

Training seeds never shuffle: the benchmark's seeds are broadcast, at most
`broadcast_seeds` of them at a time; a larger benchmark is matched in as many
blocks as that takes, every block against all documents.  Only (document, item,
offset) of hits are grouped; the texts move once, to meet them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from uwspark.staging import stage

from .common import query, table, whole

MASKS = [(0, 1, 3, 6, 7)]
SPAN = 8
WINDOW = 13
SUBSTITUTIONS = 2
BROADCAST_SEEDS = 1_000_000  # 40 MB at most


#: Thai and Lao, Myanmar, Khmer, kana, Han
UNSPACED = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}])"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; every letter of a script without blanks alone."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), UNSPACED, " $1 "), r"[^\p{L}\p{M}\p{N}]+"), "")


def _runs(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """(keep..., _seed): every different run of as many token hashes `_h` as `sizes` says."""
    found = [
        F.when(F.size("_h") >= k, F.transform(F.sequence(F.lit(0), F.size("_h") - k), lambda i: F.xxhash64(F.lit(k), *(F.get("_h", i + p) for p in range(k)))))
        .otherwise(F.array().cast("array<bigint>"))
        for k in sizes
    ]
    return rows.select(*keep, F.explode(F.array_distinct(F.concat(*found))).alias("_seed"))


def _in_blocks(train: DataFrame, test: DataFrame, limit: int) -> DataFrame:
    """`train` joined with `test` on `_seed`; at most about `limit` rows of `test` are broadcast at a time."""
    blocks = max(1, -(-test.count() // limit))
    of_block = lambda b: test.where(F.pmod(F.xxhash64("_item", "_seed"), F.lit(blocks)) == b)
    return reduce(DataFrame.unionByName, [train.join(F.broadcast(of_block(b)), "_seed") for b in range(blocks)])


def _seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """(keep..., _at, _seed): every seed of the token hashes `_h`."""

    def at(i: Column) -> Column:
        return [F.xxhash64(F.lit(k), *(F.get("_h", i + p) for p in m)) for k, m in enumerate(masks)]

    long_enough = rows.where(F.size("_h") >= SPAN)
    every = F.transform(F.sequence(F.lit(0), F.size("_h") - SPAN), lambda i: F.array(*at(i)) if len(masks) > 1 else at(i)[0])
    out = long_enough.select(*keep, F.posexplode(every).alias("_at", "_seed"))
    return out.select(*keep, "_at", F.explode("_seed").alias("_seed")) if len(masks) > 1 else out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    masks: list[tuple[int, ...]] = MASKS,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(id, item, window, matched, covered), one row per document and benchmark item it contains.

    `matched` counts equal tokens in the best window of `window` aligned tokens, `covered`
    those of the best whole alignment.  An item under 8 tokens is found where its whole token
    sequence stands; items without tokens and null or empty texts match nothing.  A null id of either side is reported as null; rows repeated with one id give one row per
    item, found if any of them has it.  Empty tables give an empty result.  Other columns
    are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    every = stage(
        benchmark.select(F.col(item_col).alias("_item"), tokens(whole(item_text)).alias("_words"))
        .where(F.size("_words") > 0).distinct()
    )
    items = every.where(F.size("_words") >= SPAN)
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    test = stage(
        _seeds(items.select("_item", F.size("_words").alias("_n"), hashed(F.col("_words")).alias("_h")), ["_item", "_n"], masks)
        .withColumnRenamed("_at", "_q").distinct()
    )
    mine = base.select("_id", tokens(F.col("_text")).alias("_words")).select("_id", hashed(F.col("_words")).alias("_h"))
    hits = _in_blocks(_seeds(mine, ["_id"], masks), test, broadcast_seeds)
    aligned = (
        hits.select("_id", "_item", "_n", (F.col("_at") - F.col("_q")).alias("_shift")).distinct()
        .groupBy("_id").agg(F.collect_list(F.struct("_item", "_n", "_shift")).alias("_hits"))
    )
    found = base.alias("d").join(aligned.alias("a"), F.col("d._id").eqNullSafe(F.col("a._id"))).select(
        "d._id", tokens(F.col("_text")).alias("_words"), "_hits"
    )
    beside = found.select(
        "_id",
        F.explode(
            F.transform(
                "_hits",
                lambda h: F.struct(
                    h["_item"].alias("item"),
                    F.greatest(-h["_shift"], F.lit(0)).alias("skip"),
                    F.slice("_words", F.greatest(h["_shift"], F.lit(0)) + 1, h["_n"] - F.greatest(-h["_shift"], F.lit(0))).alias("words"),
                ),
            )
        ).alias("h"),
    ).select("_id", F.col("h.item").alias("_item"), F.col("h.skip").alias("_skip"), F.col("h.words").alias("_mine"))
    equal = F.zip_with("_mine", F.slice("_words", F.col("_skip") + 1, F.greatest(F.size("_mine"), F.lit(1))), lambda a, b: F.when(a == b, 1).otherwise(0))
    width = F.least(F.lit(WINDOW), F.size("_words"))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.size("_eq") - F.col("_w")),
            lambda i: F.aggregate(F.slice("_eq", i + 1, F.col("_w")), F.lit(0), lambda s, x: s + x),
        )
    )
    need = F.when(F.col("_w") == WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.col("_w"))
    long = (
        beside.join(items.withColumnRenamed("_item", "_same"), F.col("_item").eqNullSafe(F.col("_same")))
        .select("_id", "_item", equal.alias("_eq"), width.alias("_w"))
        .where(F.size("_eq") >= F.col("_w"))
        .select("_id", "_item", "_w", best.alias("_best"), F.aggregate("_eq", F.lit(0), lambda s, x: s + x).alias("_sum"))
        .where(F.col("_best") >= need)
        .groupBy("_id", "_item")
        .agg(F.max("_w").alias("window"), F.max("_best").alias("matched"), F.max("_sum").alias("covered"))
    )
    brief = every.where(F.size("_words") < SPAN)
    sizes = sorted(r[0] for r in brief.select(F.size("_words")).distinct().collect())  # at most SPAN - 1
    if sizes:
        of_size = lambda k: brief.where(F.size("_words") == k).select("_item", F.lit(k).alias("_n"), hashed(F.col("_words")).alias("_h"))
        short = stage(reduce(DataFrame.unionByName, [_runs(of_size(k), ["_item", "_n"], [k]) for k in sizes]))
        same = _in_blocks(_runs(mine, ["_id"], sizes), short, broadcast_seeds)
        long = long.unionByName(
            same.groupBy("_id", "_item").agg(*(F.max("_n").alias(c) for c in ("window", "matched", "covered")))
        ).groupBy("_id", "_item").agg(*(F.max(c).alias(c) for c in ("window", "matched", "covered")))
    return long.select(
        F.col("_id").alias(id_col),
        F.col("_item").alias(item_col),
        *(F.col(c).cast("bigint").alias(c) for c in ("window", "matched", "covered")),
    )


SQL = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}])', ' \1 ', 'g'), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as w from documents),
iw as (select distinct item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}])', ' \1 ', 'g'), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as w from benchmark),
ds as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 3] || ' ' || w[p + 6] || ' ' || w[p + 7] as s
       from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from dw where len(w) >= 8)),
iss as (select item_id, q, w[q] || ' ' || w[q + 1] || ' ' || w[q + 3] || ' ' || w[q + 6] || ' ' || w[q + 7] as s
       from (select item_id, w, unnest(range(1, len(w) - 6)) as q from iw where len(w) >= 8)),
cand as (select distinct doc_id, item_id, p - q as shift from ds join iss using (s)),
eq as (
  select doc_id, item_id, shift, q, least(13, len(iw.w)) as win, (iw.w[q] = dw.w[q + shift])::int as same
  from (select cand.*, unnest(range(greatest(1, 1 - shift), least(len(iw.w), len(dw.w) - shift) + 1)) as q
        from cand join iw using (item_id) join dw using (doc_id)) c
  join iw using (item_id) join dw using (doc_id)),
run as (
  select *, sum(same) over (partition by doc_id, item_id, shift order by q rows between unbounded preceding and current row) as cum,
         count(*) over (partition by doc_id, item_id, shift order by q rows between unbounded preceding and current row) as nth
  from eq),
win as (
  select *, cum - coalesce(lag(cum, win) over (partition by doc_id, item_id, shift order by q), 0) as inside from run),
best as (
  select doc_id, item_id, shift, max(win) as win, max(inside) as best, sum(same) as total
  from win where nth >= win group by all),
total as (select doc_id, item_id, shift, sum(same) as total from eq group by all),
sizes as (select distinct len(w) as k from iw where len(w) between 1 and 7),
runs as (
  select doc_id, array_to_string(w[p : p + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw join sizes on len(w) >= k)),
brief as (
  select distinct doc_id, item_id, len(iw.w) as k from iw join runs on runs.s = array_to_string(iw.w, ' ') where len(iw.w) between 1 and 7)
select doc_id, item_id, max(win)::bigint as window, max(matched)::bigint as matched, max(covered)::bigint as covered
from (
  select doc_id, item_id, win, best as matched, t.total as covered
  from best join total t using (doc_id, item_id, shift)
  where best >= case when win = 13 then 11 else win end
  union all select doc_id, item_id, k, k, k from brief)
group by doc_id, item_id
"""


@query("op10_decontamination", SQL)
def op10(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
