"""Exact deduplication as a tree merge of digest runs.

Every row gets a digest of its text without white space and belongs to one of R
runs, R being the first power of two that reaches the number of shuffle
partitions.  A run is reduced to one entry per digest: the best row and a count.
Rounds then merge `fan` runs at a time (run number shifted by `fan_bits`) until
one run is left; the key of every round is (run, digest), so the work of a round
is spread over all tasks and a text that a third of all rows share is already
down to one entry per run after the first, map-side, step.

An entry is verified at every level: besides the SHA-256 digest the key holds the
byte length and an independent 64-bit hash, so texts with equal digests and
different contents never merge.

The way back has no hot key either: the final entry of a digest goes to its at
most R run entries, and these to the rows by (run, digest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from uwspark.staging import stage

from .common import BLANKS, partitions, query, table, whole

KEY = ["_digest", "_bytes", "_witness"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = 3) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the row with the most code
    points, then the smallest id, stays.  Null and empty texts are equal to each
    other.  A null id stays only if its group has no other id; rows repeated with
    one id share the verdict.  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    bits = max(1, (partitions(spark) - 1).bit_length())
    text = whole(text_col)
    bare = F.translate(text, BLANKS, "")
    rows = stage(
        docs.select(F.col(id_col).alias("_id"), bare.alias("_bare"), F.char_length(text).alias("_points"))
        .select(
            "_id",
            F.sha2("_bare", 256).alias("_digest"),
            F.octet_length("_bare").alias("_bytes"),
            F.xxhash64("_bare").alias("_witness"),
            "_points",
        )
        .withColumn("_run", F.pmod(F.xxhash64("_id", "_points"), F.lit(1 << bits)).cast("int"))
    )
    best = F.struct((-F.col("_points")).alias("points"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"))
    first = rows.groupBy("_run", *KEY).agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_n"))
    level, left = first, bits
    while left > 0:
        step = min(fan_bits, left)
        level = (
            level.groupBy(F.shiftright("_run", step).alias("_run"), *KEY)
            .agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
        )
        left -= step
    final = level.where("_n > 1").select(*KEY, F.col("_best.id").alias("_keep"), F.col("_n").alias("_size"))
    per_run = first.select("_run", *KEY).join(final, KEY)
    out = rows.join(per_run, ["_run", *KEY], "left")
    alone = F.col("_size").isNull()
    keep = F.when(alone, F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents),
w as (
  select *, first_value(doc_id) over (partition by h order by points desc, doc_id nulls last) as keep_id,
         count(*) over (partition by h) as group_size
  from d)
select doc_id, keep_id, group_size, (keep_id is not distinct from doc_id) as kept, h as text_sha256 from w
"""


@query("op4_exact_dedup", SQL)
def op4(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
