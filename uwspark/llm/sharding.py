"""Proportional stratified interleaving into shards (law: rows).

Rows are shuffled by a seeded hash inside their source and get the fractional
rank (rank - 1/2) / rows of the source.  Sorting all rows by that fraction deals
every source evenly along the line, so any contiguous cut has the mixture of the
whole; the line is cut into pieces whose row counts differ by one at most.

No source and no global order is sorted in one task: both rankings are done
inside blocks of the hash or fraction range, and the start of a block is a
running total over block counts.  The number of blocks is eight times the number
of shuffle partitions, so it follows the size of the cluster, and the totals are
windows over that many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from uwspark.staging import stage

from .common import partitions, query, table, whole

SEED = "shard-1"


def interleave(
    docs: DataFrame,
    shards: int = 16,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    blocks: int | None = None,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    A null source is a source of its own.  A null text has size 1 and the checksum of
    an empty text.  Rows repeated with one id are ranked one after another; rows equal
    in id and text are interchangeable.  An empty table gives an empty result.  Columns
    of other names are not read.
    """
    n_blocks = blocks or 8 * partitions(docs.sparkSession)
    text = whole(text_col)
    shuffled = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_mix")
    rows = stage(
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_source"),
            (F.octet_length(text).cast("bigint") + 1).alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            shuffled,
        ).withColumn(
            "_blk",
            F.floor(F.conv(F.substring("_mix", 1, 8), 16, 10).cast("double") * n_blocks / F.lit(float(1 << 32))).cast("int"),
        )
    )
    in_source = W.partitionBy("_source")
    starts = (
        rows.groupBy("_source", "_blk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_source.orderBy("_blk")) - F.col("_n"))
        .withColumn("_all", F.sum("_n").over(in_source))
        .drop("_n")
    )
    nth = F.row_number().over(W.partitionBy("_source", "_blk").orderBy("_mix", F.col("_id").isNull(), "_id", "_crc", "_size"))
    fraction = (2 * (F.col("_before") + F.col("_nth")) - 1).cast("double") / (2 * F.col("_all")).cast("double")
    placed = stage(
        rows.withColumn("_nth", nth)
        .join(starts.hint("merge"), ["_source", "_blk"])
        .withColumn("_f", fraction)
        .select("_id", "_source", "_size", "_crc", "_f", F.floor(F.col("_f") * n_blocks).cast("int").alias("_blk"))
    )
    line = W.partitionBy(F.lit(0))
    cuts = (
        placed.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(line.orderBy("_blk")) - F.col("_n"))
        .withColumn("_all", F.sum("_n").over(line))
        .drop("_n")
    )
    nth = F.row_number().over(W.partitionBy("_blk").orderBy("_f", "_source", F.col("_id").isNull(), "_id", "_crc", "_size"))
    return (
        placed.withColumn("_nth", nth)
        .join(cuts.hint("merge"), "_blk")
        .withColumn("_pos", F.col("_before") + F.col("_nth") - 1)
        .withColumn("_shard", F.expr(f"(_pos * {shards}L) div _all"))
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_pos") - F.expr(f"(_shard * _all + {shards - 1}L) div {shards}L")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


@query("op3_interleaved_shards")
def op3(spark, sf_dir):
    return interleave(table(spark, sf_dir, "documents"))
