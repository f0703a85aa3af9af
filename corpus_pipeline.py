"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage calls one operator of `uwspark.llm` on all that the stage before kept.
All but the last return the columns of documents.  Every row is a document of its own,
also without an id or with the id of another row: the line stage numbers the rows, null
ids last, where ids do not tell them apart; the near-duplicate stage goes by id and
text, the benchmark stage by the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from uwspark.llm import decontaminate, lines, pieces, similar, toxicity
from uwspark.llm.common import table
from uwspark.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the model is learned from the labelled rows of this input."""
    docs = docs.select(*COLUMNS)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def numbered(docs: DataFrame) -> DataFrame:
    """A `_key` of its own for every row, in the order of the ids, null last: the id, or where ids do not do a number."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null")
    if twice.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    # the place in the input spreads equal rows over tasks
    placed = docs.withColumn("_at", F.monotonically_increasing_id())
    return stage(placed.orderBy(F.col("doc_id").isNull(), "doc_id", text_key(), "_at").withColumn("_key", F.monotonically_increasing_id()).drop("_at"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template an earlier document has; a document that loses all of its text goes."""
    out = lines.deduplicated_lines(numbered(docs), id_col="_key", carry=["doc_id", "lang", "source", "n_chars"])
    changed = F.col("n_dropped") > 0
    return out.where(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group: SimHash and min-hash meet, similarity 0.8 and more on five words confirms."""
    first = similar.first_of_each(docs)
    own = docs.withColumn("_own", text_key())
    found = own.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")))
    # equal rows under one id are one document
    once = found.where("_n > 1").groupBy("doc_id", "_own").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return found.where("_n = 1").select(*COLUMNS).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    keyed = docs.withColumn("_own", text_key())
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_own").select("_own").distinct()
    return keyed.join(found, "_own", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left, a quarter of the texts at a time: the workers of the stages before are still there."""
    return pieces.encoded(docs, batch_chars=pieces.BATCH_CHARS // 4)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The first and the last stage are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
