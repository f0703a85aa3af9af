"""Collocated phrases by set-oriented relational mining (SETM).

The words of all texts are an occurrence relation (row, at, item), sorted by row and
place.  Places leave a gap between two pieces of a text, so equal row and adjacent place
mean the same piece.  A round joins the relation of the frequent (k-1)-phrases with itself
on the adjacent place, group-counts the pairs, keeps the frequent ones as items of length k,
and semi-joins the occurrences with them before the next round.  Joins and counts move
numbers only: an item is a row of the table of its length, which names the two items it
was joined from.

The relations are written as bucketed tables, sorted inside the bucket of their rows, so the
merge joins of all rounds run without a shuffle or a sort.  A text moves once, by its row
number, before it is cut into words.  Frequent items come to the occurrences by broadcast up
to `BROADCAST_ITEMS` of them, checked by counting.  Beyond that the most frequent ones come by
broadcast; only the occurrences of others move to the items, and of these only row, place and
number come back, to the occurrences that stayed where they were.  A relation is deleted when
the next one is written, and so is what was shuffled for it.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from uwspark.staging import shared_dir, stage

from .common import WIDE, partitions, query, table, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = ".,;:!?\n\x0b\x0c\r"
#: Frequent items that are sent to every task; about 100 MB of a hash table.
BROADCAST_ITEMS = 1_000_000
MERGE = {
    # rows of one text lie in one bucket, so the bucket alone is enough to join on row and place
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # every bucket is one sorted file
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def lowered(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII characters only take the fast way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(texts: DataFrame) -> DataFrame:
    """(row, lang, at, word) of texts (row, lang, text); a break between pieces takes a place of its own."""
    marked = F.regexp_replace(lowered(F.col("text")), f"[{BREAKS}]+", " \n ")
    tokens = texts.select("row", "lang", F.posexplode(F.split(marked, "[ \t]+")).alias("at", "word"))
    return tokens.where("word <> '' and word <> '\n'")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _relation(spark: SparkSession, rows: DataFrame, relations: list[tuple[str, str]]) -> DataFrame:
    """Occurrences (row, at, item), already dealt out by row, written in one sorted file per bucket; the relation before goes."""
    name = f"uwspark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/uwspark-{spark.sparkContext.applicationId}/{name}"
    relations.append((name, path))
    rows.write.bucketBy(partitions(spark), "row").sortBy("row", "at").option("path", path).saveAsTable(name)
    _drop(spark, relations, 1)
    return spark.table(name)


def _drop(spark: SparkSession, relations: list[tuple[str, str]], keep: int) -> None:
    """Deletes all relations but the last `keep`, and the shuffle files of queries that are over, which go with the driver's garbage."""
    while len(relations) > keep:
        name, path = relations.pop(0)
        spark.sql(f"drop table if exists {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def _broadcast_from(items: DataFrame, limit: int) -> float:
    """The least count of the items that go to every task: the `limit` most frequent ones, and those with a `WIDE`th of all occurrences."""
    upto = F.sum("_items").over(W.orderBy(F.desc("n")))  # one row for each count that occurs
    counts = items.groupBy("n").agg(F.count(F.lit(1)).alias("_items")).withColumns({"_upto": upto, "_all": F.sum(F.col("n") * F.col("_items")).over(W.partitionBy())})
    found = counts.agg(F.min(F.when(F.col("_upto") <= limit, F.col("n"))).alias("cut"), F.max("_all").alias("all")).first()
    return found["all"] / WIDE if found["cut"] is None else min(found["cut"], found["all"] / WIDE)


def _attached(rows: DataFrame, items: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(row, at, item) of the rows (row, at, keys) whose keys `items` (keys, id, n) holds, lying by row as they did."""
    if items.count() <= limit:
        return rows.join(F.broadcast(items.select(*keys, "id")), keys).select("row", "at", F.col("id").alias("item"))
    cut = _broadcast_from(items, limit)
    top = F.broadcast(items.where(F.col("n") >= cut).select(*keys, "id"))
    rest = items.where(F.col("n") < cut).select(*keys, F.col("id").alias("_far"))
    far = rows.join(top, keys, "left_anti").join(rest, keys).select("row", "at", "_far")
    far = far.repartition(partitions(rows.sparkSession), "row").hint("merge")
    near = rows.join(top, keys, "left").select("row", "at", "id").join(far, ["row", "at"], "left")
    return near.select("row", "at", F.coalesce("id", "_far").alias("item")).where("item is not null")


def _numbered(counts: DataFrame) -> DataFrame:
    """Items with a number each, fixed by writing them."""
    return stage(counts.withColumn("id", F.monotonically_increasing_id()))


def mine(
    docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang", limit: int = BROADCAST_ITEMS
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of up to `longest` words, and the word counts of the languages.

    Phrases: (k, id, lang, phrase, n, heads, tails, cover), where heads[i] and tails[i] are the
    counts of the first i + 1 words and of the words after them, and cover is the count of the
    most frequent frequent phrase that is one word longer and holds this one, null without one.
    Any still longer phrase around it is at most as frequent as that one.
    Totals: (lang, total).
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(lang_col, F.lit("und")).alias("lang"), whole(text_col).alias("text")
    )
    counted = stage(_words(texts).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    items = _numbered(counted.where(F.col("n") >= least))
    empty = F.array().cast("array<bigint>")
    known = items.select("id", "lang", F.array("word").alias("words"), "n", empty.alias("heads"), empty.alias("tails"))
    relations: list[tuple[str, str]] = []
    levels: list[DataFrame] = []
    try:
        rows = _attached(_words(texts.repartition(partitions(spark), "row")), items, ["lang", "word"], limit)
        for k in range(2, longest + 1):
            with _settings(spark, MERGE):
                now = _relation(spark, rows, relations)
                after = now.select("row", (F.col("at") - 1).alias("at"), F.col("item").alias("tail"))
                pairs = now.withColumnRenamed("item", "head").hint("merge").join(after, ["row", "at"])
                items = _numbered(pairs.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
                levels.append(known)
                if k < longest:
                    rows = _attached(pairs, items, ["head", "tail"], limit)
            first = known.select(F.col("id").alias("head"), "lang", "words", F.col("n").alias("_a"), F.col("heads").alias("_heads"))
            last = known.select(F.col("id").alias("tail"), F.element_at("words", -1).alias("_word"), F.col("n").alias("_b"), F.col("tails").alias("_tails"))
            known = stage(
                items.join(first, "head")
                .join(last, "tail")
                .select(
                    "id",
                    "head",
                    "tail",
                    "lang",
                    F.concat("words", F.array("_word")).alias("words"),
                    "n",
                    F.concat("_heads", F.array("_a")).alias("heads"),
                    F.concat(F.array("_b"), "_tails").alias("tails"),
                )
            )
        levels.append(known)
    finally:
        _drop(spark, relations, 0)
    out = None
    for k in range(2, longest + 1):
        level = levels[k - 1].withColumn("k", F.lit(k))
        if k < longest:
            up = levels[k]
            around = up.select(F.col("head").alias("id"), F.col("n").alias("cover")).unionByName(up.select(F.col("tail").alias("id"), F.col("n").alias("cover")))
            level = level.join(around.groupBy("id").agg(F.max("cover").alias("cover")), "id", "left")
        else:
            level = level.withColumn("cover", F.lit(None).cast("bigint"))
        level = level.select("k", "id", "lang", F.array_join("words", " ").alias("phrase"), "n", "heads", "tails", "cover")
        out = level if out is None else out.unionByName(level)
    return out, totals


def collocations(
    docs: DataFrame,
    least: int = 10,
    longest: int = 3,
    share: int = 50,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    limit: int = BROADCAST_ITEMS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language by score.

    Texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these at blanks and tabs into words, A-Z
    in lower case.  A phrase of 2 to `longest` words needs `least` occurrences inside pieces, overlaps
    counted.  Its score is the smallest floor(10^6 a^2 / (l r)) over its cuts into a first part
    (l occurrences) and a rest (r), the shortest first part among equal ones.  A phrase goes if
    a longer one around it has at least `share` per cent of its occurrences.  Null and empty texts
    have no words; a null language counts as `und`; repeated rows count as often as they occur.  An
    empty table, or one without frequent phrases, gives no rows.  Columns not named are not read.
    """
    phrases, totals = mine(docs, least, longest, text_col, lang_col, limit)
    # counts of up to 14 digits: the product of two and a million keeps inside 38
    wide = lambda c: c.cast("decimal(14,0)")
    own = wide(F.col("n")) * wide(F.col("n")) * F.lit(1_000_000).cast("decimal(7,0)")
    cuts = F.transform(
        F.arrays_zip("heads", "tails"),
        lambda c, i: F.struct(
            F.call_function("div", F.col("own"), wide(c["heads"]) * wide(c["tails"])).alias("score"),
            i.alias("i"),
            c["heads"].alias("l"),
            c["tails"].alias("r"),
        ),
    )
    kept = phrases.where(F.col("cover").isNull() | (100 * F.col("cover") < share * F.col("n")))
    scored = kept.withColumn("own", own).withColumn("cut", F.array_min(cuts))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    )


SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, row_number() over () as i,
    string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]', chr(32) || chr(10) || chr(32), 'g'), '[ \t]+') as tokens
  from documents),
w as (
  select lang, i, p, word from (select lang, i, unnest(tokens) as word, generate_subscripts(tokens, 1) as p from t)
  where word <> '' and word <> chr(10)),
c1 as (select lang, word, count(*) as f from w group by all),
total as (select lang, sum(f)::bigint as n from c1 group by all),
c2 as (
  select a.lang, a.word as w1, b.word as w2, count(*) as f
  from w a join w b on a.i = b.i and b.p = a.p + 1 group by all having count(*) >= 10),
c3 as (
  select a.lang, a.word as w1, b.word as w2, c.word as w3, count(*) as f
  from w a join w b on a.i = b.i and b.p = a.p + 1 join w c on a.i = c.i and c.p = a.p + 2 group by all having count(*) >= 10),
around as (
  select lang, x, y, max(f) as cover
  from (select lang, w1 as x, w2 as y, f from c3 union all select lang, w2, w3, f from c3) group by all),
cuts as (
  select c.lang, c.w1 || ' ' || c.w2 as phrase, c.f as a, l.f as l, r.f as r, 1 as k
  from c2 c join c1 l on l.lang = c.lang and l.word = c.w1 join c1 r on r.lang = c.lang and r.word = c.w2
  left join around o on o.lang = c.lang and o.x = c.w1 and o.y = c.w2
  where o.cover is null or 100 * o.cover < 50 * c.f
  union all
  select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, l.f, r.f, 1
  from c3 c join c1 l on l.lang = c.lang and l.word = c.w1 join c2 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
  union all
  select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, l.f, r.f, 2
  from c3 c join c2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join c1 r on r.lang = c.lang and r.word = c.w3),
scored as (
  select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
  qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""


@query("op11_collocations", SQL)
def op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
