"""WARC archives: writing, and reading back by boundary-chain verification.

**Writing.**  Rows become `response` records; of rows with equal payloads only the smallest
id is stored, the others are `revisit` records that refer to it.  Files are written by the
text writer, whose line separator is the empty line that ends a record, so every task streams
its own file to the shared folder, on whatever store Spark writes to.

**Reading.**  A file is cut at every magic `WARC/1.` at the start of a line, wherever the splits
of the file fall; running sums of the piece lengths inside a split and of the splits inside
a file give every piece its byte offset.  A piece whose header parses is a candidate record
and names its successor: offset + header + content length + 4.  A magic inside a payload
makes candidates too, also complete ones.  A candidate is a record only if the chain from the
start of the file reaches it.  Tasks follow the chain inside blocks of the file; the exits of
the blocks, one or few per block, are linked by pointer jumping, which doubles its reach each
round, and the entries found are followed through their blocks.  A record that holds magics
is put together from its pieces again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from uwspark.staging import shared_dir, stage

from .common import query, table, whole

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: A cut must not begin with a part of itself: Hadoop's line reader loses such ones where they lie across a split.
CUT = "\n" + MAGIC
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Bytes of a file whose chain one task follows.
BLOCK_BYTES = 1 << 26
FROM_DIGITS, TO_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

Derive = dict[str, Callable[[Column], Column]]


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: ten hexadecimal digits make eight of these."""
    digits = F.upper(F.sha1(data))
    parts = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), FROM_DIGITS, TO_DIGITS)


# --------------------------------------------------------------------------- writing


def _uuid(row: Column, url: Column, same: Column) -> Column:
    key = F.md5(F.concat_ws("\x00", F.coalesce(row.cast("string"), F.lit("")), url, same))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(key, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(record): one record text per row, without the empty line that ends it.

    Payloads of at least `least` bytes are compared by SHA-256 and length.  The row with the
    smallest id is the response, null ids last; rows repeated under that id are responses too.
    A null payload is an empty one, a null or empty url is `about:blank`, line ends in a url
    become spaces.  Columns not named are not read.
    """
    body = F.encode(whole(payload_col), "UTF-8")
    url = F.coalesce(F.nullif(F.regexp_replace(url_col, "[\r\n]+", " "), F.lit("")), F.lit("about:blank"))
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), body.alias("_body"))
    rows = rows.withColumn("_bytes", F.octet_length("_body")).withColumn("_same", F.sha2("_body", 256))
    # only payloads that several rows have: the optimizer sends this table to all tasks if its files are small,
    # else the rows move, and a digest with very many rows is split
    first = stage(
        rows.where(F.col("_bytes") >= least)
        .groupBy("_same", "_bytes")
        .agg(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_url"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null")
        .drop("_n")
    )
    rows = rows.join(first, ["_same", "_bytes"], "left")
    rows = rows.withColumn("_copy", F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first._id")))
    http = F.concat(F.lit(HTTP), F.col("_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("_copy"), F.lit("")).otherwise(F.col("_body").cast("string")))
    referred = F.concat(
        _line("WARC-Profile", F.lit(PROFILE)),
        _line("WARC-Refers-To", _uuid(F.col("_first._id"), F.col("_first._url"), F.col("_same"))),
        _line("X-Refers-To-Row", F.col("_first._id").cast("string")),
    )
    record = F.concat(
        F.lit(f"{MAGIC}1"),
        _line("WARC-Type", F.when(F.col("_copy"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _uuid(F.col("_id"), F.col("_url"), F.col("_same"))),
        _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("_body")))),
        _line("X-Payload-Length", F.col("_bytes").cast("string")),
        F.coalesce(_line("X-Row", F.col("_id").cast("string")), F.lit("")),
        F.when(F.col("_copy"), referred).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )
    return rows.select(record.alias("record"))


def write(records: DataFrame, path: str) -> None:
    """Archives of all records, one file per task; an empty table leaves an empty folder."""
    records.write.option("lineSep", END).text(path)


# --------------------------------------------------------------------------- reading


def field(headers: Column, name: str) -> Column:
    """Value of a named header field, null where there is none; the first one counts."""
    found = F.regexp_extract(headers, f"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, value, size, opens): what stands between two cuts, in the order of the file.

    The first piece of a file `opens` with the magic, which is taken off; `size` counts it.
    """
    value = F.col("value")
    return (
        spark.read.option("lineSep", CUT)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            F.octet_length(value).cast("bigint").alias("size"),
            value.startswith(MAGIC).alias("opens"),
            F.when(value.startswith(MAGIC), F.substring(value, len(MAGIC) + 1, 1 << 30)).otherwise(value).alias("value"),
        )
    )


def _offsets(pieces: DataFrame) -> DataFrame:
    """Adds `offset`, the byte at which the magic of a piece stands; pieces that are not behind a magic are dropped."""
    step = F.col("size") + len(CUT)
    inside = W.partitionBy("file", "split").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.groupBy("file", "split").agg(F.sum(step).alias("_n")).select(
        "file", "split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    at = F.col("_start") + F.col("_inside")
    return (
        pieces.withColumn("_inside", F.coalesce(F.sum(step).over(inside), F.lit(0)))
        .join(starts, ["file", "split"])
        .withColumn("offset", F.when(at == 0, 0).otherwise(at - len(MAGIC)).cast("bigint"))
        .where((at == 0) == F.col("opens"))
        .drop("_start", "_inside", "split", "place", "opens")
    )


def _parsed(rows: DataFrame) -> DataFrame:
    """Adds `headers`, `head` (bytes of magic, header and empty line) and `length`; null for what is no record."""
    length = F.expr(r"try_cast(regexp_extract(headers, '(?i)\r\nContent-Length:[ \t]*([0-9]+)[ \t]*(\r|$)', 1) as bigint)")
    # a cut right behind the header takes the last byte of its empty line
    ended = F.octet_length("headers") + len(END) <= F.octet_length("value") + 1
    return (
        rows.withColumn("headers", F.substring_index(F.concat("value", F.lit("\n")), END, 1))
        .withColumn("length", F.when(F.col("headers").rlike("^[0-9]\r\n") & ended, length))
        .withColumn("head", (F.octet_length("headers") + len(MAGIC) + len(END)).cast("bigint"))
    )


def _block_of(value: Column, head: Column, length: Column) -> Column:
    """Bytes of the content block of a piece that holds it whole."""
    return F.substring(value.cast("binary"), (head - len(MAGIC) + 1).cast("int"), length.cast("int"))


def payload_of(block: Column, headers: Column) -> Column:
    """The payload of a content block: what follows the HTTP header, where there is one."""
    http = F.coalesce(field(headers, "Content-Type"), F.lit("")).startswith("application/http")
    head = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    return F.when(http, F.substring(block, (head + 1).cast("int"), F.octet_length(block))).otherwise(block)


EXITS = "file string, block bigint, offset bigint, exit bigint"
OWNED = "file string, block bigint, offset bigint, owner bigint"


def _exits(block: pa.Table) -> pa.Table:
    """For each candidate of one block of a file the first offset outside the block that its chain reaches."""
    offsets, nexts = block["offset"].to_pylist(), block["next"].to_pylist()
    out: dict[int, int] = {}
    for offset, following in sorted(zip(offsets, nexts), reverse=True):
        out[offset] = out.get(following, following)
    return pa.table({"file": block["file"], "block": block["block"], "offset": block["offset"], "exit": pa.array([out[o] for o in offsets], pa.int64())})


def _walk(block: pa.Table) -> pa.Table:
    """For each piece of one block the record it belongs to: the last offset at or before it on the chain from the entry."""
    entry = block["entry"][0].as_py()
    rows = sorted(zip(block["offset"].to_pylist(), block["next"].to_pylist()))
    out, owner, due = [], None, entry
    for offset, following in rows:
        if offset == due and following is not None:
            owner, due = offset, following
        out.append((offset, owner))
    first = block["file"][0].as_py(), block["block"][0].as_py()
    return pa.table(
        {
            "file": pa.array([first[0]] * len(out), pa.string()),
            "block": pa.array([first[1]] * len(out), pa.int64()),
            "offset": pa.array([o for o, _ in out], pa.int64()),
            "owner": pa.array([o for _, o in out], pa.int64()),
        }
    )


def _entries(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates at which the chain from the start of a file enters its blocks.

    Pointer jumping over the exits: `reached` covers the first 2^k blocks of the chain after round k.
    """
    targets = links.select("file", F.col("exit").alias("offset")).unionByName(links.where("offset = 0").select("file", "offset")).distinct()
    jump = stage(links.select("file", "offset", "exit").join(targets, ["file", "offset"]))
    reached = stage(jump.where("offset = 0").select("file", "offset"))
    known = reached.count()
    while True:
        more = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        # an exit that is no candidate ends the chain
        more = more.join(jump.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = stage(reached.unionByName(more).distinct())
        now = reached.count()
        if now == known:
            return reached
        known = now
        far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("_exit"))
        jump = stage(jump.join(far, ["file", "exit"], "left").select("file", "offset", F.coalesce("_exit", "exit").alias("exit")))


def _owners(pieces: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, offset, owner): the record of the chain that each piece is the start or a part of, null before the first."""
    entered = pieces.join(entries, ["file", "block"], "left")
    walked = stage(entered.select("file", "block", "offset", "next", "entry").groupBy("file", "block").applyInArrow(_walk, OWNED))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = walked.groupBy("file", "block").agg(F.max("owner").alias("_last")).select("file", "block", F.max("_last").over(before).alias("_carried"))
    return walked.join(last, ["file", "block"]).select("file", "offset", F.coalesce("owner", "_carried").alias("owner"))


def read(spark: SparkSession, path: str, derive: Derive | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, offset, headers, ...): the records of all archives under `path`, with what `derive` makes of the payload.

    Without `derive` the column is `payload`, the bytes.  `headers` is the text of the header.
    Compressed archives are read as one split each.  A file that does not start with a record
    has none; what follows a record of a wrong length, and a last record cut short, is not
    returned.  An empty folder has no records.
    """
    derive = derive or {"payload": lambda payload: payload}

    def made(rows: DataFrame) -> DataFrame:
        payload = payload_of(F.col("_block"), F.col("headers"))
        return rows.select("*", *[f(payload).alias(name) for name, f in derive.items()]).drop("_block", "value")

    rows = _parsed(_pieces(spark, path))
    fits = F.coalesce(F.octet_length("value") + len(MAGIC) >= F.col("head") + F.col("length"), F.lit(False))
    rows = rows.withColumn("fits", fits).withColumn("_block", F.when(F.col("fits"), _block_of(F.col("value"), F.col("head"), F.col("length"))))
    pieces = stage(
        _offsets(made(rows).withColumn("headers", F.when(F.col("length").isNotNull(), F.col("headers"))))
        .withColumn("next", F.col("offset") + F.col("head") + F.col("length") + len(END))
        .withColumn("block", F.floor(F.col("offset") / block_bytes).cast("bigint"))
    )
    candidates = pieces.where("length is not null").select("file", "block", "offset", "next")
    links = stage(candidates.groupBy("file", "block").applyInArrow(_exits, EXITS))
    entries = _entries(links).select("file", F.floor(F.col("offset") / block_bytes).cast("bigint").alias("block"), F.col("offset").alias("entry"))
    owners = stage(_owners(pieces, entries))
    found = pieces.join(owners.where("owner = offset").select("file", "offset"), ["file", "offset"])
    out = ["file", "offset", "headers", *derive]
    complete = found.where("fits").select(*out)
    broken = stage(found.where("not fits").select("file", F.col("offset").alias("owner"), "next", "headers", "head", "length"))
    if broken.isEmpty():
        return complete
    # records with cuts inside: their files are read again, and the pieces of each are put together
    again = stage(_pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi"))
    parts = owners.join(broken.select("file", "owner", "next"), ["file", "owner"]).where("offset < next").drop("next")
    texts = (
        _offsets(again)
        .join(parts, ["file", "offset"])
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("_parts"))
        .select("file", "owner", F.array_join(F.transform("_parts", lambda p: p["value"]), CUT).alias("value"))
    )
    joined = texts.join(broken, ["file", "owner"]).where(F.octet_length("value") + len(MAGIC) >= F.col("head") + F.col("length"))
    joined = made(joined.withColumn("_block", _block_of(F.col("value"), F.col("head"), F.col("length"))))
    return complete.unionByName(joined.withColumnRenamed("owner", "offset").select(*out))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/uwspark-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"


SQL = r"""
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages),
d as (
  select page_id, octet_length(body) as payload_bytes, unhex(sha1(body)) as digest, sha256(body) as same from p),
f as (
  select *, min(page_id) over (partition by same) as first_id,
    (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(digest::bit::varchar, i * 5 + 1, 5)::bit::int + 1, 1), '' order by i)
     from range(32) t(i)) as payload_digest
  from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id is not distinct from first_id or first_id is null then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from first_id or first_id is null then null else first_id end as refers_to
from f
"""


@query("op12_warc_archives", SQL)
def op12(spark, sf_dir):
    path = archive_folder(spark)
    write(records_of(table(spark, sf_dir, "pages")), path)
    records = read(spark, path, {"bytes": F.octet_length, "digest": base32_sha1})
    header = lambda name: field(F.col("headers"), name)
    copy = header("WARC-Type") == "revisit"
    return records.select(
        header("X-Row").cast("bigint").alias("page_id"),
        F.when(copy, header("X-Payload-Length").cast("bigint")).otherwise(F.col("bytes").cast("bigint")).alias("payload_bytes"),
        F.when(copy, F.substring_index(header("WARC-Payload-Digest"), ":", -1)).otherwise(F.col("digest")).alias("payload_digest"),
        header("WARC-Type").alias("record_type"),
        header("X-Refers-To-Row").cast("bigint").alias("refers_to"),
    )
