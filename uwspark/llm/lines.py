"""Line deduplication by a log-template tree of fixed depth.

A line is a list of tokens in which every token with a digit is a variable.  A line of
which CONSTANT per cent of the tokens or more are constants equals another if both are
equal with their variables masked; any other line, such as a row of numbers, is compared
as it is and shares no template with lines that differ.  The tree sends a line by its
token count and its first DEPTH tokens to a leaf.  In a leaf, a place beyond these
becomes a variable as soon as two different lines agree in all other tokens; a template
made so becomes a line of its own for a second free word.  What it takes is the support
of these lines alone, so a template found in a small corpus is found in any larger one.
A template keeps CONSTANT per cent of constants and at least one beyond the first DEPTH
tokens; a word among the first DEPTH tokens is never generalised.  A template that
recurs stays in the document with the smallest id and is dropped from all others.

Two lines that differ in one place agree in the whole first or in the whole second half
of their tokens.  One narrow row per line is written with the hashes of both halves;
only lines that share a half with a different line are looked at place by place, once
per different line.  Line numbers come back, so a text is masked once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from uwspark.staging import stage

from .common import attach_spread, query, table, whole

DEPTH = 3
SHORT = 3  # lines of fewer tokens always stay; lines of up to DEPTH tokens share a template only if equal
CONSTANT = 60
LAST = np.iinfo(np.int64).max
DIGIT = re.compile(rb"[0-9]")
VARIABLE = b"<*>"

digest = xxhash.xxh64_intdigest


def compared(line: bytes) -> tuple[list[bytes], bool]:
    """Tokens by which a line equals another, and whether it may share a template with lines that differ."""
    tokens = line.split()
    if DIGIT.search(line):
        masked = [VARIABLE if DIGIT.search(t) else t for t in tokens]
    elif VARIABLE in line:
        masked = tokens
    else:
        return tokens, True
    general = 100 * (len(masked) - masked.count(VARIABLE)) >= CONSTANT * len(masked)
    return (masked if general else tokens), general


def _ranked(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """Rows with rank and `_own`, the hash of the text: rows equal in both are alike, so null ids are apart."""
    rank = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))
    more = (F.col(c).alias(f"_c{i}") for i, c in enumerate(carry))
    text = whole(text_col)
    return docs.select(F.col(id_col).alias("_id"), rank.alias("_rank"), F.xxhash64(text).alias("_own"), text.cast("binary").alias("_bytes"), *more)


def _batch(columns: dict[str, list[int]], unsigned: set[str]) -> pa.RecordBatch:
    arrays = [pa.array(np.array(v, np.uint64).view(np.int64) if c in unsigned else np.array(v, np.int64)) for c, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, [*columns])


LINES = "_rank bigint, _own bigint, _no bigint, _line bigint, _first_half bigint, _second_half bigint, _general bigint"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line of SHORT tokens or more; the halves count only where `_general` is 1."""
    hashes = {"_line", "_first_half", "_second_half"}
    for b in batches:
        out = {c.split()[0]: [] for c in LINES.split(", ")}
        ranks, owns, nos, lines, firsts, seconds, generals = out.values()
        for rank, own, raw in zip(b.column("_rank").to_pylist(), b.column("_own").to_pylist(), b.column("_bytes").to_pylist()):
            for no, line in enumerate(raw.split(b"\n")):
                tokens, general = compared(line)
                n = len(tokens)
                if n < SHORT:
                    continue
                ranks.append(rank)
                owns.append(own)
                nos.append(no)
                lines.append(digest(b" ".join(tokens)))
                general = general and n > DEPTH
                generals.append(general)
                if general:
                    half = max(DEPTH, n // 2)
                    firsts.append(digest(b" ".join(tokens[:half]), n))
                    seconds.append(digest(b" ".join([*tokens[:DEPTH], VARIABLE, *tokens[half:]]), n))
                else:
                    firsts.append(0)
                    seconds.append(0)
        yield _batch(out, hashes)


PLACES = "_line bigint, _place bigint, _whole bigint, _flip bigint, _again bigint"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every place of the wanted lines that may become a variable.

    `_whole` ^ `_flip` is the template with the place open; `_again` says whether a second one may be opened.
    """
    for b in batches:
        out = {c.split()[0]: [] for c in PLACES.split(", ")}
        lines, places, wholes, flips, agains = out.values()
        for raw, want in zip(b.column("_bytes").to_pylist(), b.column("_want").to_pylist()):
            texts = raw.split(b"\n")
            for w in want:
                tokens, _ = compared(texts[w["_no"]])
                n = len(tokens)
                leaf = digest(b" ".join(tokens[:DEPTH]), n)
                own = [(i, digest(t, leaf + i & (1 << 64) - 1)) for i, t in enumerate(tokens[DEPTH:]) if t != VARIABLE]
                fixed = n - tokens.count(VARIABLE)
                if 100 * (fixed - 1) < CONSTANT * n or len(own) < 2:
                    continue
                total = leaf
                for _, h in own:
                    total ^= h
                again = 100 * (fixed - 2) >= CONSTANT * n and len(own) > 2
                for i, h in own:
                    lines.append(w["_line"])
                    places.append(i)
                    wholes.append(total)
                    flips.append(h ^ digest(b"%d" % i, leaf))
                    agains.append(again)
            if len(lines) >= 1 << 18:
                yield _batch(out, {"_whole", "_flip"})
                for c in out.values():
                    c.clear()
        yield _batch(out, {"_whole", "_flip"})


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, dropped, kept = [], [], []
        for raw, drop in zip(b.column("_bytes").to_pylist(), b.column("_drop").to_pylist()):
            count = raw.count(b"\n") + 1 if raw else 0
            if drop:
                gone = set(drop)
                raw = b"\n".join([x for i, x in enumerate(raw.split(b"\n")) if i not in gone])
            total.append(count)
            dropped.append(len(drop or ()))
            kept.append(raw.decode())
        same = {c: b.column(c) for c in b.schema.names if c not in ("_bytes", "_drop")}
        new = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*same.values(), *new], [*same, "n_lines", "n_dropped", "kept_text"])


def templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(_line, _least, _rows): of every line that recurs or shares a template, the smallest rank of either and its rows."""
    each = stage(
        lines.groupBy("_line", "_first_half", "_second_half", "_general")
        .agg(F.min(F.struct("_rank", "_own", "_no")).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )
    halves = stage(each.where("_general = 1").select("_line", "_first", F.explode(F.array("_first_half", "_second_half")).alias("_half")))
    shared = stage(halves.groupBy("_half").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    wanted = attach_spread(halves, shared, "_half", "_n").groupBy("_line").agg(F.first("_first").alias("_first"))
    # a merge join, whatever the size of the request: the plan is the same at every size
    ask = wanted.groupBy("_first._rank", "_first._own").agg(F.collect_list(F.struct("_line", F.col("_first._no").alias("_no"))).alias("_want"))
    found = docs.hint("merge").join(ask, ["_rank", "_own"]).select("_bytes", "_want")
    # equal rows under one id answer alike, so templates count different lines, not rows
    open_ = stage(
        found.mapInArrow(_places, PLACES)
        .join(each.select("_line", F.col("_first._rank").alias("_least")), "_line")
        .withColumn("_key", F.col("_whole").bitwiseXOR(F.col("_flip"))).drop("_whole")
    )
    recurring = lambda rows, of, key: (
        rows.groupBy(key).agg(F.min(of).alias(of), F.max(of).alias("_other"), F.min("_least").alias("_least"), F.max("_place").alias("_place"), F.count(F.lit(1)).alias("_n"))
        .where(F.col(of) != F.col("_other")).drop("_other")
    )
    one = stage(recurring(open_, "_line", "_key"))
    # a second free word: one line stands for its template
    slots = open_.where("_again = 1").select("_line", F.col("_place").alias("_second"), "_flip").distinct()
    second = F.xxhash64(F.col("_key").bitwiseXOR(F.col("_flip")), "_second").alias("_pair")
    twice = stage(one.join(slots, "_line").where("_place != _second").select("_key", "_place", "_least", second))
    two = stage(recurring(twice, "_key", "_pair").select("_pair", "_least", "_n"))
    lower = attach_spread(twice.select("_key", "_pair"), two, "_pair", "_n").groupBy("_key").agg(F.min("_least").alias("_lower"))
    best = stage(one.join(lower, "_key", "left").select("_key", F.least("_least", "_lower").alias("_least"), "_n"))
    general = attach_spread(open_.select("_line", "_key"), best, "_key", "_n").groupBy("_line").agg(F.min("_least").alias("_least"))
    first = F.col("_first._rank")
    return (
        each.join(general, "_line", "left")
        .select("_line", F.least(first, "_least").alias("_least"), "_rows", first.alias("_own_first"))
        .where("_rows > 1 or _least < _own_first").drop("_own_first")
    )


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_text, and the columns to `carry` along.

    Lines end at line feeds; those of fewer than SHORT tokens always stay, and so does
    what a document repeats by itself.  Null and empty texts have no lines.  Ids are
    integers; null ids come after all others and drop nothing from each other, nor do
    rows repeated with one id.  An empty table gives an empty result.  Other columns are
    not read.
    """
    base = _ranked(docs, id_col, text_col, carry)
    lines = stage(base.select("_rank", "_own", "_bytes").mapInArrow(_lines, LINES))
    recurring = stage(templates(base.select("_rank", "_own", "_bytes"), lines))
    drop = (
        attach_spread(lines.select("_rank", "_own", "_no", "_line"), recurring, "_line", "_rows").where("_rank > _least")
        .groupBy("_rank", "_own").agg(F.collect_set("_no").alias("_drop"))
    )
    own = ["_id", *(f"_c{i}" for i in range(len(carry)))]
    kinds = dict(base.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", n_lines bigint, n_dropped bigint, kept_text string"
    out = base.join(drop, ["_rank", "_own"], "left").select(*own, "_bytes", "_drop").mapInArrow(_rewritten, schema)
    return out.select(
        F.col("_id").alias(id_col), "n_lines", "n_dropped", "kept_text", *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry))
    )


SQL = r"""
with raw as (
  select doc_id, unnest(case when text is null or text = '' then [] else string_split(text, chr(10)) end) as line,
         unnest(range(case when text is null or text = '' then 0 else len(string_split(text, chr(10))) end)) as no
  from documents),
tok as (
  select doc_id, no, line, list_filter(regexp_split_to_array(line, '[ \t\x0b\x0c\r]+'), lambda t: t <> '') as w from raw),
mask as (select *, list_transform(w, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as t from tok),
l as (
  select doc_id, no, line, len(t) as n, len(list_filter(t, lambda x: x <> '<*>')) as c, t,
         100 * len(list_filter(t, lambda x: x <> '<*>')) >= 60 * len(t) as general,
         array_to_string(case when 100 * len(list_filter(t, lambda x: x <> '<*>')) >= 60 * len(t) then t else w end, ' ') as m
  from mask),
each as (select m, any_value(t) as t, n, c, general, min(doc_id) as first_id from l where n >= 3 group by m, n, c, general),
spread as (
  select m, n, c, first_id, unnest(range(1, n + 1)) as place, unnest(t) as token from each where general and n > 3),
slot as (
  select *, hash(place || '=' || token)::hugeint as h, sum(hash(place || '=' || token)::hugeint) over (partition by m) as total,
         sum((place > 3 and token <> '<*>')::int) over (partition by m) as beyond
  from spread),
opened as (
  select m, n, c, beyond, first_id, place, h, total - h as rest from slot
  where place > 3 and token <> '<*>' and 100 * (c - 1) >= 60 * n and beyond > 1),
one as (select n, place, rest, min(m) as m, min(first_id) as least_id from opened group by n, place, rest having count(*) > 1),
twice as (
  select one.n, one.place, one.rest, one.least_id, o.place as other, one.rest - o.h as left_over
  from one join opened o on o.m = one.m and o.place <> one.place and 100 * (o.c - 2) >= 60 * o.n and o.beyond > 2),
two as (select n, place, other, left_over, min(least_id) as least_id from twice group by n, place, other, left_over having count(*) > 1),
lower_ as (
  select twice.n, twice.place, twice.rest, min(two.least_id) as least_id from twice join two using (n, place, other, left_over)
  group by twice.n, twice.place, twice.rest),
best as (
  select n, place, rest, least(one.least_id, coalesce(lower_.least_id, one.least_id)) as least_id from one left join lower_ using (n, place, rest)),
shared as (select m, min(best.least_id) as least_id from opened join best using (n, place, rest) group by m),
rule as (select each.m, least(first_id, coalesce(least_id, first_id)) as least_id from each left join shared using (m)),
marked as (select l.doc_id, no, line, coalesce(l.doc_id > rule.least_id, false) as gone from l left join rule on l.n >= 3 and rule.m = l.m),
kept as (
  select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
         coalesce(string_agg(line, chr(10) order by no) filter (where not gone), '') as t
  from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept using (doc_id)
"""


@query("op2_line_templates", SQL)
def op2(spark, sf_dir):
    out = deduplicated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
