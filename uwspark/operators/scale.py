"""Building blocks that keep one hot key from landing in one task.

An account may hold a third of all rows, so nothing here sorts or collects a
whole account in one place.  Ordered work is done per (account, block) where a
block is a fixed-length run of the statement order; only one summary row per
block is carried across blocks.  Exact percentiles come from a histogram of the
value counts instead of a per-group buffer.

Joins that bring a summary back to rows ask for a merge join: the rows are
already partitioned and sorted on the join keys by the window before it, so only
the summary moves, whatever its estimated size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..staging import stage

BLOCK_ROWS = 1 << 18
HOT_ROWS = 1 << 22
ALL = "_all"


def with_block(df: DataFrame, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """Add `blk`, the number of the fixed-length run a row belongs to."""
    return df.withColumn("blk", F.floor(F.col(seq) / F.lit(rows or BLOCK_ROWS)).cast("bigint"))


def spread_hot(
    df: DataFrame, keys: Sequence[str], coarse: dict[str, Column], hot_rows: int | None = None
) -> DataFrame:
    """Add the coarse order columns, -1 for every key that is small enough to sort whole.

    The list of hot keys has at most (all rows / hot_rows) entries, so it is broadcast.
    """
    limit = hot_rows or HOT_ROWS
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    out = df.join(F.broadcast(hot), list(keys), "left")
    for name, expr in coarse.items():
        out = out.withColumn(name, F.when(F.col("_hot"), expr).otherwise(-1).cast("bigint"))
    return out.drop("_hot")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[str],
    order: Sequence[str | Column],
    out: str = "seq",
) -> DataFrame:
    """0-based position of each row inside `keys`, ordered by `coarse` then `order`.

    Rows are sorted only inside (keys, coarse); the start of each such run is a
    running total over the run counts, one coarse level at a time, so every
    window is bounded by the number of distinct values of one level.
    """
    keys, coarse = list(keys), list(coarse)
    runs = df.groupBy(*keys, *coarse).agg(F.count(F.lit(1)).alias("_n"))
    starts = None
    for depth in range(1, len(coarse) + 1):
        outer, level = keys + coarse[: depth - 1], coarse[depth - 1]
        prior = W.partitionBy(*outer).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        totals = runs.groupBy(*outer, level).agg(F.sum("_n").alias("_n"))
        step = totals.select(
            *outer, level, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias(f"_s{depth}")
        )
        starts = step if starts is None else step.join(starts, outer)
    total = sum((F.col(f"_s{d}") for d in range(1, len(coarse) + 1)), F.lit(0))
    starts = starts.select(*keys, *coarse, total.cast("bigint").alias("_start"))
    inner = W.partitionBy(*keys, *coarse).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inner))
        .join(starts.hint("merge"), keys + coarse)
        .withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("bigint"))
        .drop("_rn", "_start")
    )


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-key table to rows through (keys, blk), so a hot key stays spread."""
    keys = list(keys)
    blocks = rows.select(*keys, "blk").distinct()
    return rows.join(blocks.join(table, keys).hint("merge"), [*keys, "blk"], how)


# --------------------------------------------------------------------------- percentiles


def _bucket(value: str) -> Column:
    """A coarse bucket that never decreases as the value grows."""
    v = F.col(value)
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 256)).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, n): the multiset of a column, pre-aggregated before its shuffle."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(*keys, F.col(value).cast("double").alias("v"))
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lookup_ranks(
    counts: DataFrame,
    keys: Sequence[str],
    ranks: dict[str, Callable[[Column], Column]],
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Values at 0-based ranks: (keys, tag, rank, v, upto, size), `upto` = values <= v.

    Each rank is a function of the group size, or of `size` in the table `sizes`
    (keys, size).  The histogram has a bounded number of buckets per key; only the
    buckets that hold a wanted rank are sorted, by distinct value.
    """
    keys = list(keys)
    counts = counts.withColumn("b", _bucket("v"))
    upto = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    hist = counts.groupBy(*keys, "b").agg(F.sum("n").alias("bn")).withColumn("hi", F.sum("bn").over(upto))
    if sizes is None:
        hist = hist.withColumn("size", F.sum("bn").over(W.partitionBy(*keys)))
    else:
        hist = hist.join(sizes.select(*keys, "size"), keys)
    spots = F.array(
        *[
            F.struct(F.lit(t).alias("tag"), f(F.col("size")).cast("bigint").alias("rank"))
            for t, f in ranks.items()
        ]
    )
    hit = (
        hist.withColumn("lo", F.col("hi") - F.col("bn"))
        .select(*keys, "b", "lo", "hi", "size", F.inline(spots))
        .where("rank >= lo and rank < hi")
        .drop("hi")
    )
    w = W.partitionBy(*keys, "b", "tag").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.join(hit, [*keys, "b"])
        .withColumn("upto", F.col("lo") + F.sum("n").over(w))
        .where("rank < upto and rank >= upto - n")
        .select(*keys, "tag", "rank", "v", "upto", "size")
    )


def exact_percentiles(
    counts: DataFrame, keys: Sequence[str], probs: dict[str, float], sizes: DataFrame | None = None
) -> DataFrame:
    """Linear-interpolated percentiles, one column per entry of `probs` (0..1)."""
    keys = list(keys)

    def at(p: float, edge) -> Callable[[Column], Column]:
        return lambda size: edge(F.lit(float(p)) * (size - 1))

    ranks = {}
    for name, p in probs.items():
        ranks[f"{name}/lo"] = at(p, F.floor)
        ranks[f"{name}/hi"] = at(p, F.ceil)
    got = lookup_ranks(counts, keys, ranks, sizes)
    cols = []
    for name, p in probs.items():
        low = F.max(F.when(F.col("tag") == f"{name}/lo", F.col("v")))
        high = F.max(F.when(F.col("tag") == f"{name}/hi", F.col("v")))
        pos = F.lit(float(p)) * (F.max("size") - 1)
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return got.groupBy(*keys).agg(*cols)


def median_abs_deviation(
    long: DataFrame, keys: Sequence[str], value: str, tails: dict[str, float] | None = None
) -> DataFrame:
    """(keys, n, sd, med, mad, tails...) of a long table whose key set is small and fixed."""
    keys = list(keys)
    counts = value_counts(long, keys, value)
    pct = exact_percentiles(counts, keys, {"med": 0.5, **(tails or {})})
    # The medians are one row per metric name, a set fixed in code.
    dev = (
        counts.join(F.broadcast(pct.select(*keys, "med")), keys)
        .select(*keys, F.abs(F.col("v") - F.col("med")).alias("v"), "n")
        .groupBy(*keys, "v")
        .agg(F.sum("n").alias("n"))
    )
    mad = exact_percentiles(dev, keys, {"mad": 0.5})
    spread = long.groupBy(*keys).agg(
        F.stddev_pop(value).alias("sd"), F.count(value).cast("bigint").alias("n")
    )
    return spread.join(pct, keys).join(mad, keys)


# --------------------------------------------------------------------------- partner search

#: Buckets in a band and days in a span of the neighbour search; only rows at an edge are kept unasked.
BAND, SPAN = 4096, 256


def _with_neighbour(base: DataFrame, keys: list[str], reach: int, days: int) -> DataFrame:
    """Rows of `base` with another row of the same keys at most `days` off and near in `own`; none within `reach` is lost.

    Two grids of cells of twice the reach, one shifted by half a cell, hold every two buckets within the
    reach in one cell; there the nearest day is that of the row before or after.  A task sorts one band
    of buckets and one span of days, and keeps what lies at an edge of them.
    """
    bands = {"_band": F.floor(F.col("own") / BAND), "_span": F.floor(F.col("day") / SPAN)}
    near = (F.pmod("own", F.lit(BAND)) < reach) | (F.pmod("own", F.lit(BAND)) >= BAND - reach)
    near = near | (F.pmod("day", F.lit(SPAN)) < days) | (F.pmod("day", F.lit(SPAN)) >= SPAN - days)
    rows = base.withColumns(bands).repartition(*keys, *bands)
    for shift in (0, reach):
        cell = F.floor((F.col("own") + shift) / (2 * reach))
        w = W.partitionBy(*keys, *bands, cell).orderBy("day")
        rows = rows.withColumns({f"_before{shift}": F.lag("day").over(w), f"_after{shift}": F.lead("day").over(w)})
        for other in (F.col("day") - F.col(f"_before{shift}"), F.col(f"_after{shift}") - F.col("day")):
            near = near | F.coalesce(other <= days, F.lit(False))
    return rows.where(near).select(*base.columns)


def later_partner(
    df: DataFrame,
    keys: Sequence[str],
    *,
    is_query: Column,
    is_provider: Column,
    accept: Callable[[Column, Column], Column],
    bucket: Column | None = None,
    reach: int = 0,
    days: int = 2,
) -> DataFrame:
    """Queries that have an acceptable provider later the same day or within `days`.

    Input columns: keys, `seq`, `blk`, `txn_date`, `amount`.  "Later" is the order
    by (date, seq).  `accept(candidate, own)` must be monotone away from the own
    bucket, so the largest candidate of the buckets below and the smallest of the
    buckets above decide; inside the own bucket any candidate is tested at its
    largest.  No pair of rows is ever formed: the next days are answered from
    per-day extremes, the same day from a running extreme over later rows.  With a
    `reach` a row is wanted under several buckets, so the rows that have none near
    them are set aside before any is copied.
    """
    keys = list(keys)
    group = [*keys, "day", "home"]
    base = df.select(
        *keys,
        "seq",
        "blk",
        F.unix_date("txn_date").alias("day"),
        F.col("amount").alias("amt"),
        is_query.alias("q"),
        is_provider.alias("p"),
        (F.lit(0) if bucket is None else bucket).cast("bigint").alias("own"),
    )
    if not reach:
        return _later_in_bucket(base, keys, accept, days)
    base = stage(_with_neighbour(base, keys, reach, days))
    offsets = F.array(*[F.lit(o).cast("bigint") for o in range(-reach, reach + 1)])
    providers = base.where("p")

    def sides(lo: str, hi: str) -> list[Column]:
        return [
            F.max(F.when(F.col("off") <= 0, F.col(hi))).alias("below"),
            F.min(F.when(F.col("off") > 0, F.col(lo))).alias("above"),
        ]

    next_days = (
        providers.groupBy(*keys, "day", "own")
        .agg(F.min("amt").alias("lo"), F.max("amt").alias("hi"))
        .withColumn("off", F.explode(offsets))
        .withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(days))))
        .withColumn("day", F.col("day") - F.col("ahead"))
        .withColumn("home", F.col("own") - F.col("off"))
        .groupBy(*group)
        .agg(*sides("lo", "hi"))
        .withColumnRenamed("below", "nd_below")
        .withColumnRenamed("above", "nd_above")
    )

    queries = base.where("q").select(
        *keys, "seq", "blk", "day", F.col("own").alias("home"), F.lit(None).cast("bigint").alias("off"), "amt"
    )
    spread = providers.withColumn("off", F.explode(offsets)).select(
        *keys, "seq", "blk", "day", (F.col("own") - F.col("off")).alias("home"), "off", "amt"
    )
    # A query sorts before its own provider copy, so a row never answers itself.
    later = (
        W.partitionBy(*group, "blk")
        .orderBy(F.col("seq").desc(), F.col("off").isNotNull())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    low = F.when(F.col("off") <= 0, F.col("amt"))
    high = F.when(F.col("off") > 0, F.col("amt"))
    events = queries.unionByName(spread)
    scanned = events.select(
        *group, "blk", "seq", "off", "amt", F.max(low).over(later).alias("s_below"), F.min(high).over(later).alias("s_above")
    ).where("off is null")
    after = W.partitionBy(*group).orderBy(F.col("blk").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        events.groupBy(*group, "blk")
        .agg(F.max(low).alias("b_below"), F.min(high).alias("b_above"))
        .withColumn("c_below", F.max("b_below").over(after))
        .withColumn("c_above", F.min("b_above").over(after))
        .join(next_days, group, "left")
        .select(
            *group,
            "blk",
            F.greatest("c_below", "nd_below").alias("f_below"),
            F.least("c_above", "nd_above").alias("f_above"),
        )
    )
    below = F.greatest("s_below", "f_below")
    above = F.least("s_above", "f_above")
    ok = F.coalesce(accept(below, F.col("amt")), F.lit(False)) | F.coalesce(
        accept(above, F.col("amt")), F.lit(False)
    )
    return scanned.join(blocks.hint("merge"), [*group, "blk"]).where(ok).select(*keys, "seq")


def _later_in_bucket(base: DataFrame, keys: list[str], accept: Callable[[Column, Column], Column], days: int) -> DataFrame:
    """The search without reach: a row is wanted under its own bucket only, so no row is copied.

    Later rows of a block are seen from the rows themselves; later blocks of the day and the next days
    from one row per (keys, bucket, day, block), a calendar-sized group of every key.
    """
    group = [*keys, "own", "day"]
    events = base.where("q or p")
    best = F.max(F.when(F.col("p"), F.col("amt")))
    later = W.partitionBy(*group, "blk").orderBy(F.col("seq").desc()).rangeBetween(W.unboundedPreceding, -1)
    scanned = events.withColumn("_same", best.over(later)).where("q")
    after = W.partitionBy(*group).orderBy(F.col("blk").desc()).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*keys, "own").orderBy("day").rangeBetween(1, days)
    blocks = (
        events.groupBy(*group, "blk")
        .agg(best.alias("_best"), F.max("q").alias("_asked"))
        .repartition(*keys, "own")
        .withColumn("_blocks", F.max("_best").over(after))
        .withColumn("_days", F.max("_best").over(ahead))
        .where("_asked")
        .select(*group, "blk", F.greatest("_blocks", "_days").alias("_later"))
    )
    found = scanned.join(blocks.hint("merge"), [*group, "blk"])
    return found.where(F.coalesce(accept(F.greatest("_same", "_later"), F.col("amt")), F.lit(False))).select(*keys, "seq")
