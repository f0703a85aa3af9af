"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}

#: The white space every contract here names: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str = "text") -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ordered_id(col: str) -> tuple[Column, Column]:
    """Sort keys that put a null id last."""
    return F.col(col).isNull(), F.col(col)


#: Keys with at least one row in WIDE are joined by broadcast; by construction there are at most WIDE of them.
WIDE = 256


def attach_spread(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of `rows` with the one value row of each key, without a task that gets all rows of a hot key.

    `weight` is the number of rows of the key.  Both frames are read more than once, so stage them.
    """
    limit = rows.count() / WIDE
    wide = values.where(F.col(weight) >= limit).drop(weight)
    rest = values.where(F.col(weight) < limit).drop(weight)
    return rows.join(F.broadcast(wide), key).unionByName(
        rows.join(F.broadcast(wide.select(key)), key, "left_anti").join(rest, key)
    )
