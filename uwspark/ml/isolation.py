"""Isolation forest: trees grown per group from small samples, scored with a pandas UDF."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

SAMPLE = 256


def _depth_left(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def fit(df: DataFrame, features: list[str], key: str, trees: int = 50, seed: int = 42, sample: int = SAMPLE) -> list[list]:
    """Grow `trees` trees, each on its own sample of about `sample` rows of the whole table.

    Every row is asked for every tree by a hash of (key, tree), so all rows are equally
    likely in all samples; what is sent on has about trees x sample rows.
    """
    base = df.select(F.col(key).cast("string").alias("k"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    rows = base.count()
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("k", F.lit(seed), t), F.lit(max(rows, 1))) < sample
    )
    dealt = base.withColumn("tree", F.explode(drawn))
    limit = math.ceil(math.log2(sample))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        x = pdf.sort_values("k")[features].to_numpy(float)
        nodes: list[list[float]] = []

        def split(idx: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([])
            spread = x[idx].max(axis=0) - x[idx].min(axis=0) if len(idx) else np.zeros(len(features))
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(idx) <= 1 or len(usable) == 0:
                nodes[me] = [-1, depth + _depth_left(len(idx)), 0, 0]
                return me
            f = int(rng.choice(usable))
            cut = float(rng.uniform(x[idx, f].min(), x[idx, f].max()))
            left = split(idx[x[idx, f] < cut], depth + 1)
            right = split(idx[x[idx, f] >= cut], depth + 1)
            nodes[me] = [f, cut, left, right]
            return me

        split(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [json.dumps(nodes)]})

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes string")
    # A fixed number of small trees is the model.
    return [[r["size"], json.loads(r["nodes"])] for r in grown.orderBy("tree").collect()]


def score(df: DataFrame, model: list[list], features: list[str], out: str = "anomaly") -> DataFrame:
    """Anomaly score in 0..1 per row; trees travel with the task closure."""
    norm = _depth_left(int(np.mean([s for s, _ in model]))) or 1.0
    forest = [np.asarray(nodes, dtype=float) for _, nodes in model]

    @F.pandas_udf(T.DoubleType())
    def path(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(0.0).to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for nodes in forest:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = nodes[at, 0].astype(int)
                live = f >= 0
                if not live.any():
                    break
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] < nodes[at, 1]
                nxt = np.where(go_left, nodes[at, 2], nodes[at, 3]).astype(int)
                at = np.where(live, nxt, at)
            total += nodes[at, 1]
        return pd.Series(2.0 ** (-(total / len(forest)) / norm))

    return df.withColumn(out, path(*[F.col(f).cast("double") for f in features]))


def flag(scored: DataFrame, contamination: float = 0.08, column: str = "anomaly") -> DataFrame:
    """Mark the share `contamination` of rows with the highest scores."""
    from ..operators import scale

    t = scored.withColumn("_all", F.lit(1))
    cut = scale.exact_percentiles(scale.value_counts(t, ["_all"], column), ["_all"], {"_cut": 1 - contamination})
    return t.join(F.broadcast(cut), "_all").withColumn("is_anomaly", F.col(column) >= F.col("_cut")).drop("_all", "_cut")
