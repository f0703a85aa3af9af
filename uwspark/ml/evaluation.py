"""Stratified folds, probability metrics and permutation importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import half_even
from ..operators import scale
from ..staging import stage
from . import heads
from .heads import Head

#: Leading hexadecimal digits of the hash that cut a class into slices: 4096 of them.
SLICE_DIGITS = 3


def hashed(key: str, seed: int) -> Column:
    """A seeded order of the rows that does not depend on where they lie."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def shuffled_position(df: DataFrame, key: str, seed: int, by: list[str] | None = None, out: str = "position") -> DataFrame:
    """0-based place of every row, inside the columns `by`, in a seeded order of the keys.

    Rows are sorted only inside slices of the hash, so no task holds a whole class.
    """
    sliced = df.withColumn("_h", hashed(key, seed)).withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS))
    return scale.number_rows(sliced, by or [], ["_slice"], ["_h", key], out).drop("_h", "_slice")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: the rows of every class are dealt round to the folds in a seeded order.

    The folds of a class differ by at most one row.  Rows without a label are a class of their own.
    """
    filled = df.withColumn("_class", F.coalesce(F.col(label).cast("string"), F.lit("")))
    placed = shuffled_position(filled, key, seed, ["_class"], "_place")
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place", "_class")


def probabilities(model: PipelineModel, df: DataFrame, head: Head) -> DataFrame:
    """Adds `prediction` and, for classifiers that have one, `p`: the probability of every class as an array."""
    out = model.transform(df.na.fill(0.0, list(head.features)))
    if head.kind == "classifier" and "probability" in out.columns:
        return out.withColumn("p", vector_to_array("probability"))
    return out.withColumn("p", F.lit(None).cast("array<double>"))


def cross_validated(df: DataFrame, head: Head, key: str, k: int = 3, algorithm: str = "gradient_boosting") -> DataFrame:
    """(key, fold, y, prediction, p): every row is predicted by the model that has not seen its fold."""
    data = heads.labelled(df, head)
    data = stage(stratified_folds(data, key, "y", k) if head.kind == "classifier" else stratified_folds(data.withColumn("_all", F.lit("")), key, "_all", k))

    def part(i: int) -> DataFrame:
        model = heads.fit(data.where(F.col("fold") != i).drop("y"), head, algorithm)
        return probabilities(model, data.where(F.col("fold") == i), head).select(key, "fold", "y", "prediction", "p")

    return reduce(DataFrame.unionByName, [part(i) for i in range(k)])


def brier(pred: DataFrame) -> DataFrame:
    """(fold, brier) of two-class predictions with `y` 0 or 1 and `p` the probability of 1; 0 for a fold with one class only."""
    error = F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))
    both = F.min("y") != F.max("y")
    return pred.groupBy("fold").agg(F.when(both, error).otherwise(0.0).alias("brier"))


def evaluated(df: DataFrame, head: Head, key: str, k: int = 3, algorithm: str = "gradient_boosting", tolerance: float | None = None) -> DataFrame:
    """(head, fold, metrics..., status) of a head, refitted per fold; metrics that its kind lacks are null."""
    pred = stage(cross_validated(df, head, key, k, algorithm))
    absent = F.lit(None).cast("double")
    flat = pred.select("fold", "y", F.col("prediction").alias("p"))
    if head.kind == "regressor":
        # one number: the level that splits the target in two
        mid = scale.exact_percentiles(scale.value_counts(pred.select(F.lit(1).alias("g"), "y"), ["g"], "y"), ["g"], {"m": 0.5}).first()
        m = heads.regression_metrics(flat, mid.m if mid else 0.0).withColumn("accuracy", absent).withColumn("brier", absent)
        m = heads.fold_status(m, "r2", 0.08 if tolerance is None else tolerance)
    else:
        m = heads.classification_metrics(flat).join(flat.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold")
        if len(head.classes) == 2:
            m = m.join(brier(pred.select("fold", "y", F.try_element_at("p", F.lit(2)).alias("p"))), "fold")
        else:
            m = m.withColumn("brier", absent)
        m = m.withColumn("r2", absent).withColumn("mse", absent).withColumn("mae", 1 - F.col("accuracy"))
        m = heads.fold_status(m, "accuracy", 0.05 if tolerance is None else tolerance)
    names = ["accuracy", "precision", "recall", "f1", "brier", "r2", "mse", "mae"]
    return m.select(F.lit(head.id).alias("head"), "fold", "n", *[half_even(c, 6).alias(c) for c in names], "status")


# --------------------------------------------------------------------------- permutation importance


def permuted(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """Every row with `_other`: the named columns of the row that a seeded permutation puts in its place."""
    there = shuffled_position(df, key, 2 * seed + 1).select("position", F.struct(*columns).alias("_other"))
    return shuffled_position(df, key, 2 * seed).join(there, "position").drop("position")


def permutation_importance(model: PipelineModel, df: DataFrame, head: Head, key: str, repeats: int = 5) -> DataFrame:
    """(feature, importance, share): the fall of accuracy, or of R2, when one feature is shuffled.

    A repeat shuffles all features in one join; a row is then scored once per feature with only
    that feature replaced, and one aggregation gives the scores of all features.  Falls under zero
    count as zero, `share` is the part of the sum, 0 if nothing matters.
    """
    names = list(head.features)
    data = stage(heads.labelled(df, head).na.fill(0.0, names).select(key, "y", *[F.col(f).cast("double").alias(f) for f in names]))
    err = F.col("y") - F.col("prediction")
    if head.kind == "regressor":
        score = 1 - F.sum(err * err) / F.nullif(F.var_pop("y") * F.count(F.lit(1)), F.lit(0.0))
    else:
        score = F.avg((err == 0).cast("double"))
    base = model.transform(data).agg(score.alias("s")).first().s or 0.0

    def once(seed: int) -> DataFrame:
        rows = permuted(data, key, names, seed).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in names])))
        swapped = rows.withColumns({f: F.when(F.col("feature") == f, F.col(f"_other.{f}")).otherwise(F.col(f)) for f in names})
        return model.transform(swapped.drop("_other")).groupBy("feature").agg(score.alias("s"))

    falls = reduce(DataFrame.unionByName, [once(i) for i in range(repeats)])
    mean = falls.groupBy("feature").agg(F.greatest(F.lit(0.0), F.lit(base) - F.avg("s")).alias("importance"))
    total = F.sum("importance").over(W.partitionBy())  # one row a feature
    return mean.withColumn("share", F.coalesce(F.col("importance") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))
