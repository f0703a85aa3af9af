"""Sinks: baselines, feature vectors, run history children, audit rows, versioned corpora and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import warehouse


def write_feature_vectors(features: DataFrame, selected: Sequence[str], path: str) -> None:
    """Feature table with the list of selected features next to every row."""
    features.withColumn("selected_by_variance", F.lit(",".join(selected))).write.mode("overwrite").parquet(path)


def save_profile(profile: DataFrame, path: str, domain: str) -> None:
    """Baseline or outlier profile of one domain; other domains in the table stay."""
    (
        profile.withColumn("domain", F.lit(domain))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)
    )


def load_profile(spark: SparkSession, path: str, domain: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("domain") == domain).drop("domain")


def replace_children(rows: DataFrame, path: str, partition: str = "run_date") -> None:
    """Child rows (anomalies, analytics months) of the partitions present in `rows` are rewritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Audit events, dataset batches and drift snapshots are only ever appended."""
    events.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_corpus_version(base: DataFrame, batch: DataFrame, keys: Sequence[str], root: str, version: int) -> DataFrame:
    """Merge a batch into the corpus and write the result as a new version folder."""
    path = f"{root.rstrip('/')}/v{version}"
    warehouse.merge_corpus(base, batch, keys).write.mode("errorifexists").parquet(path)
    return base.sparkSession.read.parquet(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Frozen table: the first write wins, later calls only read."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_warehouse(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


def save_model(model: PipelineModel, root: str, domain: str, head: str, version: int) -> str:
    path = f"{root.rstrip('/')}/{domain}/{head}/v{version}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
