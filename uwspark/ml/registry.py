"""Versioned models: append-only versions, an active marker, the golden-set gate, re-evaluation in place.

A version is a folder `v<n>` below `<root>/<domain>`.  Creating its claim without
overwriting reserves the number, so two writers never share one.  Version rows are tables of
their own folders and are never changed; metrics lie apart, because re-evaluation replaces them.
The active version is the one named by the last of the empty files in `_active`: a name appears at
once or not at all on every file system, so a reader sees the old or the new version, never half
of one.  Of two switches at the same moment the higher version counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import sinks
from . import evaluation
from .heads import Head

#: How far a candidate may fall below the active model on the golden set.
MAX_REGRESSION = 0.03
QUALITY = "0.5D * accuracy + 0.3D * f1 + 0.2D * r2"


def gate(candidate: Column, active: Column, limit: float = MAX_REGRESSION) -> Column:
    """Whether a candidate may become active: no active model, or no fall beyond the limit."""
    return active.isNull() | ~(active - candidate > limit)


def replay(versions: DataFrame, domain: str = "domain", limit: float = MAX_REGRESSION) -> DataFrame:
    """(domain, version, promote, active): the gate and the active version after each save.

    Versions carry `version`, `accuracy`, `f1`, `r2` and `golden`.  A promoted save makes the best
    version so far active (quality, the earlier one among equals); a blocked one leaves the active
    version, or the best one where there was none.  A domain is as long as its list of versions, so
    it is folded inside its row.
    """
    item = F.struct("version", F.expr(QUALITY).alias("q"), F.col("golden"))
    logs = versions.groupBy(domain).agg(F.sort_array(F.collect_list(item)).alias("log"))
    start = F.expr(
        "named_struct('best', cast(null as bigint), 'q', cast(null as double), 'best_golden', cast(null as double), "
        "'active', cast(null as bigint), 'golden', cast(null as double), 'out', "
        "cast(array() as array<struct<version: bigint, promote: boolean, active: bigint>>))"
    )

    def step(s: Column, v: Column) -> Column:
        better = s["q"].isNull() | (v["q"] > s["q"])
        best = F.when(better, v["version"]).otherwise(s["best"])
        best_golden = F.when(better, v["golden"]).otherwise(s["best_golden"])
        promote = gate(v["golden"], s["golden"], limit)
        move = promote | s["active"].isNull()
        active = F.when(move, best).otherwise(s["active"])
        row = F.struct(v["version"].alias("version"), promote.alias("promote"), active.alias("active"))
        return F.struct(
            best.alias("best"),
            F.when(better, v["q"]).otherwise(s["q"]).alias("q"),
            best_golden.alias("best_golden"),
            active.alias("active"),
            F.when(move, best_golden).otherwise(s["golden"]).alias("golden"),
            F.concat(s["out"], F.array(row)).alias("out"),
        )

    folded = logs.select(domain, F.aggregate("log", start, step, lambda s: s["out"]).alias("out"))
    return folded.select(domain, F.inline("out"))


@dataclass(frozen=True)
class Registry:
    """Model versions of one root folder that every executor can reach."""

    spark: SparkSession
    root: str

    def _folder(self, domain: str) -> str:
        return f"{self.root.rstrip('/')}/{domain}"

    def _path(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def claim(self, domain: str) -> int:
        """The next version number, reserved for the caller."""
        n = max(self.numbers(domain), default=0)
        while True:
            n += 1
            path, files = self._path(f"{self._folder(domain)}/v{n}/_claim")
            try:
                if files.getScheme() == "file":
                    # Hadoop's local file system looks first and creates then; the call below does both at once
                    files.mkdirs(path.getParent())
                    nio = self.spark._jvm.java.nio.file
                    nio.Files.createDirectory(nio.Path.of(path.toUri().getPath(), self._no_names()), self._no_attributes())
                else:
                    files.create(path, False).close()
                return n
            except Exception as e:  # the number is taken: another writer was first
                if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                    raise

    def _no_names(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    def _no_attributes(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0)

    def numbers(self, domain: str) -> list[int]:
        """All claimed version numbers, a listing of one folder."""
        path, files = self._path(self._folder(domain))
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(x[1:]) for x in names if x[0] == "v" and x[1:].isdigit())

    def _switches(self, domain: str) -> list[tuple[int, int]]:
        """(place, version) of every switch so far, a listing of one folder."""
        path, files = self._path(f"{self._folder(domain)}/_active")
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(tuple(int(x) for x in n.split("-v")) for n in names if n[0].isdigit())

    def active(self, domain: str) -> int | None:
        """The version that is served, None before the first switch."""
        switches = self._switches(domain)
        return switches[-1][1] if switches else None

    def activate(self, domain: str, version: int) -> bool:
        """Serve a stored version from now on; false if there is none of that number."""
        if version not in self.numbers(domain):
            return False
        place = max((p for p, _ in self._switches(domain)), default=0) + 1
        path, files = self._path(f"{self._folder(domain)}/_active/{place:09d}-v{version}")
        files.create(path, True).close()
        return True

    def versions(self, domain: str) -> DataFrame | None:
        """Version rows with their metrics and `active`, None without versions."""
        done = [n for n in self.numbers(domain) if self._stored(domain, n)]
        if not done:
            return None
        rows = self.spark.read.parquet(*[f"{self._folder(domain)}/v{n}/version" for n in done])
        metrics = self.spark.read.parquet(*[f"{self._folder(domain)}/v{n}/metrics" for n in done])
        now = self.active(domain)
        return rows.join(metrics, "version").withColumn("active", F.col("version").eqNullSafe(F.lit(now).cast("bigint")))

    def _stored(self, domain: str, n: int) -> bool:
        path, files = self._path(f"{self._folder(domain)}/v{n}/metrics/_SUCCESS")
        return files.exists(path)

    def save(
        self, domain: str, models: dict[str, PipelineModel], metrics: DataFrame, *, algorithm: str, samples: int, golden: float | None
    ) -> dict:
        """Store the heads of a domain as a new version and set the active version as the gate says.

        `metrics` is one row (accuracy, f1, r2); missing values count as 0.
        """
        version = self.claim(domain)
        folder = f"{self._folder(domain)}/v{version}"
        for head, model in models.items():
            model.write().save(f"{folder}/heads/{head}")
        self.spark.createDataFrame(
            [(version, algorithm, samples, golden, sorted(models))],
            "version bigint, algorithm string, samples bigint, golden double, heads array<string>",
        ).coalesce(1).write.parquet(f"{folder}/version")
        self._write_metrics(domain, version, metrics)
        rows = self.versions(domain)
        before = self.active(domain)
        known = {r.version: (r.golden, r.q) for r in rows.select("version", "golden", F.expr(QUALITY).alias("q")).collect()}  # a row a version
        held = known.get(before, (None, None))[0]
        promote = held is None or golden is None or held - golden <= MAX_REGRESSION
        best = min(known, key=lambda v: (-known[v][1], v))
        target = best if promote or before is None else before
        self.activate(domain, target)
        return {"version": version, "promote": promote, "active": target}

    def _write_metrics(self, domain: str, version: int, metrics: DataFrame) -> None:
        names = ("accuracy", "f1", "r2")
        filled = metrics.select(
            F.lit(version).cast("bigint").alias("version"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in metrics.columns else F.lit(0.0).alias(c) for c in names],
        )
        filled.coalesce(1).write.mode("overwrite").parquet(f"{self._folder(domain)}/v{version}/metrics")

    def load(self, domain: str, head: str, version: int | None = None) -> PipelineModel:
        """A stored head, of the active version unless another is named."""
        n = self.active(domain) if version is None else version
        return sinks.load_model(f"{self._folder(domain)}/v{n}/heads/{head}")

    def reevaluate(self, domain: str, rows: DataFrame, heads_: list[Head], key: str, k: int = 3) -> DataFrame | None:
        """Fold metrics of every head of the active version on the rows of today, written back in place.

        The heads are refitted per fold with the algorithm of that version; the stored models and the
        version row stay as they are.  None without an active version.
        """
        n = self.active(domain)
        if n is None:
            return None
        algorithm = self.spark.read.parquet(f"{self._folder(domain)}/v{n}/version").first().algorithm
        out = None
        for head in heads_:
            part = evaluation.evaluated(rows, head, key, k, algorithm)
            out = part if out is None else out.unionByName(part)
        self._write_metrics(domain, n, out.agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"), F.avg("r2").alias("r2")))
        return out
