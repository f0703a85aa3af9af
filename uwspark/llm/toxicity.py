"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, from
the words of either class that are characteristic of it: those that follow at
least LEAST_NEIGHBOURS different words in the sample (copies of a document count
once this way) and RATIO times as many, in proportion, as in the other class.
A text is cut into overlapping windows, and each window is compressed with both
dictionaries; the difference of the lengths is its distance.  A logistic curve
over the largest distances and the shares of windows beyond the thresholds, fitted
on sample rows that trained no dictionary, turns them into a score; it is shifted so
that one half is the cut that loses a bounded share of the ordinary ones (`Sizes.clean_loss`).

The fit uses a bounded sample of labelled rows (`Sizes`) and no held-out row;
scoring reads every window of every text, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import query, table, whole

WINDOW, STEP = 32, 20
LEAST_NEIGHBOURS, RATIO = 12, 3.0
THRESHOLDS = (2, 3, 4, 5)
TRIM = ".,;:!?#*&%$()[]\"'"


@dataclass(frozen=True)
class Sizes:
    """Bounds of the training sample and of a dictionary."""

    toxic_rows: int = 1500
    ordinary_rows: int = 3000
    code_points: int = 16_384  # longer labelled texts are scored, not learned from
    clean_loss: float = 0.02  # share of ordinary calibration rows that may score one half or more
    dictionary: int = 4096


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # the last is the constant


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    line = (" " + " ".join(words) + " ").encode()
    return [line[i : i + WINDOW] for i in range(0, max(1, len(line) - (WINDOW - STEP)), STEP)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    def __init__(self, model: Model):
        self.toxic, self.ordinary = _compressor(model.toxic).compress, _compressor(model.ordinary).compress
        self.weights = np.array(model.weights)

    def features(self, text: str) -> np.ndarray:
        """Largest and second largest distance, shares of windows at each threshold, and a one."""
        out = np.zeros(3 + 2 * len(THRESHOLDS))
        out[-1] = 1
        cut = windows(text)
        if cut:
            toxic, ordinary = self.toxic, self.ordinary
            d = np.array([len(ordinary(w)) - len(toxic(w)) for w in cut])
            top = np.sort(d)[-2:]
            out[0], out[1] = top[-1] / 4, (top[0] if len(d) > 1 else 0) / 4
            beyond = (d[None, :] >= np.array(THRESHOLDS)[:, None]).sum(axis=1)
            out[2:-1] = np.r_[beyond * 10 / len(d), np.log1p(beyond)]
        return out

    def score(self, text: str) -> float:
        return float(round(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))), 6))


def _neighbours(texts: list[str]) -> dict[str, int]:
    """Number of different words each word of three or more letters follows."""
    found = defaultdict(set)
    for text in texts:
        before = ""
        for word in text.lower().split():
            word = word.strip(TRIM)
            if len(word) > 2:
                found[word].add(before)
            before = word
    return {w: len(s) for w, s in found.items()}


def _characteristic(own: dict[str, int], other: dict[str, int]) -> set[str]:
    total, rest = sum(own.values()) or 1, sum(other.values()) or 1
    return {w for w, n in own.items() if n >= LEAST_NEIGHBOURS and n / total >= RATIO * (other.get(w, 0) + 1) / rest}


def _dictionary(texts: list[str], words: set[str], size: int) -> bytes:
    samples = []
    for text in texts:
        kept = [w for w in (x.strip(TRIM) for x in text.lower().split()) if w in words]
        if kept:
            samples.append((" " + " ".join(kept) + " ").encode().ljust(8))
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(dict.fromkeys(samples))[:size]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], share: float, sizes: Sizes = Sizes()) -> Model:
    """Dictionaries from every other text of the sample, curve from the rest; `share` of toxic rows among all labelled."""
    if not toxic or not ordinary:
        p = min(max(share, 0.001), 0.999)
        return Model(b"", b"", (0.0,) * (2 + 2 * len(THRESHOLDS)) + (float(np.log(p / (1 - p))),))
    train = toxic[::2], ordinary[::2]
    seen = [_neighbours(t) for t in train]
    words = _characteristic(*seen), _characteristic(*seen[::-1])
    dictionaries = [_dictionary(t, w, sizes.dictionary) for t, w in zip(train, words)]
    scorer = Scorer(Model(*dictionaries, (0.0,) * (3 + 2 * len(THRESHOLDS))))
    rest = (toxic[1::2] or toxic), (ordinary[1::2] or ordinary)
    x = np.array([scorer.features(t) for group in rest for t in group])
    y = np.r_[np.ones(len(rest[0])), np.zeros(len(rest[1]))]
    n = len(y)
    weight = np.r_[np.full(len(rest[0]), share * n / len(rest[0])), np.full(len(rest[1]), (1 - share) * n / len(rest[1]))]
    curve = _logistic(x, y, weight)
    # the cut that catches most within the bound on clean loss, half-way to the next row, becomes one half;
    # it is never above the curve's own
    at = x @ curve
    last = np.sort(at[y == 0])[::-1][int(sizes.clean_loss * (y == 0).sum())]
    above = at[at > last + 1e-9]
    curve[-1] -= min(0.0, float((last + above.min()) / 2) if len(above) else 0.0)
    return Model(*dictionaries, tuple(curve.tolist()))


def held_out(id_col: str):
    """One row in five by a checksum of its id; a null id is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sizes: Sizes = Sizes()) -> Model:
    """Fit on the labelled, not held-out rows with the smallest hashes of their ids, `sizes` of either class at most.

    Without rows of both classes every score is the share of toxic ones, kept from 0.001 to 0.999; no label counts as none.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col)).cast("int").alias("_y")
    )
    n, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    mixed = F.xxhash64(F.lit("sample"), F.col("_id"))
    pick = [known.where(F.col("_y") == y).orderBy(mixed, "_id").limit(k) for y, k in ((1, sizes.toxic_rows), (0, sizes.ordinary_rows))]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # at most toxic_rows + ordinary_rows ids
    text = F.col(text_col)
    rows = (
        docs.where(text.isNotNull() & (F.char_length(text) <= sizes.code_points))
        .join(chosen, F.col(id_col) == F.col("_id")).groupBy("_id", "_y").agg(F.min(text).alias("_text"))
        .orderBy(mixed, "_id").limit(sizes.toxic_rows + sizes.ordinary_rows).collect()
    )
    by = {y: [r["_text"] for r in rows if r["_y"] == y] for y in (0, 1)}
    return fit(by[1], by[0], float(bad) / n if n else 0.0, sizes)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null or empty text has the score of a text without any window.  Rows repeated or
    with a null id are each scored.  An empty table gives an empty result.  Other columns
    are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), whole(text_col).alias("_text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            score = pa.array([scorer.score(t.as_py()) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("held_out"), score], ["_id", "held_out", "score"])

    out = rows.mapInArrow(step, f"_id {kind}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores under 0.5; nulls and repeated rows as in `scored`."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            keep = [scorer.score(t.as_py() or "") < 0.5 for t in b.column(text_col)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(step, docs.schema)


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
