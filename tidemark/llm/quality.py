"""Quality scores by kernel ridge regression on document statistics.

Random Fourier features (Rahimi and Recht, 2007) of a text's statistics
approximate a Gaussian kernel.  Tasks sum their share of the normal equations;
the driver solves them once, a system of fixed size, and calibrates the leave-one-out scores by
isotonic regression on a fixed histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, rows

FEATURES, GAMMA, RIDGE, BINS = 256, 0.02, 1.0, 2000
_SINGLE = b"|$#%&*!?{}<>=_-@/\\+~^\"'`:;,.()[]"


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one whole text; null is as empty."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    hist = np.bincount(data, minlength=256).astype(np.float64)
    share = hist / n
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    long_lines = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    used = share[share > 0]
    capital = sum(map(str.istitle, words)) / m
    ends = sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines))
    out = [
        np.log1p(len(data)) / 3, np.log1p(len(words)) / 3, np.log1p(len(lines)) / 2, np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()) / 2,
        np.log1p(long_lines.mean()) / 2, np.log1p(long_lines.std()) / 2, len(set(words)) / m, len(set(lines)) / max(1, len(lines)),
        upper / (upper + lower + 1), hist[48:58].sum() / n, hist[128:].sum() / n, share[32], share[10], hist[[*_SINGLE]].sum() / n,
        capital, ends, -(used * np.log(used)).sum() if len(data) else 0.0, (lengths > 15).mean(), (lengths <= 2).mean(),
        (hist[46] + hist[33] + hist[63]) / m, hist[44] / m,
    ]
    return np.concatenate([out, np.sqrt(hist[[*_SINGLE]] / n)]).astype("<f4")


WIDTH = len(statistics(""))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row of ``docs`` (doc_id, text) in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([statistics(t).tobytes() for (t,) in rows(b, "text")], pa.binary())], names=["doc_id", "stats"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, stats binary")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None
    base: float = 0.5

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        raw = self.lift(stats) @ self.weights
        flat = np.interp(raw, *self.steps)
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)  # order within a flat step is kept


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    blobs = batch.column(batch.schema.get_field_index("stats")).to_pylist()
    return np.frombuffer(b"".join(blobs), "<f4").reshape(len(blobs), WIDTH).astype(np.float64)


def _summed(df: DataFrame, compute, size: int) -> np.ndarray:
    """The sum over all rows of ``compute(batch)`` (size x k), summed in each task and then row by row; at most ``size`` rows reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = compute(b)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())],
                names=["i", "v"],
            )

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"i": [key[0]], "v": [np.sum([np.frombuffer(bytes(v), "<f8") for v in pdf["v"]], axis=0).astype("<f8").tobytes()]}
        )

    got = df.mapInArrow(lean(part), "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").collect()
    return np.array([np.frombuffer(bytes(r[1]), "<f8") for r in sorted(got)]) if got else np.zeros((0, 0))


def invert(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix by Gauss-Jordan sweeps; no threaded LAPACK, which can hang beside the driver's gateway."""
    a = a.copy()
    for k in range(len(a)):
        pivot, row, column = a[k, k], a[k].copy(), a[:, k].copy()
        a -= column[:, None] * row / pivot
        a[k], a[:, k] = row / pivot, -column / pivot
        a[k, k] = 1 / pivot
    return a


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least squares by pooling adjacent violators; x is sorted."""
    pools: list[list[float]] = []
    for v, k in zip(y, w, strict=True):
        pools.append([v, k, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools[-1]
            pools[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def fit(train: DataFrame, seed: int = 7) -> Model:
    """A model from every row of ``train`` (stats, label 0/1).

    No rows give a model that answers 0.5; rows of one label give one that answers that label's value.
    """
    rng = np.random.default_rng(seed)
    model = Model(
        np.zeros(WIDTH), np.ones(WIDTH), rng.normal(size=(WIDTH, FEATURES)) * np.sqrt(2 * GAMMA), rng.uniform(0, 2 * np.pi, FEATURES),
    )
    y_of = lambda b: np.array(b.column(b.schema.get_field_index("label")).to_pylist(), np.float64)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, y = _stack(b), y_of(b)
        return np.concatenate([np.stack([x.sum(0), (x**2).sum(0)], 1), [[len(y), y.sum()]]])

    m = _summed(train, moments, WIDTH + 1)
    if not len(m):
        return model
    n, ones = m[-1]
    model.base = ones / n
    if ones in (0, n):
        return model
    model.mean = m[:-1, 0] / n
    model.scale = np.maximum(np.sqrt(np.maximum(m[:-1, 1] / n - model.mean**2, 0)), 1e-3)

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z = model.lift(_stack(b))
        return np.concatenate([z.T @ z, (z.T @ y_of(b))[:, None]], axis=1)

    a = _summed(train, normal, FEATURES + 1)
    inverse = invert(a[:, :-1] + RIDGE * np.eye(FEATURES + 1))
    weights = (inverse * a[:, -1]).sum(1)

    def calibration(b: pa.RecordBatch) -> np.ndarray:
        z, y = model.lift(_stack(b)), y_of(b)
        h = ((z @ inverse) * z).sum(1)
        out = (z @ weights - h * y) / np.maximum(1 - h, 1e-6)  # the score of a fit without this row
        at = np.clip((out + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)], 1)

    c = _summed(train, calibration, BINS)
    full = c[:, 0] > 0
    x = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[full]
    model.weights, model.steps = weights, (x, isotonic(x, c[full, 1] / c[full, 0], c[full, 0]))
    return model


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label) of documents with a quality label; a document with several labels counts once for each."""
    return stats.join(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)"),
        "doc_id",
    ).select("stats", "label")


def score(spark: SparkSession, stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with its score instead of the statistics; a map without a shuffle."""
    sent = spark.sparkContext.broadcast(model)
    kept = [f for f in stats.schema.fields if f.name != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(_stack(b)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(s, pa.float64())],
                names=[*(f.name for f in kept), "score"],
            )

    return stats.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Learns from the rows with a label in ``labels`` (doc_id, quality) whose crc32(doc_id) mod 5 is not 0.
    The statistics are computed once and written; text is never shuffled.  Null text is scored as empty; a null doc_id is neither
    learned from nor held out; repeated rows are scored alike; without labels every score is 0.5.
    Other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "quality")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    stats = scratch.save(describe(docs), "stats").withColumn("held_out", held)
    train = scratch.save(labelled(stats.where("not held_out and doc_id is not null"), labels), "train")
    scored = score(spark, stats, fit(train))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; texts are scored in place, not shuffled.

    Learns as :func:`quality` does; nulls, empty texts and repeated rows are treated as there.
    """
    scratch = scratch or Scratch(spark, "quality")
    stats = scratch.save(describe(docs), "stats")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(scratch.save(labelled(stats.where("doc_id is not null").where(~held), labels), "train"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for (t,) in rows(b, "text")], np.float64)
                yield b.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
