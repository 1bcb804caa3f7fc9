"""Language identification as a mixture.

Letter trigrams of a text are taken as drawn from a mixture of the learned
languages' trigram distributions.  Expectation-maximisation estimates the
proportions; the language set is the one that pays for its size: a language is
added only while it raises the log-likelihood by more than its penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lean, rows, worker_cache

BUCKETS = 1 << 15


def _letters() -> np.ndarray:
    """Code point -> itself where a letter of the first plane, 32 otherwise; further planes' letters share one code."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(1 << 16)), np.uint32, 1 << 16)


def grams(text: str) -> np.ndarray:
    """Buckets of the trigrams around each letter of the lower-cased text, non-letters being blanks."""
    table = worker_cache("letters", _letters)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = c >= 1 << 16
    c = table[np.where(wide, 32, c)] if not wide.any() else np.where(
        wide, [ord("￿") if chr(x).isalpha() else 32 for x in c], table[np.where(wide, 32, c)],
    ).astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17))[c[1:-1] != 32].astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-free probabilities by language and bucket) from every row of ``docs`` (text, lang).

    Counts are summed in each task, then by (lang, bucket); the driver gets languages x BUCKETS counts at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            own: dict[str, list[np.ndarray]] = {}
            for text, lang in rows(batch, "text", "lang"):
                own.setdefault(lang, []).append(grams(text))
            for lang, bags in own.items():
                n = np.bincount(np.concatenate(bags), minlength=BUCKETS)
                sums[lang] = sums[lang] + n if lang in sums else n
        for lang, v in sums.items():
            at = np.nonzero(v)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at])], names=["lang", "bucket", "n"],
            )

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    got = known.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    p = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        p[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, p / p.sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, n: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of counts ``n`` under a mixture of the rows of ``p``."""
    w, total, last = np.full(len(p), 1 / len(p)), n.sum(), -np.inf
    for _ in range(steps):
        mixed = w @ p
        value = float(n @ np.log(mixed))
        if value - last < 1e-6 * abs(value):
            break
        last = value
        w = w * (p @ (n / mixed)) / total
    return w, value


def identify(p: np.ndarray, bag: np.ndarray, penalty: float = 4.0) -> tuple[list[int], np.ndarray]:
    """The chosen languages, largest first, and their proportions.

    penalty: log-likelihood that a further language must gain, times the log of the number of grams; over 0.5
    (the usual half log) since neighbouring trigrams overlap.
    """
    at, n = np.unique(bag, return_counts=True)
    q, n = p[:, at], n.astype(np.float64)
    full, _ = mixture(q, n)
    order = np.argsort(-full, kind="stable")
    order = order[(full[order] > 0.01) | (np.arange(len(order)) == 0)]
    chosen, w, value = order[:1], np.ones(1), float(n @ np.log(q[order[0]]))
    for k in range(2, len(order) + 1):
        more, raised = mixture(q[order[:k]], n)
        if raised - value <= penalty * np.log(n.sum() + 1):
            break
        chosen, w, value = order[:k], more, raised
    best = np.argsort(-w, kind="stable")
    return [int(chosen[i]) for i in best], full[chosen[best]]


def predict(
    spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, lang_pred, score, langs, shares) for each row of ``docs`` (doc_id, text); no shuffle.

    Null text, a text without letters and an empty model give ``und`` with score 0; ties go to the first
    language by name; repeated rows are predicted alike; no rows give none.  Other columns are ignored but the boolean ones
    in ``carry``, which pass unseen.
    """
    sent = spark.sparkContext.broadcast(model)
    extra = list(carry)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = sent.value
        for batch in batches:
            out: list[tuple] = []
            for (text,) in rows(batch, "text"):
                bag = grams(text) if text and langs else ()
                if not len(bag):
                    out.append(("und", 0.0, [], []))
                    continue
                chosen, w = identify(p, bag, penalty)
                out.append((langs[chosen[0]], min(1.0, float(w[0])), [langs[i] for i in chosen], [float(x) for x in w]))
            a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(batch.column(2 + i) for i in range(len(extra))), pa.array(a, pa.string()), pa.array(b, pa.float64()),
                    pa.array(c, pa.list_(pa.string())), pa.array(d, pa.list_(pa.float64())),
                ],
                names=["doc_id", *extra, "lang_pred", "score", "langs", "shares"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(
        lean(guess),
        "doc_id long, " + "".join(f"{c} boolean, " for c in extra) + "lang_pred string, score double, langs array<string>, shares array<double>",
    )
