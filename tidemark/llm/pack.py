"""Packing of token sequences along a Hilbert curve.

Each document's ids are projected to a few dimensions by hashed random
directions; its cell's place on a Hilbert curve is its sort key.  Documents in
curve order form one stream, which is cut every ``length`` ids: neighbours in a
sequence are neighbours on the curve, and only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, mix64, rows
from tidemark.llm.tokens import coder, id_type, tokenizer_json

DIMS, BITS = 4, 12
#: Bytes of ids that one task of the range sort takes: the lower bound at small sizes, the upper one where there are over SORT_TASKS such tasks.
SORT_BYTES, SORT_TASKS = (16 << 20, 128 << 20), 4000


def directions(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """A direction of zero mean and unit variance for each id, from a hash of the id."""
    h = mix64(np.arange(1, vocabulary * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) / 2.0**53 * 2 - 1).reshape(vocabulary, dims).astype(np.float32) * np.float32(3**0.5)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer cells (the transpose form of Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            x[0] ^= np.where(on, p, 0)
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def cells(means: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Squashes mean vectors to the integer grid; the scale is fixed, so keys never depend on other rows."""
    squashed = 1 / (1 + np.exp(-np.clip(means * 12, -30, 30)))
    return np.minimum((squashed * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def cut(batches: Iterator[pa.RecordBatch], width: str, length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of documents that begin at ``at`` of the stream; ``width`` is the type of their ids, so that no vocabulary is needed."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for doc_id, n, blob, at in rows(batch, "doc_id", "doc_tokens", "ids", "at"):
            ids, start = np.frombuffer(blob, width), 0
            while start < n:
                seq, off = divmod(at + start, length)
                k = min(length - off, n - start)
                piece = ids[start : start + k]
                for column, v in zip(
                    out, (doc_id, start, k, zlib.crc32(piece.astype("<u4").tobytes()), n, seq, off, piece.tobytes()), strict=True,
                ):
                    column.append(v)
                start += k
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(out)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(
    spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = 1024, scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) for each piece of ``docs`` (doc_id, text).

    Each text is encoded once and written with its key; the written ids are
    range-sorted by (key, doc_id) in as many tasks as their size asks for; the stream's offsets come from the sums of
    the sorted partitions, of which there are as many rows as partitions.
    Null text is as empty: such a document is its end id alone.  Ties on the
    curve go by doc_id; repeated rows are documents of their own; no rows give no
    pieces.  Other columns are ignored.  ``ids`` holds a piece's ids, little-endian u2 or u4.
    """
    spec = tokenizer_json(vocabulary)
    scratch = scratch or Scratch(spark, "pack")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(spec)
        end = np.array([end_id], enc.dtype).tobytes()
        r = directions(enc.tokenizer.get_vocab_size())
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                doc_ids, blobs, means = [], [], []
                for doc_id, text in rows(batch.slice(i, 1000), "doc_id", "text"):
                    blob = enc.encode(text) + end
                    ids = np.frombuffer(blob, enc.dtype)
                    doc_ids.append(doc_id)
                    blobs.append(blob)
                    means.append(r[ids].mean(axis=0, dtype=np.float64))
                keys = hilbert(cells(np.array(means)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(keys), pa.array([len(b) // enc.dtype.itemsize for b in blobs], pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "key", "doc_tokens", "ids"],
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("doc_tokens")).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "doc_tokens", "ids", "part")), pa.array(ends - n)],
                names=["doc_id", "doc_tokens", "ids", "part", "local"],
            )
            at = int(ends[-1]) if len(ends) else at

    coded = scratch.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            lean(encode), "doc_id long, key long, doc_tokens long, ids binary",
        ),
        "coded",
    )
    width = id_type(spec)
    size = (coded.agg(F.sum("doc_tokens")).first()[0] or 0) * np.dtype(width).itemsize
    each = min(max(size // SORT_TASKS, SORT_BYTES[0]), SORT_BYTES[1])
    tasks = max(spark.sparkContext.defaultParallelism, size // each + 1)
    ordered = coded.repartitionByRange(int(tasks), "key", "doc_id").sortWithinPartitions("key", "doc_id", "doc_tokens").withColumn(
        "part", F.spark_partition_id(),
    )
    placed = scratch.save(ordered.mapInArrow(lean(place, forget=True), "doc_id long, doc_tokens long, ids binary, part int, local long"), "placed")
    scratch.drop("coded")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.sum("doc_tokens").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"),
    )
    located = placed.join(F.broadcast(bases), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("base") + F.col("local")).alias("at"),
    )  # bases: a row for each partition
    return located.mapInArrow(
        lean(partial(cut, width=width, length=length), forget=True),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
