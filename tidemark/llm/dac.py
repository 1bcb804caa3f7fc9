"""Token files with directly addressable codes.

An id is cut into chunks of eight bits.  Level k holds the k-th chunk of every id
that has one, and a bitmap that says which of them go on; a rank directory over
the bitmap leads to the place on the next level.  Any id is read by at most as
many steps as it has chunks, without decoding what stands before it.

File: magic ``TMDAC001``; length (u4) and text of a JSON header; document ids
(i8), null flags (u1) and token starts (i8, one more than documents); then for
each level the chunks (u1), the bitmap (u1, least bit first) and its directory (u4: ones
before each block of 512 bits).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, rows
from tidemark.llm.tokens import coder, tokenizer_json

MAGIC = b"TMDAC001"
BLOCK = 512
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level; one empty level for no ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(_POP[bits].astype(np.uint32), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.empty(0, np.uint32)
        out.append(((rest & 0xFF).astype(np.uint8), bits, (np.cumsum(blocks) - blocks).astype("<u4")))
        if not more.any():
            return out
        rest = rest[more] >> 8


class DacFile:
    """Random access to one file's tokens and documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:12], "little")
        self.head = json.loads(data[12 : 12 + size])
        at, n = 12 + size, self.head["n_docs"]

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.starts = take("<i8", n), take("u1", n), take("<i8", n + 1)
        self.levels = [(take("u1", k), take("u1", -(-k // 8)), take("<u4", -(-k // BLOCK))) for k in self.head["levels"]]

    def at(self, index: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order."""
        place, out = np.asarray(index, np.int64), np.zeros(len(index), np.uint32)
        left = np.arange(len(place))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[left] |= chunks[place].astype(np.uint32) << np.uint32(8 * k)
            byte, bit = place >> 3, (place & 7).astype(np.uint8)
            more = (bits[byte] >> bit) & 1 == 1
            if not more.any():
                break
            place, byte, bit, left = place[more], byte[more], bit[more], left[more]
            rank = ranks[place // BLOCK].astype(np.int64) + _POP[bits[byte] & ((np.uint8(1) << bit) - np.uint8(1))]
            first = (place // BLOCK) * (BLOCK // 8)
            gap = byte - first  # whole bytes between the block's start and this one: at most 63
            ones = np.concatenate([[0], np.cumsum(_POP[bits], dtype=np.int64)]) if len(place) * 16 > len(bits) else None
            if ones is not None:
                rank += ones[byte] - ones[first]
            else:
                for j in range(BLOCK // 8 - 1):
                    on = gap > j
                    rank[on] += _POP[bits[first[on] + j]]
            place = rank
        return out

    def document(self, i: int) -> np.ndarray:
        return self.at(np.arange(self.starts[i], self.starts[i + 1]))


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    head = json.dumps(
        {"n_docs": len(doc_ids), "n_tokens": len(ids), "chunk_bits": 8, "block": BLOCK, "levels": [len(x[0]) for x in levels]}
    ).encode()
    starts = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype("<i8")
    parts = [
        MAGIC, len(head).to_bytes(4, "little"), head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), starts.tobytes(),
    ]
    return b"".join(parts + [x.tobytes() for level in levels for x in level])


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, scratch: Scratch, end_id: int = 2, tokens_per_file: int = 4_000_000,
) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as ``*.dac`` files in ascending doc_id order; returns the manifest (file_no, n_docs, n_tokens, base).

    One range shuffle of the texts orders them; each task then encodes its range
    once and writes files of about ``tokens_per_file`` ids under their final name only when whole, so a
    repeated task replaces its own files.  Null text is as empty; rows with equal doc_id stay rows of their own, a null doc_id sorts
    first; no rows give no files.  Other columns are ignored.
    """
    spec = tokenizer_json(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        enc, part, k = coder(spec), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        doc_ids: list = []
        pieces: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, pieces, held, k
            lengths = [len(p) // enc.dtype.itemsize for p in pieces]
            ids = np.frombuffer(b"".join(pieces), enc.dtype)
            name = part * 100_000 + k
            own = f"{root}/.{name:012d}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(file_bytes(doc_ids, lengths, ids))
            store.move(own, f"{root}/{name:012d}.dac")
            out = pa.RecordBatch.from_pydict({"file_no": [name], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}, schema)
            doc_ids, pieces, held, k = [], [], 0, k + 1
            return out

        schema = pa.schema([("file_no", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for doc_id, text in rows(batch, "doc_id", "text"):
                doc_ids.append(doc_id)
                pieces.append(enc.encode(text) + end)
                held += len(pieces[-1]) // enc.dtype.itemsize
                if held >= tokens_per_file:
                    yield close()
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = scratch.save(ordered.mapInArrow(lean(write), "file_no long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("file_no", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        )
        for batch in batches:
            for name, data in rows(batch, "path", "content"):
                f = DacFile(data)
                n = f.head["n_tokens"]
                ids = np.concatenate(
                    [f.at(np.arange(i, min(n, i + 1_000_000))) for i in range(0, n, 1_000_000)] or [np.empty(0, np.uint32)]
                ).astype("<u4")
                s = f.starts
                crc = [zlib.crc32(ids[s[i] : s[i + 1]].tobytes()) for i in range(len(s) - 1)]
                doc_ids = pa.array(f.doc_ids, pa.int64(), mask=f.nulls.astype(bool))
                no = int(name.rsplit("/", 1)[1].split(".")[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crc), no)), doc_ids, pa.array(s[:-1]), pa.array(np.diff(s)), pa.array(crc, pa.int64())],
                    schema=schema,
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(path).select("path", "content")
    found = files.mapInArrow(lean(read), "file_no long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(manifest.select("file_no", "base"), "file_no").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
    )


def tokenize_to_files(spark: SparkSession, docs: DataFrame, vocabulary: str) -> tuple[str, DataFrame]:
    """Writes the files to the shared folder; returns their path and manifest."""
    scratch = Scratch(spark, "dac")
    path = scratch.mkdirs("files")
    return path, write_tokens(docs, path, vocabulary, scratch)
