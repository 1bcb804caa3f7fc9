"""Shared folder handling and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "file:///tmp/checkpoints/tidemark"
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows in a batch that goes to a Python worker; with whole texts Spark's default of 10,000 takes too much memory on both sides.
BATCH_ROWS = 1000
#: Rows that the Parquet reader holds at once; with whole texts its default of 4,096 makes arrays of many MB, which the collector places apart and the heap grows for.
READ_ROWS = 512
#: setting -> Spark's default, ours
_ROWS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", READ_ROWS),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share, ``spark.checkpoint.dir``.

    Where it is unset, a session of one process (as in tests) gets a local folder; on a cluster, whose nodes would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {master} share")
        base = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts lineage: a lost executor costs a reread, not a rerun.
    Tables stay until :meth:`drop` or :meth:`clear`, or the end of the driver.
    """

    live: list["Scratch"] = []

    def __init__(self, spark: SparkSession, label: str):
        for name, (default, ours) in _ROWS.items():
            if spark.conf.get(name, default) == default:  # a session's own choice stands
                spark.conf.set(name, ours)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex[:12]}"
        Scratch.live.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        self._delete(self.root)
        if self in Scratch.live:
            Scratch.live.remove(self)

    def mkdirs(self, name: str) -> str:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(conf).mkdirs(p)
        return self.path(name)


@atexit.register
def _clear_all() -> None:
    for s in list(Scratch.live):
        try:
            s.clear()
        except Exception:  # the session may be gone already
            pass


def worker_cache(name: str, make):
    """An object of a Python worker, kept between its tasks until one of another name is asked for; a worker runs one task at a time."""
    home = sys.modules.setdefault("_tidemark_worker_cache", types.ModuleType("_tidemark_worker_cache"))
    held = home.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def worker_forget() -> None:
    """Gives up what :func:`worker_cache` holds."""
    if home := sys.modules.get("_tidemark_worker_cache"):
        home.__dict__.get("held", {}).clear()


def lean(run, forget: bool = False):
    """``run`` over a task's batches; what it freed goes back to the system at the task's end, so that idle workers stay small.

    ``forget``: for tasks without a remembered object, which first give up that of an earlier step.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            worker_forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """word -> 64-bit hash, remembered for up to ``most`` words."""

    most = 400_000

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hash() -> WordHash:
    return worker_cache("word_hash", WordHash)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of k consecutive words; fewer words make one shorter run; none, none."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out *= mult
        out += h[i : n - k + 1 + i]
    return mix64(out)


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of an Arrow batch as Python tuples."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
