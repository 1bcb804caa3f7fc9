"""Embedding near-duplicates by epsilon grid order (Boehm et al., 2001).

Unit vectors are sorted by the grid cells of their leading principal coordinates, and the sorted
sequence is cut into blocks.  The sequence is joined with itself by recursion over its intervals: a pair of intervals
that are provably further apart than epsilon is skipped, any other is split, from the whole sequence of a label down to pairs of
blocks (as joins, one for each level) and on within a pair of blocks (in a task).  A projection never lengthens a distance, so
nothing within epsilon is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, rows
from tidemark.llm.graph import components

DIMS, BLOCK, LEAF, SAMPLE = 8, 512, 64, 2000
#: An interval of the sequence has 2 ** FAN parts.
FAN = 4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is brought to 1 first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _basis(sample: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions of a sample of at most SAMPLE unit vectors, for each length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for (v,) in rows(b, "embedding"):
                by.setdefault(len(v), []).append(v)
        for n, vs in by.items():
            x = unit(np.array(vs, np.float64))
            _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=True)
            yield pa.RecordBatch.from_pydict({"n": [n], "basis": [vt[:DIMS].astype("<f8").tobytes()]})

    got = sample.coalesce(1).mapInArrow(lean(run), "n long, basis binary").collect()
    return {r[0]: np.frombuffer(bytes(r[1]), "<f8").reshape(-1, r[0]) for r in got}


def _blocks(reps: DataFrame, eps: float, bases: dict[int, np.ndarray]) -> DataFrame:
    """The sorted sequence in blocks of up to BLOCK vectors of one label and length, with the box of each block's coordinates."""
    sent = reps.sparkSession.sparkContext.broadcast(bases)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, points = [], []
            for (v,) in rows(b, "embedding"):
                x = unit(np.array([v], np.float64))[0]
                basis = sent.value.get(len(x))
                y = np.zeros(DIMS) if basis is None else np.pad((basis * x).sum(1), (0, DIMS - len(basis)))
                points.append(y.tobytes())
                cells.append(np.floor(y / eps).astype(np.int32).tolist())
            new = [pa.array(cells, pa.list_(pa.int32())), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "cell", "point"])

    kinds = {
        "part": pa.int64(), "k": pa.int64(), "label": pa.string(), "n": pa.int32(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()),
        "ids": pa.binary(), "mults": pa.binary(), "vectors": pa.binary(), "points": pa.binary(),
    }

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, key = TaskContext.get().partitionId(), 0, [], None

        def close() -> pa.RecordBatch:
            nonlocal k, held
            ids, mults, vectors, points = (list(x) for x in zip(*held, strict=True))
            box = np.frombuffer(b"".join(points)).reshape(-1, DIMS)
            row = (
                part, k, *key, box.min(0).tolist(), box.max(0).tolist(),
                np.array(ids, "<i8").tobytes(), np.array(mults, "<i8").tobytes(), np.array(vectors, "<f8").tobytes(), box.tobytes(),
            )
            k, held = k + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            for rep, mult, v, label, point in rows(b, "rep", "mult", "embedding", "label", "point"):
                if held and ((label, len(v)) != key or len(held) >= BLOCK):
                    yield close()
                key = (label, len(v))
                held.append((rep, mult, v, point))
        if held:
            yield close()

    placed = reps.mapInArrow(lean(project), "rep long, mult long, label string, embedding array<double>, cell array<int>, point binary")
    order = ["label", F.size("embedding"), *(F.col("cell")[i] for i in range(DIMS)), "rep"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part long, k long, label string, n int, lo array<double>, hi array<double>, ids binary, mults binary, vectors binary, points binary"
    return ordered.mapInArrow(lean(cut), schema)


def near_blocks(meta: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: blocks of ``meta`` (id, label, n, lo, hi) of one label and length whose boxes come within ``eps``.

    ids are places in the sorted sequence.  An interval is an aligned run of 2 ** (FAN * level) places of one label;
    from the whole down, pairs of intervals are joined with their parts and only those that may hold near vectors stay.
    """
    highest = meta.agg(F.max("id")).first()[0] or 0
    levels = [meta.select("id", "label", "n", "lo", "hi")]
    while highest >> (FAN * (len(levels) - 1)):
        edge = lambda f, c: F.array(*(f(F.col(c)[i]) for i in range(DIMS))).alias(c)
        up = levels[-1].groupBy(F.shiftright("id", FAN).alias("id"), "label", "n").agg(edge(F.min, "lo"), edge(F.max, "hi"))
        levels.append(scratch.save(up, f"level{len(levels)}"))
    pairs = levels[-1].select("label", "n", F.col("id").alias("a"), F.col("id").alias("b"))
    apart = lambda x, y: F.zip_with(x, y, lambda u, v: u - v)
    gaps = F.zip_with(apart("lo_a", "hi_b"), apart("lo_b", "hi_a"), lambda u, v: F.greatest(u, v, F.lit(0.0)))
    for level in range(len(levels) - 2, -1, -1):
        part = lambda s: levels[level].select(
            "label", "n", F.shiftright("id", FAN).alias(s), F.col("id").alias(f"id_{s}"), F.col("lo").alias(f"lo_{s}"),
            F.col("hi").alias(f"hi_{s}"),
        )  # noqa: B023, E731
        split = pairs.join(part("a"), ["label", "n", "a"]).join(part("b"), ["label", "n", "b"])
        close = split.where("id_a <= id_b").where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps)
        pairs = scratch.save(close.select("label", "n", F.col("id_a").alias("a"), F.col("id_b").alias("b")), f"pairs{level}")
    return pairs.where("a < b").select("a", "b")


def join_blocks(
    xa: np.ndarray, pa_: np.ndarray, xb: np.ndarray, pb: np.ndarray, cosine: float, eps: float, same: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) with cosine of at least ``cosine``; i < j within one block."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    todo = [(0, len(xa), 0, len(xb))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0 + 1:
            continue
        p, q = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(xa[a0:a1] @ xb[b0:b1].T >= cosine)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
            continue
        am, bm = (a0 + a1) // 2 if a1 - a0 > LEAF else a1, (b0 + b1) // 2 if b1 - b0 > LEAF else b1
        todo += [(s, t, u, v) for s, t in ((a0, am), (am, a1)) if s < t for u, v in ((b0, bm), (bm, b1)) if u < v]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _found(a: tuple, b: tuple | None, cosine: float, eps: float) -> pa.RecordBatch:
    """(rep, n, low): for each vector of a block, or of two, the vectors that it links with there and the least id that it reaches."""

    def load(block: tuple) -> tuple[np.ndarray, ...]:
        ids, mults, vectors, points = block
        x = np.frombuffer(vectors, "<f8").reshape(len(ids) // 8, -1)
        return np.frombuffer(ids, "<i8"), np.frombuffer(mults, "<i8"), unit(x), np.frombuffer(points).reshape(-1, DIMS)

    ids_a, mults_a, x_a, p_a = load(a)
    if b is None:
        ids, mults = ids_a, mults_a
        u, v = join_blocks(x_a, p_a, x_a, p_a, cosine, eps, True)
    else:
        ids_b, mults_b, x_b, p_b = load(b)
        ids, mults = np.concatenate([ids_a, ids_b]), np.concatenate([mults_a, mults_b])
        u, v = join_blocks(x_a, p_a, x_b, p_b, cosine, eps, False)
        v = v + len(ids_a)
    n = np.bincount(u, mults[v], len(ids)) + np.bincount(v, mults[u], len(ids))
    low = ids.copy()
    while True:
        was = low.copy()
        m = np.minimum(low[u], low[v])
        np.minimum.at(low, u, m)
        np.minimum.at(low, v, m)
        if (low == was).all():
            break
    on = n > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(n[on].astype(np.int64)), pa.array(low[on])], names=["rep", "n", "low"])


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Vectors link within a label at ``cosine`` or more, in double precision.  Equal vectors of a label
    are joined as one with its count; a pair of blocks returns the counts of its vectors and a forest of its links, never
    all pairs.  Null vec_ids and labels, null, empty or zero vectors and vectors with null or non-finite components link with nothing, nor do
    vectors of unlike lengths; repeated rows are vectors of their own; no rows give none; other columns are ignored.  Vectors
    are equal if two 64-bit hashes of them are.
    """
    scratch = scratch or Scratch(spark, "ego")
    eps = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    emb = F.transform("embedding", lambda v: v.cast("double"))
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), emb.alias("embedding"), F.col("label").cast("string").alias("label"),
    )
    base = base.select("*", *(F.xxhash64(F.lit(i), "embedding").alias(f"h{i}") for i in (1, 2)))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)
    base = base.withColumn("label", F.when(usable, F.col("label")))  # a null label links with nothing
    good = base.where("label is not null")
    key = ["label", "h1", "h2"]
    grouped = good.groupBy(*key, "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    groups = scratch.save(grouped.select("rep", "mult", "label", "embedding", "h1", "h2"), "reps")
    reps = groups.select("rep", "mult", "label", "embedding")
    bases = _basis(reps.orderBy(F.xxhash64("rep")).limit(SAMPLE))
    blocks = scratch.save(_blocks(reps, eps, bases), "blocks")
    wide = (blocks.agg(F.max("k")).first()[0] or 0) + 1
    blocks = blocks.withColumn("id", F.col("part") * wide + F.col("k"))
    near = near_blocks(blocks, eps, scratch)
    held = ("ids", "mults", "vectors", "points")
    load = lambda s: blocks.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in held))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows(batch, *(f"{c}_{s}" for s in "ab" for c in held)):
                yield _found(r[:4], r[4:], cosine, eps)

    def join_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows(batch, *held):
                yield _found(r, None, cosine, eps)

    kind = "rep long, n long, low long"
    across = near.join(load("a"), "a").join(load("b"), "b").drop("a", "b").mapInArrow(lean(join), kind)
    found = scratch.save(blocks.select(*held).mapInArrow(lean(join_own), kind).unionByName(across), "found")
    comp = components(
        found.select(F.col("rep").alias("a"), F.col("low").alias("b")), scratch,
    ).withColumnsRenamed({"id": "rep", "component": "comp"})
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    links = (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")
    per = groups.select("rep", "mult", *key).join(counts, "rep", "left").join(comp, "rep", "left")
    per = scratch.save(per.select(*key, "rep", links, F.coalesce("comp", "rep").alias("component_id")), "links")
    linked = base.select("vec_id", *key).join(per, key, "left")
    out = linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
