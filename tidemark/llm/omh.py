"""Near-duplicate classes by Order MinHash (Marcais et al., 2019).

A sketch keeps the ``TUPLE`` smallest hashes of a text's five-word shingles, each labelled with
how often it occurred before, in the order of the text.  Equal sketches make candidates; a banded alignment of the
labelled shingle sequences verifies them.  The similarity is the number of aligned shingles over the number of all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, mix64, rows, shingle_hashes, word_hash
from tidemark.llm.graph import components

SHINGLE, TUPLE, SKETCHES, SIMILARITY = 5, 3, 16, 0.8
#: A bucket with several classes is compared in blocks of about so many texts, every block with every other.
BLOCK = 512
#: A shingle of at most so many texts of a block is counted pair by pair, one of more by a matrix product of so many columns.
RARE, COLUMNS = 8, 2048


def labelled(text: str) -> np.ndarray:
    """Hashes of the text's shingles in order, each with its number among equal ones."""
    h = shingle_hashes(word_hash().of(text.split()), SHINGLE)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    if first.all():
        return h
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    number = np.empty(len(s), np.uint64)
    number[order] = np.arange(len(s)) - start
    return mix64(h + number * np.uint64(0xD1B54A32D192ED03)) if len(h) else h


def sketches(h: np.ndarray, count: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """One 64-bit key for each sketch: a hash of its smallest labelled shingles in text order."""
    out = np.empty(count, np.uint64)
    for j in range(count):
        x = (h ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        at = np.sort(np.argpartition(x, size - 1)[:size]) if len(x) > size else np.arange(len(x))
        key = j + 1
        for v in h[at].tolist():
            key = (key * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
        out[j] = key
    return mix64(out)


def distance(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> tuple[int, bool]:
    """Shingles of a and b that the best alignment leaves out, and whether the pair reaches ``least``.

    An alignment that reaches ``least`` leaves at most ``spare`` shingles out, so it stays within that band of the diagonal;
    outside it the number is a lower bound.  Labelled shingles are unique in a sequence: the best alignment is the longest rising
    run of places in b over those of a, and the number left out is a metric.
    """
    total = len(a) + len(b)
    spare = int(total * (1 - least) / (1 + least) + 1e-9)
    if not len(a) or not len(b):
        return total, False
    if abs(len(a) - len(b)) > spare:
        return abs(len(a) - len(b)), False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= spare
    if total - 2 * int(near.sum()) > spare:
        return total - 2 * len(i), False
    ends: list[int] = []
    for place in j[near][np.argsort(i[near])].tolist():
        k = bisect_left(ends, place)
        if k == len(ends):
            ends.append(place)
        else:
            ends[k] = place
    left = total - 2 * len(ends)
    return (left, True) if left <= spare else (spare + 1, False)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles; 0 where it is under ``least``."""
    left, good = distance(a, b, least)
    total = len(a) + len(b)
    return (total - left) / (total + left) if good else 0.0


def digest_of(text: str) -> Column:
    """The 128 bits by which equal texts are known."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, keys) of each document that has a text; keys is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for (text,) in rows(batch, "text"):
                h = labelled(text)
                keys.append(sketches(h).view(np.int64) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of("text").alias("digest"), "text")
    return own.where("doc_id is not null and text is not null").mapInArrow(lean(run), "doc_id long, digest binary, keys array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, d, n_a, n_b, ok): what the alignment of each pair leaves out (or less), their lengths in shingles, and whether they link."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for a, text_a, text_b in rows(batch, "a", "text_a", "text_b"):
                if a != last:
                    last, h = a, labelled(text_a)
                g = labelled(text_b)
                d, ok = distance(h, g, least)
                for c, v in zip(out, (d, len(h), len(g), ok), strict=True):
                    c.append(v)
            new = [pa.array(c, pa.bool_() if i == 3 else pa.int64()) for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["a", "b", "d", "n_a", "n_b", "ok"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(
        lean(run), "a long, b long, d long, n_a long, n_b long, ok boolean",
    )


def overlaps(hs: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each two of the texts share, exact above the diagonal."""
    n = len(hs)
    _, col, df = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(h) for h in hs])[np.argsort(col, kind="stable")]
    start = np.cumsum(df) - df
    out = np.zeros(n * n, np.float32)
    for k in range(2, RARE + 1):
        at = start[df == k]
        if len(at):
            who = owner[at[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            out += np.bincount((who[:, i] * n + who[:, j]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    many = np.flatnonzero(df > RARE)
    for c in range(0, len(many), COLUMNS):
        own = many[c : c + COLUMNS]
        dense = np.zeros((n, len(own)), np.float32)
        for k, (a, m) in enumerate(zip(start[own].tolist(), df[own].tolist(), strict=True)):
            dense[owner[a : a + m], k] = 1
        out += dense @ dense.T
    return out


def links(hs: list[np.ndarray], cls: list[int], side: list[int], least: float) -> Iterator[tuple[int, int]]:
    """Places of texts that link and join all texts which links of the block connect; where ``side`` has two values, only across them.

    Only texts of unlike classes are tried, and only where so many shingles are shared that their alignment can reach ``least``.
    """
    root = {c: c for c in cls}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sizes, kinds, sides = np.array([len(h) for h in hs]), np.array(cls), np.array(side)
    total = sizes[:, None] + sizes[None, :]
    good = total - 2 * overlaps(hs) <= np.floor(total * (1 - least) / (1 + least) + 1e-9)
    good &= kinds[:, None] != kinds[None, :]
    if len(set(side)) > 1:
        good &= sides[:, None] != sides[None, :]
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(good, 1))), strict=True):
        a, b = find(cls[i]), find(cls[j])
        if a != b and distance(hs[i], hs[j], least)[1]:
            root[max(a, b)] = min(a, b)
            yield i, j


def _finish(dealt: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links between unlike classes within each (bucket, lo, hi) of ``dealt``, which holds one block of a bucket or two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, []

        def found() -> pa.RecordBatch:
            ids, cls, side, hs = zip(*part, strict=True)
            pairs = list(links(list(hs), list(cls), list(side), least))
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for bucket, lo, hi, *own, text in rows(batch, "bucket", "lo", "hi", "doc_id", "cls", "block", "text"):
                if (bucket, lo, hi) != key:
                    if part:
                        yield found()
                    key, part = (bucket, lo, hi), []
                part.append((*own, labelled(text)))
        if part:
            yield found()

    own = dealt.join(texts, "doc_id").select("bucket", "lo", "hi", "doc_id", "cls", "block", "text")
    return own.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(lean(run), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, least: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, class_id, digest, kept) for each row of ``docs`` (doc_id, text); class_id is the smallest doc_id linked to it.

    Equal texts form one class, whose smallest doc_id stands for it.  In each bucket of equal sketches
    the smallest text, the pivot, is compared with the others, and classes are formed.  Where a bucket's other texts are then not all of
    one class, all of them that are of unlike classes are compared, in blocks of about ``BLOCK`` texts that are dealt over the tasks;
    of the pivot's own class only those texts go on that can link with one outside by the triangle inequality of the alignment distance.
    So all pairs that share a sketch are decided on: none is cut off.  Pairs are counted inside the tasks and are not written as rows.
    Texts with fewer than five words have one shingle of all their words; null texts, texts without words and
    null doc_ids are their own class (equal non-null texts share one); order of rows and ties do not matter; repeated rows
    give repeated rows, and rows of one doc_id with unlike texts are told apart by ``digest``.  Other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "omh")
    table = scratch.save(sketch_table(docs), "sketches")
    groups = table.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = scratch.save(table.select("doc_id", "digest").distinct().join(groups, "digest").select("doc_id", "digest", "rep"), "members")
    reps = table.join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = reps.where(F.size("keys") > 0)
    level = scratch.save(reps.select("doc_id", F.posexplode("keys").alias("at", "bucket")), "level0")
    full = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("pivot")).where("n > 1")
    level = scratch.save(level.join(full, "bucket").select("doc_id", "at", "bucket", "pivot", "n"), "level1")
    wanted = level.select("doc_id").distinct()
    keys = scratch.save(table.select("doc_id", "keys").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "keys")
    scratch.drop("level0", "sketches")
    texts = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text",
        ).where("text is not null").join(keys.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]),
        "texts",
    )
    share = (1 - least) / (1 + least)
    pairs = level.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    done = scratch.save(_verify(pairs, texts, least), "pairs")
    found = components(done.where("ok"), scratch, "cc1_")
    # What goes on: all outside the pivot's class, and of its class what may link with those
    own = level.where("doc_id <> pivot").drop("n").join(
        found.select(F.col("id").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left",
    ).join(found.select(F.col("id").alias("pivot"), F.col("component").alias("pc")), "pivot", "left")
    own = own.join(
        done.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), "d", F.col("n_b").alias("n"), "ok"), ["pivot", "doc_id"], "left",
    )
    own = own.select(
        "doc_id", "bucket", F.coalesce("c", "doc_id").alias("cls"),
        (F.coalesce("c", "doc_id") != F.coalesce("pc", "pivot")).alias("outside"), "d", "n", "ok",
    )
    inner = own.where("outside").groupBy("bucket").agg(F.min(F.col("d") - share * F.col("n")).alias("edge"))
    # d is exact where the pair links; elsewhere it is a lower bound, which rules out nothing inside the pivot's class
    rest = own.join(inner, "bucket").where(
        F.expr("outside or not coalesce(ok, false)") | (F.col("d") + share * F.col("n") >= F.col("edge") - 1e-6)
    )
    rest = scratch.save(rest.select("doc_id", "bucket", "cls"), "rest")
    scratch.drop("level1")
    mark = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    full = rest.groupBy("bucket").agg(F.min("cls").alias("l"), F.max("cls").alias("h"), F.count(F.lit(1)).alias("n"), *mark).where("l <> h")
    full = full.groupBy("l", "h", "n", "mark0", "mark1").agg(F.min("bucket").alias("bucket"))  # of buckets with the same texts, one
    full = full.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "cls", "block",
    )
    more = scratch.save(_finish(dealt, texts, least), "more")
    scratch.drop("rest")
    if more.limit(1).count():
        found = components(done.where("ok").select("a", "b").unionByName(more), scratch, "cc2_")
    classes = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "digest", F.coalesce("component", "rep").alias("class_id"),
    )
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest_of("text").alias("digest"),
    ).join(classes, ["doc_id", "digest"], "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "digest")
    scratch.drop("texts", "keys")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
