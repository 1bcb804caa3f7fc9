"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: a shard is a run of about ``SHARD_WORDS`` words of
whole documents, and a row (shard, term, n, positions) is the posting list of one
term in it.  A query window's lists are intersected within each shard, shifted by
the term's place in the window, from the term that is rarest over all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, rows

SHARD_WORDS = 1_000_000
#: Query words that one broadcast may hold; more are searched in as many blocks.
BLOCK_WORDS = 500_000
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOCS = b""  # the term of a shard's row that lists its documents

INDEX = "shard long, term binary, n long, positions binary"
FOUND = "shard long, ordinal long, doc_id long, digest binary, n_words long, spans binary, items array<string>, near array<string>"


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters a-z (A-Z made small) and non-ASCII characters, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def digest_of(text: str) -> Column:
    """The 128 bits by which a document's text is known, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """Posting lists of ``docs`` (doc_id, text); with a vocabulary, of its terms alone.

    Positions count the words of a shard, with a gap of one between documents, as
    little-endian u4 differences.  The row of the empty term lists a shard's documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: i for i, t in enumerate(sorted(shared.value))} if shared else None
        part, k = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        digests: list[bytes] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        n = 0
        local: dict[bytes, int] = dict(wanted) if wanted is not None else {}

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, digests, lengths, held, n, k, local
            ids = np.concatenate(held)
            places = np.nonzero(ids >= 0)[0]
            order = places[np.argsort(ids[places], kind="stable")]
            terms, first = np.unique(ids[order], return_index=True)
            names = list(local)
            heads = [_DOCS] + [names[t] for t in terms]
            ends = np.append(first[1:], len(order))[: len(first)]
            own = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array(lengths, "<u4")]
            listing = b"".join([*(x.tobytes() for x in own), *digests])
            lists = [listing] + [np.diff(order[a:b], prepend=0).astype("<u4").tobytes() for a, b in zip(first, ends, strict=True)]
            counts = [len(doc_ids)] + [int(b - a) for a, b in zip(first, ends, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(heads), part * 1_000_000 + k)), pa.array(heads, pa.binary()), pa.array(counts, pa.int64()),
                    pa.array(lists, pa.binary()),
                ],
                names=["shard", "term", "n", "positions"],
            )
            doc_ids, digests, lengths, held, n, k = [], [], [], [], 0, k + 1
            if wanted is None:
                local = {}
            return out

        for batch in batches:
            for doc_id, text, digest in rows(batch, "doc_id", "text", "digest"):
                w = words(text)
                if wanted is None:
                    for x in w:
                        local.setdefault(x, len(local))
                ids = np.full(len(w) + 1, -1, np.int64)
                ids[:-1] = np.fromiter((local.get(x, -1) for x in w), np.int64, len(w))
                doc_ids.append(doc_id)
                digests.append(digest)
                lengths.append(len(w))
                held.append(ids)
                n += len(w) + 1
                if n >= SHARD_WORDS:
                    yield close()
        if doc_ids:
            yield close()

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", digest_of("text").alias("digest"),
    ).mapInArrow(lean(build), INDEX)


def windows(items: list[tuple[str, list[bytes]]], size: int) -> dict[tuple[bytes, ...], list[str]]:
    """window -> the items that have it; an item of fewer words, but not none, is one window."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, w in items:
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


class Postings:
    """One shard's lists, ready for intersection: sorted keys of term number and position."""

    def __init__(self, names: list[bytes], lists: list[bytes], numbers: dict[bytes, int]):
        self.at: dict[int, np.ndarray] = {}
        for name, blob in zip(names, lists, strict=True):
            if name == _DOCS:
                n = len(blob) // 29
                self.doc_ids, self.nulls = np.frombuffer(blob, "<i8", n), np.frombuffer(blob, "u1", n, 8 * n)
                self.lengths = np.frombuffer(blob, "<u4", n, 9 * n).astype(np.int64)
                self.digests = [blob[13 * n + 16 * i : 13 * n + 16 * i + 16] for i in range(n)]
            elif name in numbers:
                self.at[numbers[name]] = np.cumsum(np.frombuffer(blob, "<u4"), dtype=np.int64)
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.keys = np.concatenate([(np.int64(t) << 32) + self.at[t] for t in sorted(self.at)] or [np.empty(0, np.int64)])

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term stands at each place."""
        if not len(self.keys):
            return np.zeros(len(place), bool)
        key = (term << 32) + place
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[i] == key) & (place >= 0)

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term stands within ``slop`` words of each place."""
        if not len(self.keys):
            return np.zeros(len(place), bool)
        low = (term << 32) + np.maximum(place - slop, 0)
        i = np.searchsorted(self.keys, low)
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= (term << 32) + np.maximum(place + slop, 0))


def search(index: DataFrame, queries: dict[tuple[bytes, ...], list[str]], slop: int = 3, near_terms: int = 3) -> DataFrame:
    """Exact and proximity matches of the windows in each shard: a row for each document, matched or not.

    spans: (start, end) pairs, u4, of exact phrase matches within the document;
    items: those with an exact match; near: those with a window whose ``near_terms`` rarest terms
    stand within ``slop`` words of their places.
    """
    spark = index.sparkSession
    vocabulary = {t for w in queries for t in w}
    known = spark.sparkContext.broadcast(vocabulary)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([t in known.value or t == _DOCS for t in b.column(1).to_pylist()], pa.bool_()))

    index = index.mapInArrow(lean(asked), INDEX)
    total = {
        bytes(r[0]): r[1] for r in index.where(F.length("term") > 0).groupBy("term").agg(F.sum("n")).collect()
    }  # at most a row for each query term
    numbers = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (total.get(t, 0), t)))}  # the rarest first
    found = [(w, items) for w, items in queries.items() if all(total.get(t) for t in w)]
    close = [(w, items) for w, items in queries.items() if all(total.get(t) for t in sorted(set(w), key=numbers.get)[:near_terms])]
    width = max([len(w) for w, _ in found + close], default=1)

    def plan(chosen: list, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and their offsets, rarest first, padded with -1."""
        terms, offsets = np.full((len(chosen), depth), -1, np.int64), np.zeros((len(chosen), depth), np.int64)
        for i, (w, _) in enumerate(chosen):
            order = sorted(range(len(w)), key=lambda j: (numbers[w[j]], j))[:depth]
            terms[i, : len(order)], offsets[i, : len(order)] = [numbers[w[j]] for j in order], order
        return terms, offsets

    sent = spark.sparkContext.broadcast(
        (numbers, [x for _, x in found], [len(w) for w, _ in found], plan(found, width), [x for _, x in close], plan(close, near_terms))
    )

    def look(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, items, sizes, (terms, offsets), near_items, (near_t, near_o) = sent.value
        p = Postings([bytes(t) for t in pdf["term"]], [bytes(x) for x in pdf["positions"]], numbers)
        n = len(p.lengths)

        def begin(terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lists = [p.at.get(t) for t in terms[:, 0]] if len(terms) else []
            got = [i for i, x in enumerate(lists) if x is not None]
            if not got:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            return np.repeat(np.array(got), [len(lists[i]) for i in got]), np.concatenate([lists[i] - offsets[i, 0] for i in got])

        which, start = begin(terms, offsets)
        for j in range(1, terms.shape[1]):
            t = terms[which, j]
            keep = (t < 0) | p.has(t, start + offsets[which, j])
            which, start = which[keep], start[keep]
        keep = start >= 0
        which, start = which[keep], start[keep]
        doc = np.searchsorted(p.starts, start, side="right") - 1
        near_w, near_s = begin(near_t, near_o)
        for j in range(1, near_t.shape[1]):
            t = near_t[near_w, j]
            keep = (t < 0) | p.near(t, near_s + near_o[near_w, j], slop)
            near_w, near_s = near_w[keep], near_s[keep]
        near_doc = np.searchsorted(p.starts, np.maximum(near_s, 0), side="right") - 1
        spans: list[bytes] = [b""] * n
        by_item: list[set] = [set() for _ in range(n)]
        near: list[set] = [set() for _ in range(n)]
        order = np.argsort(doc, kind="stable")
        doc, which, start = doc[order], which[order], start[order]
        hit, first = np.unique(doc, return_index=True)
        for d, a, b in zip(hit, first, np.append(first[1:], len(doc))[: len(hit)], strict=True):
            own = start[a:b] - p.starts[d]
            spans[d] = np.stack([own, own + np.array(sizes)[which[a:b]]], 1).astype("<u4").tobytes()
            by_item[d].update(x for w in np.unique(which[a:b]) for x in items[w])
        for d, w in {*zip(near_doc.tolist(), near_w.tolist())}:
            near[d].update(near_items[w])
        doc_ids = pd.array([None if z else int(x) for x, z in zip(p.doc_ids, p.nulls, strict=True)], dtype="Int64")
        return pd.DataFrame({
            "shard": key[0], "ordinal": np.arange(n), "doc_id": doc_ids, "digest": p.digests, "n_words": p.lengths, "spans": spans,
            "items": [sorted(x) for x in by_item], "near": [sorted(x) for x in near],
        })

    return index.groupBy("shard").applyInPandas(look, FOUND)


def matches(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 3, scratch: Scratch | None = None,
) -> DataFrame:
    """Contamination of every row of ``docs`` (doc_id, text) by ``benchmark`` (item_id, text).

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, near, digest); digest is
    :func:`digest_of` the text, for callers whose ids may be null or repeat.
    Null and empty texts have no words and no hits; null item_ids are read as the text "null"; items of
    equal id count once; repeated rows stay rows of their own; an empty benchmark hits nothing;
    no documents give no rows.  Other columns are ignored.

    The benchmark is the stated query set.  Up to ``BLOCK_WORDS`` of its words are
    held and broadcast at once, and the index has their terms alone; a larger one is searched block by block over
    an index of all terms, and the blocks' matches meet by document.
    """
    scratch = scratch or Scratch(spark, "decontam")
    asked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null")
    n_words = asked.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0] // 2 + 1  # no text has more words than half its characters
    n_blocks = -(-n_words // BLOCK_WORDS)
    blocks = [asked] if n_blocks == 1 else [asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == i) for i in range(n_blocks)]
    read = lambda df: windows([(r[0], words(r[1])) for r in df.toLocalIterator()], size)
    first = read(blocks[0])
    vocabulary = {t for w in first for t in w} if n_blocks == 1 else None
    index = scratch.save(build_index(docs, vocabulary), "index")
    found = search(index, first, slop)
    if n_blocks > 1:
        for b in blocks[1:]:
            found = found.unionByName(search(index, read(b), slop))
        one = [F.first(c).alias(c) for c in ("doc_id", "digest", "n_words")]
        found = found.groupBy("shard", "ordinal").agg(
            *one, F.collect_list("spans").alias("many"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near")),
        )
        joined = F.expr("aggregate(many, cast('' as binary), (a, x) -> concat(a, x))").alias("spans")
        found = found.select("doc_id", "digest", "n_words", joined, "items", "near")

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "near", "digest"]
    kinds = [
        pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.string()),
        pa.binary(),
    ]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, n, spans, items, near, digest in rows(batch, "doc_id", "n_words", "spans", "items", "near", "digest"):
                pairs, items = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64), sorted(set(items))
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1], -1)
                hit = int((np.cumsum(edge)[:n] > 0).sum())
                own = (
                    doc_id, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, items, spans,
                    sorted(set(near)), digest,
                )
                for c, v in zip(out, own, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans binary, near array<string>, digest binary"
    return found.mapInArrow(lean(finish), schema)
