"""Removal of repeated passages with an FM-index for each shard.

Windows of ``window`` words that are equal have equal minimisers (the least hash of their
``GRAM``-word grams), so documents are cut into segments of consecutive windows with one
minimiser, and a segment is dealt to the shard of its minimiser: all places of a window's words are in one shard, and each
window is in one segment.  A shard builds a compressed FM-index of its segments, a Huffman-shaped wavelet tree over the
Burrows-Wheeler transform with rank directories and without the text, and streams the distinct segments of the documents dealt to it
through it: backward search finds how far to the left a match with a second place reaches.  Work grows in proportion to the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean, mix64, rows, shingle_hashes, word_hash

WINDOW, GRAM = 35, 8
#: A minimiser with more distinct segments than this is dealt window by window, by all of a window's words.
HOT = 1000
#: Bits in the first half of the key of a window of a frequent minimiser; the second half has 64 more.
LOW_BITS = 64
SHARD_WORDS = 500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks (space and 09 to 0D), unchanged, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def segments(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(minimiser, hash of all words, first window, number of windows) of each segment of a document's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    g = shingle_hashes(h, min(GRAM, window))
    span = len(g) - n + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    count = np.diff(np.append(first, n))
    powers = np.full(len(h), _BASE, np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers), dtype=np.uint64)])
    powers[1:] = _INVERSE
    own = (sums[first + count + window - 1] - sums[first]) * np.cumprod(powers)[first] + count.astype(np.uint64)
    return g[at[first]], mix64(own), first, count


class RankBits:
    """A bit vector with ranks: packed words, a 16-bit count for each word and a 64-bit one for each 1,024 words."""

    WORDS = 1024

    def __init__(self, on: np.ndarray):
        self.packed = np.packbits(np.concatenate([on, np.zeros(-len(on) % 64 + 64, bool)]), bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)[:-1]])
        self.far = ones[:: self.WORDS].copy()
        self.near = (ones - self.far[np.arange(len(ones)) // self.WORDS]).astype(np.uint16)

    def ones(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.far[w >> 10] + self.near[w] + np.bitwise_count(self.packed[w] & mask)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code of the symbols with these counts; one symbol alone has one bit."""
    if len(counts) < 2:
        return np.ones(len(counts), np.int64)
    n = len(counts)
    leaves = np.argsort(counts, kind="stable").tolist()
    weight = counts.tolist() + [0] * (n - 1)
    parent = np.zeros(2 * n - 1, np.int64)
    i = j = 0  # the two queues: leaves by count, and inner nodes, which come in order of their counts
    for new in range(n, 2 * n - 1):
        for _ in range(2):
            if j == new - n or i < n and weight[leaves[i]] <= weight[n + j]:
                least, i = leaves[i], i + 1
            else:
                least, j = n + j, j + 1
            weight[new] += weight[least]
            parent[least] = new
    depth = np.zeros(2 * n - 1, np.int64)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


class WaveletTree:
    """A Huffman-shaped wavelet tree, which takes about the zero-order entropy of its sequence: one bit vector for each level."""

    def __init__(self, sequence: np.ndarray, counts: np.ndarray):
        self.length = code_lengths(counts)
        order = np.lexsort((np.arange(len(counts)), self.length))  # canonical: shorter codes first, and so the smaller prefixes
        self.length = self.length.astype(np.int32)
        self.code = np.zeros(len(counts), np.int32)  # a code of 32 bits takes millions of words
        code, last = -1, int(self.length[order[0]])
        for s, n in zip(order.tolist(), self.length[order].tolist(), strict=True):
            code, last = (code + 1) << (n - last), n
            self.code[s] = code
        self.levels: list[tuple[RankBits, int, np.ndarray, np.ndarray]] = []
        code, length = self.code[sequence], self.length[sequence]
        for level in range(int(self.length.max())):
            on = length > level
            code, length = code[on], length[on]
            prefix = code >> (length - level)
            node = prefix - prefix.min()
            if len(node) and node.max() < 1 << 16:
                node = node.astype(np.uint16)  # for which numpy has a radix sort
            by = np.argsort(node, kind="stable")  # nodes side by side, each in the order of the sequence
            code, length, prefix = code[by], length[by], prefix[by]
            bits = RankBits((code >> (length - level - 1)) & 1 == 1)
            least = np.int32(prefix[0])
            start = np.searchsorted(prefix, np.arange(least, prefix[-1] + 1)).astype(np.int64)
            self.levels.append((bits, least, start, bits.ones(start)))

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before its place in each of ``places``."""
        out = [np.empty(len(symbol), np.int64) for _ in places]
        on, code, length = np.arange(len(symbol)), self.code[symbol], self.length[symbol]
        at = [p.astype(np.int64) for p in places]
        for level, (bits, least, start, before) in enumerate(self.levels):
            more = length > level
            if not more.all():
                done = on[~more]
                for o, p in zip(out, at, strict=True):
                    o[done] = p[~more]
                on, code, length, at = on[more], code[more], length[more], [p[more] for p in at]
            shift = length - level
            node = (code >> shift) - least
            base, less, right = start[node], before[node], (code >> (shift - 1)) & 1 == 1
            for i, p in enumerate(at):
                ones = bits.ones(base + p) - less
                at[i] = np.where(right, ones, p - ones)
        for o, p in zip(out, at, strict=True):
            o[on] = p
        return out


class FMIndex:
    """Backward search over sequences of word numbers 0..sigma-1; holds no text, only its wavelet tree and counts."""

    def __init__(self, pieces: list[np.ndarray], sigma: int):
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int((lengths + 1).sum())
        text = np.empty(n, np.int64)
        ends = np.cumsum(lengths + 1) - 1
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = np.concatenate(pieces) + len(pieces) if pieces else []
        text[ends] = np.arange(len(pieces))  # separators differ, so no two suffixes are equal
        rank, k = text, 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (int(nxt.max()) + 1) + nxt
            order = np.argsort(key)
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank, k = new, 2 * k
            if int(rank.max()) == n - 1 or k >= n:
                break
        symbols = np.where(body, text - len(pieces) + 1, 0)  # 0: separator
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(symbols[order - 1], np.maximum(counts, 1))

    def step(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges with one more word to the left."""
        before = self.first[word + 1]
        lo, hi = self.tree.rank(word + 1, lo, hi)
        return before + lo, before + hi

    def reach(self, stream: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The least start, not under ``limit``, of a run of the stream's words up to ``end`` that occurs twice or more; end + 1 for none."""
        out = end + 1
        on = np.arange(len(end))
        at = end.copy()
        word = stream[at]
        lo, hi = self.first[word + 1], self.first[word + 2]
        while len(on):
            ok = hi - lo >= 2
            on, at, lo, hi = on[ok], at[ok], lo[ok], hi[ok]
            out[on] = at
            ok = at > limit[on]
            on, at, lo, hi = on[ok], at[ok] - 1, lo[ok], hi[ok]
            if len(on):
                lo, hi = self.step(stream[at], lo, hi)
        return out


def repeated(index: FMIndex, pieces: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last) intervals of windows of the streamed pieces that occur twice or more in the index.

    Searches all pieces side by side.  From the right end of a range of windows a match marks what it reaches; where there is none, the
    window at the left end is tried, and a miss rules out all windows that hold the unmatched run.
    """
    found: list[np.ndarray] = []
    sizes = np.array([len(p) for p in pieces], np.int64)
    base, stream, count = np.cumsum(sizes) - sizes, np.concatenate(pieces), sizes - window + 1
    todo = np.stack([np.arange(len(pieces)), np.zeros(len(pieces), np.int64), count - 1, np.ones(len(pieces), np.int64)])
    while todo.shape[1]:
        who, lo, hi, right = todo
        b = base[who]
        got = index.reach(stream, b + np.where(right == 1, hi, lo) + window - 1, b + lo) - b
        r = right == 1
        whole, part = r & (got <= hi), r & (got > hi) & (hi > lo)
        found.append(np.stack([who[whole], np.maximum(got, lo)[whole], hi[whole]]))
        nxt = [
            np.stack([who, lo, got - 1, np.ones_like(lo)])[:, whole & (got > lo)], np.stack([who, lo, hi - 1, np.zeros_like(lo)])[:, part],
        ]
        hit, miss = ~r & (got <= lo), ~r & (got > lo)
        found.append(np.stack([who[hit], lo[hit], lo[hit]]))
        nxt.append(np.stack([who, got, hi, np.zeros_like(lo)])[:, miss & (got <= hi)])
        mid = (lo + 1 + hi) // 2
        nxt.append(np.stack([who, lo + 1, mid, np.ones_like(lo)])[:, hit & (lo < hi)])
        nxt.append(np.stack([who, mid + 1, hi, np.ones_like(lo)])[:, hit & (mid < hi)])
        todo = np.concatenate(nxt, axis=1)
    a = np.concatenate(found, axis=1)
    return a[0], a[1], a[2]


def _shard(key: tuple, pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Intervals of repeated windows in the distinct segments of a shard; one that occurs more often stands in the index twice."""
    pdf = pdf.drop_duplicates(["mini", "seg", "alone"])  # repeated rows may have sent one more than once
    numbers: dict[bytes, int] = {}
    streamed = []
    for text in pdf["text"]:
        w = bytes(text).split(b" ")
        streamed.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int64, len(w)))
    again = [p for p, n in zip(streamed, pdf["copies"], strict=True) if n > 1]
    piece, lo, hi = repeated(FMIndex(streamed + again, len(numbers)), streamed, window)
    return pd.DataFrame(
        {
            "mini": pdf["mini"].to_numpy()[piece], "seg": pdf["seg"].to_numpy()[piece], "alone": pdf["alone"].to_numpy()[piece], "lo": lo,
            "hi": hi,
        }
    )


def passages(spark: SparkSession, docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_removed, kept_sha256, spans and kept: what stays of each whole text.

    A word is removed if a window of ``window`` words over it has a word sequence that also starts anywhere else in
    the table, in the same document too.  spans: (start, end) word intervals that are removed, i4 pairs; kept: the kept words joined by
    one space.  Null and empty texts have no words and texts under ``window`` words lose none, yet
    count as kept; repeated rows are places of their own, so all their windows repeat; no rows give none.
    Other columns pass unchanged, but for those named here.

    Equal segments are collapsed to one with a mark of its copies before the shuffle to the shards; rows equal in id and text add work in proportion to their number.  A minimiser with over HOT distinct segments is
    dealt by whole windows, equal ones collapsed as well, so that no shard grows with one frequent passage.
    """
    scratch = scratch or Scratch(spark, "fm")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("th")]
    keyed = docs.select("text", *key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for d, th, text in rows(batch, "d", "th", "text"):
                mini, seg, first, count = segments(word_hash().of(words(text)), window)
                for column, v in zip(
                    out, (mini.view(np.int64), seg.view(np.int64), np.full(len(mini), d), np.full(len(mini), th), first, count),
                    strict=True,
                ):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["mini", "seg", "d", "th", "first", "count"],
                )

    kind = "mini long, seg long, d long, th long, first long, count long"
    places = scratch.save(keyed.select("d", "th", "text").where("text is not null").mapInArrow(lean(cut), kind), "all")
    # Written, so that the join below reads two plain shuffles and a frequent minimiser can be split
    shared = scratch.save(places.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mini"), "shared")
    places = scratch.save(places.join(shared, "mini", "left_semi"), "places")
    scratch.drop("all", "shared")
    segs = scratch.save(
        places.groupBy("mini", "seg").agg(
            F.min(F.struct("d", "th", "first", "count")).alias("r"), F.least(F.count(F.lit(1)), F.lit(2)).alias("copies"),
        ),
        "segs",
    )
    hot = segs.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("mini", F.lit(True).alias("hot"))
    wanted = segs.join(hot, "mini", "left").select(
        "r.d", "r.th", F.struct("mini", "seg", "r.first", "r.count", "copies", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"),
    ).groupBy("d", "th").agg(F.collect_list("s").alias("segs"))

    low = (1 << LOW_BITS) - 1

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for text, own in rows(batch.slice(i, 200), "text", "segs"):
                    w = words(text)
                    for s in own:
                        a, n = s["first"], s["count"]
                        if not s["hot"]:
                            out.append((s["mini"], s["seg"], -1, 0, 0, s["copies"], b" ".join(w[a : a + n + window - 1])))
                            continue
                        for j in range(n):
                            t = b" ".join(w[a + j : a + j + window])
                            h = xxhash.xxh3_128_intdigest(t)
                            out.append((s["mini"], s["seg"], j, (h & low) - (1 << 63), (h >> 64) - (1 << 63), s["copies"], t))
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(cols)],
                    names=["mini", "seg", "j", "win", "win2", "copies", "text"],
                )

    texts = keyed.select("d", "th", "text").join(wanted, ["d", "th"])
    cutout = scratch.save(
        texts.mapInArrow(lean(slices), "mini long, seg long, j long, win long, win2 long, copies long, text binary"), "slices",
    )
    plain = cutout.where("j < 0").select("mini", "seg", "text", "copies", F.lit(0).cast("long").alias("alone"))
    split = cutout.where("j >= 0").groupBy("win", "win2").agg(F.first("text").alias("text"), F.least(F.sum("copies"), F.lit(2)).alias("copies")).select(
        F.col("win").alias("mini"), F.col("win2").alias("seg"), "text", "copies", F.lit(1).cast("long").alias("alone"),
    )
    size = cutout.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_shards = int(size // (SHARD_WORDS * 7)) + 1
    dealt = plain.unionByName(split).withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(n_shards)))
    hits = scratch.save(
        dealt.groupBy("shard").applyInPandas(
            lambda key, pdf: _shard(key, pdf, window), "mini long, seg long, alone long, lo long, hi long",
        ),
        "hits",
    )
    of_windows = hits.where("alone = 1").select(F.col("mini").alias("win"), F.col("seg").alias("win2")).distinct().join(
        cutout.where("j >= 0").select("win", "win2", "mini", "seg", "j"), ["win", "win2"],
    ).select("mini", "seg", F.col("j").alias("lo"), F.col("j").alias("hi"))
    runs_of = hits.where("alone = 0").drop("alone").unionByName(of_windows).groupBy("mini", "seg").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    spans = scratch.save(runs_of, "spans")  # written, so that a frequent segment can be split at the join
    moved = F.transform("runs", lambda r: F.struct((F.col("first") + r["lo"]).alias("a"), (F.col("first") + r["hi"] + window).alias("b")))
    per = places.join(spans, ["mini", "seg"]).select("d", "th", "first", moved.alias("runs"))
    per = per.groupBy("d", "th", "first").agg(F.first("runs").alias("runs"))  # equal rows have equal runs
    per = per.groupBy("d", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    per = scratch.save(per, "runs")
    scratch.drop("slices", "segs", "places", "hits", "spans")
    added = ["n_words", "n_removed", "kept_sha256", "spans", "kept"]
    left = [c for c in docs.columns if c.lower() not in added]
    ticked = [f"`{c}`" for c in left]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in rows(batch, "text", "__runs"):
                w = words(text)
                gone = np.zeros(len(w) + 1, np.int64)
                if runs:
                    np.add.at(gone, [r["a"] for r in runs], 1)
                    np.add.at(gone, [r["b"] for r in runs], -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if runs else w)
                out.append(
                    (
                        len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge.astype("<i4").tobytes(),
                        kept.decode("utf-8", "surrogatepass"),
                    )
                )
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in left), *new], names=[*left, *added])

    schema = ", ".join(
        [
            *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*ticked).schema.fields),
            "n_words long, n_removed long, kept_sha256 string, spans binary, kept string",
        ]
    )
    own = docs.select(*ticked, key[0].alias("__d"), key[1].alias("__th"))
    runs = per.withColumnsRenamed({"d": "__d", "th": "__th", "runs": "__runs"})
    return own.join(runs, ["__d", "__th"], "left").mapInArrow(lean(keep), schema)
