"""The learned operators beside independent versions: plain counting and EM, a direct ridge solution, and held-out rows of the given tables."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langmix, omh, quality, queries

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RNG = np.random.default_rng(61)
ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnopö", "dd": "abklöuvz"}


def words(lang, n):
    return " ".join("".join(RNG.choice(list(ALPHABETS[lang]), RNG.integers(2, 7))) for _ in range(n))


def trigrams(text):
    c = " " + "".join(x if x.isalpha() else " " for x in text.lower()) + " "
    return Counter(c[i - 1 : i + 2] for i in range(1, len(c) - 1) if c[i] != " ")


class Plain:
    """The same model by dictionaries of trigrams, without hashing or batches."""

    def __init__(self, rows):
        self.counts = defaultdict(Counter)
        for text, lang in rows:
            if text is not None and lang is not None:
                self.counts[lang].update(trigrams(text))
        self.langs = sorted(self.counts)
        self.total = {k: sum(c.values()) + 0.5 * langmix.BUCKETS for k, c in self.counts.items()}

    def p(self, lang, gram):
        return (self.counts[lang][gram] + 0.5) / self.total[lang]

    def em(self, bag, langs):
        w, n, last = {k: 1 / len(langs) for k in langs}, sum(bag.values()), -math.inf
        for _ in range(40):
            mixed = {g: sum(w[k] * self.p(k, g) for k in langs) for g in bag}
            value = sum(c * math.log(mixed[g]) for g, c in bag.items())
            if value - last < 1e-6 * abs(value):
                break
            last = value
            w = {k: w[k] * sum(c * self.p(k, g) / mixed[g] for g, c in bag.items()) / n for k in langs}
        return w, value

    def predict(self, text, penalty=4.0):
        bag = trigrams(text or "")
        if not bag:
            return "und", 0.0, []
        w, _ = self.em(bag, self.langs)
        order = [k for k in sorted(self.langs, key=lambda k: (-w[k], k)) if w[k] > 0.01]
        chosen, own = order[:1], {order[0]: 1.0}
        value = sum(c * math.log(self.p(order[0], g)) for g, c in bag.items())
        for k in range(2, len(order) + 1):
            more, raised = self.em(bag, order[:k])
            if raised - value <= penalty * math.log(sum(bag.values()) + 1):
                break
            chosen, own, value = order[:k], more, raised
        best = sorted(chosen, key=lambda k: -own[k])
        return best[0], w[best[0]], best


def test_mixture_equals_plain_em(spark):
    langs = list(ALPHABETS)
    train = [(words(langs[i % 4], 60), langs[i % 4]) for i in range(80)] + [
        (None, "aa"), ("text", None), ("", "bb"), (words("aa", 60), "aa"),
    ]
    asked = [words(langs[i % 4], int(RNG.integers(1, 40))) for i in range(60)]
    asked += [
        words("aa", 60) + "\n" + words("cc", 40) + "!", words("bb", 30) + " " + words("dd", 30), None, "", "12 ?!\t", "Ä", "a",
        words("bb", 30_000), asked[0], asked[0],
    ]
    rows = spark.createDataFrame(train, "text string, lang string").repartition(3)
    model = langmix.train(rows)
    docs = spark.createDataFrame(
        list(enumerate(asked)), "doc_id long, text string",
    ).repartition(4).withColumn("lang", F.lit("cc")).withColumn("score", F.lit(7)).withColumn("langs", F.lit("x"))
    got = {r.doc_id: r for r in langmix.predict(spark, docs, model).collect()}
    plain = Plain(train)
    assert model[0] == plain.langs and len(got) == len(asked)
    for i, text in enumerate(asked):
        lang, share, chosen = plain.predict(text)
        assert (got[i].lang_pred, got[i].langs) == (lang, chosen), text
        assert abs(got[i].score - share) < 0.02  # hashed buckets may join two trigrams
    assert got[60].langs == ["aa", "cc"] and sorted(got[61].langs) == ["bb", "dd"]
    assert got[len(asked) - 1].score == got[len(asked) - 2].score == got[0].score
    assert langmix.predict(spark, docs.limit(0), model).collect() == []


def test_mixture_ties_go_to_the_first_name(spark):
    rows = spark.createDataFrame([("xyz xyz", "b"), ("xyz xyz", "a")], "text string, lang string")
    got = langmix.predict(spark, spark.createDataFrame([(1, "xyz")], "doc_id long, text string"), langmix.train(rows)).first()
    assert (got.lang_pred, got.langs) == ("a", ["a"]) and abs(got.score - 0.5) < 1e-6


@given
def test_held_out_languages(spark):
    found = queries.op3_language_mixture(spark, SF).withColumnRenamed("doc_id", "id")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = found.join(docs, found.id == docs.doc_id).where("held_out and lang is not null and text is not null and lang_pred <> 'und'").select("lang", "lang_pred", "id").collect()
    assert {zlib.crc32(str(r.id).encode()) % 4 for r in rows} == {2}
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def direct(texts, labels):
    """Scores of all rows at once by the normal equations, with the operator's features."""
    x = np.array([quality.statistics(t) for t in texts], np.float64)
    rng = np.random.default_rng(7)
    m = quality.Model(
        x.mean(0), np.maximum(np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 0)), 1e-3),
        rng.normal(size=(quality.WIDTH, quality.FEATURES)) * np.sqrt(2 * quality.GAMMA), rng.uniform(0, 2 * np.pi, quality.FEATURES),
    )
    z = m.lift(x)
    eye = quality.RIDGE * np.eye(z.shape[1])
    y = np.array(labels, float)
    weights = np.linalg.solve(z.T @ z + eye, z.T @ y)
    loo = []
    for i in range(0, len(y), 37):  # a fit without the row, for some rows
        rest = np.arange(len(y)) != i
        loo.append((i, z[i] @ np.linalg.solve(z[rest].T @ z[rest] + eye, z[rest].T @ y[rest])))
    return m, z, weights, loo


def test_ridge_equals_a_direct_solution(spark):
    texts = [
        words("aa", int(RNG.integers(5, 80))) + "." * int(RNG.integers(0, 3)) for _ in range(150)
    ] + [words("bb", int(RNG.integers(5, 80))).upper() + "!!$" for _ in range(110)]
    texts += [None, "", words("aa", 40_000), texts[0], texts[0]]
    labels = [1] * 150 + [0] * 110 + [0, 0, 1, 1, 0]
    stats = quality.describe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    own = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    train = stats.join(own, "doc_id").select("stats", "label")
    model = quality.fit(train)
    m, z, weights, loo = direct(texts, labels)
    assert np.abs(model.mean - m.mean).max() < 1e-6 and np.abs(model.scale - m.scale).max() < 1e-4
    assert np.abs(model.weights - weights).max() < 1e-4
    inverse = np.linalg.inv(z.T @ z + quality.RIDGE * np.eye(z.shape[1]))
    for i, want in loo:  # the shortcut that the calibration uses
        h = z[i] @ inverse @ z[i]
        assert abs((z[i] @ weights - h * labels[i]) / (1 - h) - want) < 1e-6
    x, steps = model.steps
    assert (np.diff(steps) >= -1e-12).all() and steps.min() >= 0 and steps.max() <= 1


def test_quality_of_awkward_rows(spark):
    good, bad = [words("aa", 50).capitalize() + "." for _ in range(80)], [words("bb", 50) + " $$$" for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [
        (3, good[3]), (3, good[3]), (500, words("aa", 30_000)), (501, None), (502, ""), (None, good[0]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'x' AS quality", "1 AS score", "2 AS label", "'s' AS stats", "true AS held_out",
    )
    labels = spark.createDataFrame(
        [(i, int(i < 80)) for i in range(160)], "doc_id long, quality int",
    ).selectExpr("*", "'t' AS text", "9 AS stats", "1 AS label")
    got = quality.quality(spark, docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
    right = [r.predicted == int(r.doc_id < 80) for r in got if r.doc_id is not None and r.doc_id < 160 and r.held_out]
    assert len(right) > 20 and all(right)
    kept = quality.accept(spark, docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)


@given
def test_held_out_quality(spark):
    found = queries.op5_quality(spark, SF)
    rows = found.join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id",
    ).where("held_out and quality is not null").select("doc_id", "predicted", "quality").collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows} == {0}
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


@given
def test_recall_of_near_duplicates(spark):
    """All pairs of the documents that share enough shingles, aligned one by one: 0.9 of them at least are in one class, and no class joins more."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.doc_id is not None and r.text]
    hs = [omh.labelled(r.text) for r in docs]
    where = defaultdict(list)
    for i, h in enumerate(hs):
        for x in h.tolist():
            where[x].append(i)
    shared = Counter()
    for own in where.values():
        for k, i in enumerate(own):
            shared.update((i, j) for j in own[k + 1 :])
    links = [(i, j) for (i, j), n in shared.items() if n * 1.8 >= 0.8 * (len(hs[i]) + len(hs[j])) - 1e-6 and omh.similarity(hs[i], hs[j]) >= 0.8]
    got = {r.doc_id: r.class_id for r in queries.op1_order_minhash(spark, SF).collect()}
    unlike = [(i, j) for i, j in links if docs[i].text != docs[j].text]
    assert len(links) > 50 and len(unlike) > 5
    assert sum(got[docs[i].doc_id] == got[docs[j].doc_id] for i, j in links) >= 0.9 * len(links)
    assert sum(got[docs[i].doc_id] == got[docs[j].doc_id] for i, j in unlike) >= 0.9 * len(unlike)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in links:
        parent[find(i)] = find(j)
    same = defaultdict(set)
    for i, r in enumerate(docs):
        same[got[r.doc_id]].add(find(i))
    assert all(len(roots) == 1 for roots in same.values())
