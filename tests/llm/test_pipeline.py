"""The stages together on a small planted corpus, and the queries with SQL."""

import os
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_each_stage_decides(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        assert 0 < kept.count() <= docs.count()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        if i != 2:
            assert kept.exceptAll(docs).count() == 0
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_a_repeated_row_stays_once(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, text), (2, None), (2, None), (None, "some text"), (None, "some text"), (3, "another short text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    corpus_pipeline.drop_near_duplicates(spark, docs, SF).write.parquet(f"{tmp_path}/near")
    got = spark.read.parquet(f"{tmp_path}/near")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows[2:]))
    cut = corpus_pipeline.cut_repeated_passages(spark, got, SF)
    assert [r.text for r in cut.where("doc_id = 1").collect()] == [text]


RNG = np.random.default_rng(51)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(3, 9))) for _ in range(2000)]
CLASH = ", 'mine' AS kept, 1 AS spans, 2 AS n_words, 3 AS n_removed, 'x' AS kept_sha256, 4 AS class_id, 5 AS digest, 6 AS score, 7 AS d, 8 AS `a b`, 9 AS items"


def words(n):
    return list(RNG.choice(WORDS, n))


def stage(spark, name, rows, tmp_path):
    """What a stage makes of (doc_id, text) rows beside columns of clashing names; these must come back as they were."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr(
        "*", *[c.strip() for c in CLASH[2:].split(", ")],
    )
    dict(corpus_pipeline.STAGES)[name](spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
    out = spark.read.parquet(f"{tmp_path}/{name}")
    assert out.columns == docs.columns
    assert out.select(docs.columns[2:]).distinct().collect() in ([], docs.select(docs.columns[2:]).distinct().collect())
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


LOOSE = [(None, None), (50, None), (51, ""), (52, " \n ")]


def test_near_duplicate_stage(spark, tmp_path):
    a, b, long = words(200), words(150), words(20_000)
    near = a[:100] + ["changed"] + a[101:]
    rows = [(3, a), (9, near), (4, a), (1, b), (7, long), (8, long[:-5]), (6, words(12)), (3, a), (None, a)]
    rows = [(i, " ".join(w)) for i, w in rows] + LOOSE + LOOSE[:2]
    kept = [rows[0], rows[3], rows[4], rows[6], rows[8]] + LOOSE + LOOSE[:2]
    assert stage(spark, "near_duplicates", rows, tmp_path) == sorted(kept, key=repr)


def test_passage_stage(spark, tmp_path):
    shared, own = words(60), [words(40) for _ in range(6)]
    twice = words(50)
    rows = [
        (1, own[0] + shared + own[1]), (2, own[2] + shared[:34] + own[3]), (None, own[4] + shared), (4, own[5]), (4, own[5][:34]),
        (5, twice), (5, twice),
    ]
    want = [(1, own[0] + own[1]), (2, own[2] + shared[:34] + own[3]), (None, own[4]), (4, own[5]), (4, own[5][:34]), (5, []), (5, [])]
    text = lambda rs: [(i, " ".join(w)) for i, w in rs]
    assert stage(spark, "repeated_passages", text(rows) + LOOSE, tmp_path) == sorted(text(want) + LOOSE, key=repr)


def test_contamination_stage(spark, tmp_path):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    window = " ".join(item.split()[:10])
    clean = [(1, " ".join(words(80))), (None, " ".join(words(30))), (2, " ".join(item.split()[:9])), (3, " ".join(words(30_000)))]
    bad = [(None, window.upper()), (1, "before " + window + " after"), (5, clean[3][1] + " " + window), (5, item)]
    assert stage(spark, "decontamination", clean + bad + LOOSE + LOOSE, tmp_path) == sorted(clean + LOOSE + LOOSE, key=repr)


def test_quality_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    got = stage(spark, "quality", rows + rows[:3] + [(None, rows[0][1])] + LOOSE, tmp_path)
    ids = {i for i, _ in got}
    assert len(good & ids) >= 0.95 * len(good & {i for i, _ in rows}) and len(bad & ids) <= 0.2 * len(bad)
    assert all(got.count(x) == 2 for x in rows[:3] if x[0] in ids)


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).collect() == [], name


def test_run(spark):
    """All documents that the four filters leave, cut as the third says, come out of the last stage whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect())
    got, whole = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset)), []
    for r in got:
        if r.start == 0:
            whole.append((r.doc_id, ()))
        whole[-1] = (r.doc_id, whole[-1][1] + tuple(np.frombuffer(r.ids, "<u2").tolist()))
    assert Counter(whole) == want
    assert all(sum(r.length for r in got if r.sequence_id == s) == 1024 for s in range(got[-1].sequence_id))
