"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, as a written table, and decides on all of them.  A
stage's own scratch tables go when the next stage begins, since its result has been written by then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, fm, omh, pack, quality
from tidemark.llm.common import Scratch, table

VOCABULARY = "byte_bpe_50k.json"
_own: list[Scratch] = []


def _scratch(spark: SparkSession, label: str) -> Scratch:
    while _own:
        _own.pop().clear()
    _own.append(Scratch(spark, f"pipeline-{label}"))
    return _own[-1]


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty; repeated rows and ties fare alike; other columns, whatever their names, pass unseen; no rows give none.
    """
    return quality.accept(spark, docs, table(spark, sf_dir, "labels"), scratch=_scratch(spark, "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id.

    Of rows that are equal in id and text one stays; rows with a null id or text all stay; empty texts are copies of each other;
    other columns pass unseen; no rows give none.
    """
    classes = omh.near_duplicates(spark, docs, scratch=_scratch(spark, "omh"))
    loose = F.col("doc_id").isNull() | F.col("text").isNull()
    key = [F.col("doc_id").cast("long").alias("__id"), omh.digest_of("text").alias("__digest")]
    once = docs.where(~loose).select("*", *key).dropDuplicates(["__id", "__digest"])
    gone = classes.where("not kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.where(loose).unionByName(once.join(gone, ["__id", "__digest"], "left_anti").select(*_columns(docs)))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur elsewhere go; a text that loses none stays as it is, with its white space.

    Null texts stay null, shorter ones stay whole, repeated rows lose all their windows; n_chars, where there, is that of what stays;
    other columns, whatever their names, pass unseen; no rows give none.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)))
    found = fm.passages(spark, own, scratch=_scratch(spark, "fm"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"__{i}") for i, c in enumerate(rest)}
    if "n_chars" in new:
        new["n_chars"] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), new["n_chars"])
    return found.select(*(new[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window of ten words, or a whole shorter item, go, known by their texts: ids may be null or repeat.

    Null and empty texts stay; repeated rows fare alike; other columns pass unseen; no rows give none.
    """
    found = decontam.matches(spark, docs, table(spark, sf_dir, "benchmark"), scratch=_scratch(spark, "decontam"))
    hit = found.where("contaminated").select(F.col("digest").alias("__digest")).distinct()
    return docs.withColumn("__digest", decontam.digest_of("text")).join(hit, "__digest", "left_anti").select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids along the Hilbert curve, with their ids.

    A null or empty text is its end id alone; repeated rows are documents of their own; ties on the curve go by doc_id; other columns go; no rows give none.
    """
    return pack.pack(spark, docs, public_tokenizers.path(VOCABULARY), scratch=_scratch(spark, "pack"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs, steps = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = steps.save(stage(spark, docs, sf_dir), name)
        if i > 1:
            steps.drop(STAGES[i - 1][0])
    return docs
