"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, dac, decontam, ego, fm, langmix, licenses, omh, oracles, pack, quality
from tidemark.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(spark, table(spark, sf_dir, "documents")).drop("digest")


def op2_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.passages(
        spark, table(spark, sf_dir, "documents").select("doc_id", "text"),
    ).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)),
    )
    return langmix.predict(spark, docs, langmix.train(docs.where("not held_out")), carry=("held_out",))


def op4_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", {"t": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.expand(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op7_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).drop("ids")


def op10_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = dac.tokenize_to_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return dac.read_documents(spark, path, manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_order_minhash, op2_fm_substrings, op3_language_mixture, op4_chat_prefixes, op5_quality, op6_license_rules, op7_epsilon_grid,
            op8_decontamination, op9_hilbert_packing, op10_dac_tokens,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fm_substrings": oracles.OP2_SUBSTRINGS,
        "op4_chat_prefixes": oracles.OP4_CHAT,
        "op6_license_rules": oracles.OP6_LICENSES,
        "op7_epsilon_grid": oracles.OP7_VECTORS,
        "op8_decontamination": oracles.OP8_CONTAMINATION,
    }
