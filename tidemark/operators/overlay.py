"""An overlay of patches over a sealed base: the latest patch of a path wins, a tombstone hides it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import within


def latest(events: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """The last row of each key, by partial aggregation instead of a sort."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def resolve(base: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, payload, base_present, overlay_present, layer_seq) of live paths; base (path, payload), patches (path, seq, deleted, payload)."""
    top = latest(patches).select("path", "deleted", F.col("payload").alias("patch"), "seq")
    both = base.select(
        "path", F.col("payload").alias("sealed"), F.lit(True).alias("b"),
    ).join(top.withColumn("o", F.lit(True)), "path", "full")
    live = both.where("not coalesce(deleted, false)")
    return live.select(
        "path", F.when(F.col("o"), F.col("patch")).otherwise(F.col("sealed")).alias("payload"),
        F.coalesce("b", F.lit(False)).alias("base_present"), F.coalesce("o", F.lit(False)).alias("overlay_present"),
        F.col("seq").alias("layer_seq"),
    )


def list_keys(base: DataFrame, patches: DataFrame, prefix: str = "") -> DataFrame:
    """Live paths at or below a prefix, sorted; the prefix filter comes before the join."""
    return resolve(base.where(within("path", prefix)), patches.where(within("path", prefix))).select("path").orderBy("path")
