"""Consumers of a journal: acknowledgement, retries, dead letters, lag and group assignment, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous_offset(offsets: DataFrame, resolved: DataFrame, delivered: DataFrame) -> DataFrame:
    """(consumer, offset): each offset moved over the sequences that are resolved without a hole.

    offsets (consumer, offset), resolved and delivered (consumer, seq): it stops before the first delivered but unresolved sequence.
    """
    open_ = delivered.join(
        resolved, ["consumer", "seq"], "left_anti",
    ).join(offsets, "consumer").where("seq > offset").groupBy("consumer").agg(F.min("seq").alias("hole"))
    high = delivered.groupBy("consumer").agg(F.max("seq").alias("high"))
    j = offsets.join(open_, "consumer", "left").join(high, "consumer", "left")
    return j.select("consumer", F.greatest("offset", F.coalesce(F.col("hole") - 1, "high", "offset")).alias("offset"))


def classify_acks(acks: DataFrame, pending: DataFrame) -> DataFrame:
    """(consumer, seq, attempt, outcome): acked for the pending attempt, stale for an older one, unknown without a pending delivery."""
    p = pending.select("consumer", "seq", F.col("attempt").alias("current"))
    out = F.when(F.col("current").isNull(), "unknown").when(F.col("attempt") < F.col("current"), "stale").otherwise("acked")
    return acks.join(p, ["consumer", "seq"], "left").select("consumer", "seq", "attempt", out.alias("outcome"))


def dead_letters(deliveries: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Deliveries that used up their attempts, with their dead-letter path."""
    return deliveries.where(F.col("attempt") >= max_attempts).withColumn(
        "dlq_path", F.concat_ws("/", F.lit("_system/dlq"), "consumer", F.col("seq").cast("string")),
    )


def lag(offsets: DataFrame, events: DataFrame) -> DataFrame:
    """(consumer, offset, head, lag): head is one number, so it is broadcast."""
    head = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    return offsets.join(F.broadcast(head)).select("consumer", "offset", "head", (F.col("head") - F.col("offset")).alias("lag"))


def assign(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """(part, member): sorted partitions dealt in turn to sorted members; both are small control tables."""
    m = members.select("member", (F.row_number().over(Window.orderBy("member")) - 1).alias("k"))
    p = partitions.select("part", (F.row_number().over(Window.orderBy("part")) - 1).alias("i"))
    n = members.agg(F.count(F.lit(1)).alias("n"))
    dealt = p.join(F.broadcast(n)).where("n > 0").select("part", (F.col("i") % F.col("n")).alias("k"))
    return dealt.join(m, "k").select("part", "member")


def group_start(events: DataFrame, policy: str) -> DataFrame:
    """(part, start): before the oldest entry for ``earliest``, at the head for ``latest``."""
    return events.groupBy("part").agg((F.min("seq") - 1 if policy == "earliest" else F.max("seq")).alias("start"))
