"""Retention, compaction and replay over an ordered journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(events: DataFrame, at: int | None = None, key: str = "row_id", seq: str = "seq") -> DataFrame:
    """Live rows as of a sequence: the last event of each row up to it, unless that deletes."""
    seen = events if at is None else events.where(F.col(seq) <= at)
    rest = [c for c in events.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*").where("op <> 'delete'")


def once(events: DataFrame, key: str = "event_id", seq: str = "seq") -> DataFrame:
    """Each event id's first entry; events with a null id are all kept."""
    rest = [c for c in events.columns if c != key]
    own = F.when(F.col(key).isNull(), F.col(seq))  # tells apart what has no id
    return events.groupBy(key, own.alias("_own")).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


class Gap(Exception):
    """The next sequence is missing, or lies behind what was applied."""


def apply_next(state: DataFrame, events: DataFrame, applied: int) -> tuple[DataFrame, int]:
    """``state`` (row_id, seq, op, ...) with the events after ``applied``, each event id taken once, and the sequence then applied.

    Events up to ``applied`` are repeats and change nothing; the rest must follow without a gap, or nothing is applied.
    """
    fresh = events.where(F.col("seq") > applied)
    low, high, n = fresh.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()
    if not n:
        return state, applied
    if low != applied + 1 or high - low + 1 != n:
        raise Gap(f"{n} sequences from {low} to {high} after {applied}")
    new = once(fresh).select(*state.columns)
    return snapshot(state.unionByName(new)).select(*state.columns), high


def idempotent(events: DataFrame) -> DataFrame:
    """Entries (producer_id, idem_key, seq, ...) with the sequence they resolve to and whether they repeat an earlier one.

    One window over the key, no join back.  Entries without a producer or key repeat nothing.
    """
    keyed = F.col("producer_id").isNotNull() & F.col("idem_key").isNotNull()
    same = Window.partitionBy("producer_id", "idem_key", F.when(~keyed, F.col("seq")))
    return events.withColumn("original_seq", F.min("seq").over(same)).withColumn("replay", F.col("seq") > F.col("original_seq"))


def retention_floor(*pins: DataFrame) -> DataFrame:
    """The least pinned sequence over tables with a column ``pin``; null, and so unsafe to trim, without any."""
    out = pins[0].select("pin")
    for p in pins[1:]:
        out = out.union(p.select("pin"))
    return out.agg(F.min("pin").alias("floor"))


def age_trim(events: DataFrame, cutoff, seq: str = "seq", ts: str = "ts") -> DataFrame:
    """The last sequence before the first entry that is not older than the cutoff."""
    first_new = events.where(F.col(ts) >= cutoff).agg(F.min(seq).alias("stop"))
    return events.join(F.broadcast(first_new)).where(F.col("stop").isNull() | (F.col(seq) < F.col("stop"))).agg(F.max(seq).alias("trim_to"))


def bytes_trim(segments: DataFrame, max_bytes: int) -> DataFrame:
    """The end of the oldest sealed segments (partition, segment, end_seq, bytes) that must go for the rest to fit."""
    newer = Window.orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn(
        "kept_bytes", F.sum("bytes").over(newer),
    ).where(F.col("kept_bytes") > max_bytes).agg(F.max("end_seq").alias("trim_to"))


class TrimUnsafe(Exception):
    pass


def trim(segments: DataFrame, floor: int | None, upto: int) -> DataFrame:
    """Sealed segments that lie wholly at or before ``upto``; refused without a retention floor or past it."""
    if floor is None or upto > floor:
        raise TrimUnsafe(f"cannot trim to {upto}: the retention floor is {floor}")
    return segments.where(F.col("end_seq") <= upto)


def compaction_candidate(segments: DataFrame, min_segments: int, max_bytes: int) -> DataFrame:
    """The longest oldest-first run of sealed segments within ``max_bytes`` and of at least ``min_segments``, of the lowest partition that has one."""
    w = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    run = segments.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("bytes").over(w)).where(F.col("total") <= max_bytes)
    best = run.groupBy("part").agg(
        F.max("n").alias("n_segments"), F.max("total").alias("total_bytes"), F.max("end_seq").alias("end_seq"),
    ).where(F.col("n_segments") >= min_segments)
    return best.orderBy("part").limit(1)


def replay(events: DataFrame, start: int, limit: int, seq: str = "seq") -> DataFrame:
    """Entries from a sequence on; offsets do not move."""
    return events.where(F.col(seq) >= start).orderBy(seq).limit(limit)
