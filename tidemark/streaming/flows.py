"""Journal operators as Structured Streaming queries."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.semantics import within
from tidemark.operators.overlay import latest
from tidemark.sources.journal import Journal


class NotInbound(Exception):
    pass


@dataclass(frozen=True)
class StreamSpec:
    """A named stream: ``inbound`` ones take entries within their path scope, ``outbound`` ones are forwarded to."""

    name: str
    scope: str = ""
    direction: str = "inbound"


def ingest(stream: DataFrame, spec: StreamSpec, journal: Journal, checkpoint: str, triggers: DataFrame | None = None) -> StreamingQuery:
    """Puts a stream's entries (path, payload, kind, and ts_ms where there) within its scope into a journal, and what triggers forward to other streams.

    The manifest remembers a stream's last batch, so one that is repeated after a failure is taken once.  Entries outside the scope
    are left out.
    """
    if spec.direction != "inbound":
        raise NotInbound(spec.name)

    def put(batch: DataFrame, epoch: int) -> None:
        own = batch.where(within("path", spec.scope))
        now = int(batch.sparkSession.sql("SELECT unix_millis(current_timestamp())").first()[0])
        rows = own.select(*(c for c in ("path", "payload", "kind", "ts_ms") if c in batch.columns))
        if triggers is not None:
            sent = forward(own, triggers).select(
                F.concat_ws("/", F.lit("_streams"), "target", "path").alias("path"), "payload", F.lit("forwarded").alias("kind"),
            )
            rows = rows.unionByName(sent, allowMissingColumns=True)
        journal.append(rows, now, source=(spec.name, epoch))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicate(stream: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The first entry of each (producer_id, idem_key) within the time to live; state is dropped past it.

    An entry without either never repeats another: it is told apart by its ``event_id``.
    """
    keyed = F.col("producer_id").isNotNull() & F.col("idem_key").isNotNull()
    own = stream.withColumn(
        "_key",
        F.when(
            keyed, F.struct(F.col("producer_id").cast("string").alias("a"), F.col("idem_key").cast("string").alias("b")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("a"), F.col("event_id").cast("string").alias("b"))),
    )
    return own.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def forward(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """Events joined with the triggers (trigger_id, on_kind, path_prefix, target) that they fire; works on streams and tables.

    The trigger table is configuration; Spark broadcasts it where its size allows.
    """
    fires = (events["kind"] == triggers["on_kind"]) & (
        (events["path"] == triggers["path_prefix"]) | events["path"].startswith(F.concat(triggers["path_prefix"], F.lit("/")))
    )
    return events.join(triggers, fires).select(*(events[c] for c in events.columns), "trigger_id", "target")


#: Batches after which the patches of an overlay sink are merged.
MERGE_EVERY = 16


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    p, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


def _overlay_paths(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    merged = [n for n in _numbers(spark, f"{path}/merged") if before is None or n < before]
    since = merged[-1] if merged else -1
    patches = [n for n in _numbers(spark, f"{path}/patches") if n > since and (before is None or n <= before)]
    return [f"{path}/merged/{n}" for n in merged[-1:]] + [f"{path}/patches/{n}" for n in patches]


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """The latest patch of each path that an overlay sink has written."""
    return latest(spark.read.parquet(*_overlay_paths(spark, path)))


def overlay_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's latest patches; every MERGE_EVERY batches they are merged, and what was merged before goes.

    A batch that is repeated after a failure replaces its own folder.
    """

    def patch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest(batch).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/patches/{epoch}")
        if (epoch + 1) % MERGE_EVERY:
            return
        latest(spark.read.parquet(*_overlay_paths(spark, path, epoch))).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/merged/{epoch}")
        for kind, upto in (
            ("merged", epoch - 1), ("patches", epoch - MERGE_EVERY),
        ):  # readers of the last merge but one have a batch's time to end
            for n in _numbers(spark, f"{path}/{kind}"):
                if n <= upto:
                    p, fs = _folder(spark, f"{path}/{kind}/{n}")
                    fs.delete(p, True)

    return stream.writeStream.foreachBatch(patch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Delivery(StatefulProcessor):
    """Entries of one partition that wait for their acknowledgement, one state row for each."""

    def __init__(self, key: str, max_attempts: int):
        self.key, self.max_attempts = key, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "seq long", "attempts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        rank = arrived["kind"].map({"event": 0, "nack": 1, "ack": 2})
        arrived = arrived.assign(_r=rank).sort_values(["seq", "_r"], kind="stable")
        out = []
        for kind, seq in zip(arrived["kind"], arrived["seq"].astype("int64"), strict=True):
            seq = int(seq)
            known = self.waiting.containsKey((seq,))
            if kind == "event":
                if not known:
                    self.waiting.updateValue((seq,), (1,))
                continue
            if not known:
                continue
            tries = int(self.waiting.getValue((seq,))[0])
            if kind == "ack" or tries >= self.max_attempts:
                self.waiting.removeKey((seq,))
                out.append((key[0], seq, "acked" if kind == "ack" else "dead", tries))
            else:
                self.waiting.updateValue((seq,), (tries + 1,))
                out.append((key[0], seq, "retry", tries + 1))
        yield pd.DataFrame(out, columns=[self.key, "seq", "state", "attempts"])

    def close(self) -> None:
        pass


def deliver(stream: DataFrame, key: str = "part", max_attempts: int = 5) -> DataFrame:
    """Delivery outcomes by key from a stream of (part, kind, seq): ``event`` queues, ``ack`` resolves, ``nack`` counts an attempt.

    Emits (part, seq, state, attempts): acked, retry or dead.  All that arrives for a key in one trigger is taken in
    the order of sequences, of one sequence the event first.  Needs the RocksDB state store.
    """
    schema = f"{key} long, seq long, state string, attempts long"
    return stream.groupBy(key).transformWithStateInPandas(Delivery(key, max_attempts), schema, "append", "none")


class LiveFeed:
    """What a stream brings while it runs, for subscribers in this driver; a subscriber that reads too slowly loses the oldest.

    Each holds ``capacity`` rows at most, and no more than that reach the driver from a batch.
    """

    def __init__(self, stream: DataFrame, checkpoint: str, capacity: int = 256, order: str = "seq"):
        self.capacity, self.lock, self.readers = capacity, threading.Lock(), []
        self.lost: dict[int, int] = {}

        def send(batch: DataFrame, epoch: int) -> None:
            rows = batch.orderBy(F.desc(order)).limit(capacity).collect()[::-1]
            n = batch.count() if len(rows) == capacity else len(rows)
            with self.lock:
                for i, q in enumerate(self.readers):
                    self.lost[i] += max(0, len(q) + n - capacity)
                    q.extend(rows)

        self._start: Callable[[], StreamingQuery] = lambda: stream.writeStream.foreachBatch(send).option(
            "checkpointLocation", checkpoint,
        ).trigger(availableNow=True).start()

    def subscribe(self) -> Callable[[], list]:
        """A function that returns the rows since its last call, in order."""
        q: deque = deque(maxlen=self.capacity)
        with self.lock:
            self.lost[len(self.readers)] = 0
            self.readers.append(q)

        def take() -> list:
            with self.lock:
                out = list(q)
                q.clear()
            return out

        return take

    def run(self) -> StreamingQuery:
        return self._start()
