"""A durable, partitioned journal of ordered events, with an overlay of paths over a sealed base.

An append writes its events with numbers from 0 and then one manifest entry that gives them their sequences, so that a sequence is
taken once and an append that is lost halfway leaves nothing to be read.  Segments are the files of one append (or of one
compaction) in one partition; the manifest says which count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.crc32c import crc32c, partition_of
from tidemark.functions.semantics import within
from tidemark.operators import journal as J
from tidemark.operators import overlay as O
from tidemark.plans.markers import CHECKPOINT, Markers, Taken
from tidemark.sources.tables import numbered, sequence_faults

DEAD = "_system/dlq"
TTL_MS, REMEMBERED = 24 * 3600 * 1000, 4096
LEASE_MS = 15 * 60 * 1000
#: Segments up to which the manifest is joined by broadcast.
FEW = 50_000
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("operation", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("producer_id", T.StringType()), T.StructField("idem_key", T.StringType()),
])
_FILE = T.StructType([T.StructField("ord", T.LongType()), *EVENT.fields])


class HistoryUnavailable(Exception):
    pass


class SequenceFault(Exception):
    """A sequence is missing or repeated."""


class OutsideScope(Exception):
    pass


class Journal:
    """``append`` and ``read`` events; ``put``, ``delete``, ``seal``, ``resolve`` and ``list`` paths; ``compact``, ``trim`` and ``replay``.

    Time is passed in as ms.  Events have a kind (free text) and an operation: put, delete or seal where they concern a path, else event.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int = 8):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions
        self.manifest = Markers(spark, f"{self.root}/manifest")
        self._seq, self._state = 0, {"end": 0, "trimmed": 0, "segments": [], "leases": {}, "snapshot": None, "sources": {}}

    # -- manifest

    def state(self) -> dict:
        """end, trimmed, segments, leases and the published snapshot, folded from the manifest."""
        if not self._seq:
            seq, kept = self.manifest.checkpoint()
            if kept:
                self._seq, self._state = seq, kept
        for k in range(self._seq + 1, self.manifest.head() + 1):
            self._fold(self.manifest.read(k))
            self._seq = k
        return self._state

    def _fold(self, e: dict) -> None:
        s = self._state
        if e["op"] == "append":
            s["segments"] += [
                x | {"base": s["end"] + 1, "first": s["end"] + 1 + x["low"], "end": s["end"] + 1 + x["high"]} for x in e["segments"]
            ]
            s["end"] += e["n"]
            if e.get("source"):
                s["sources"][e["source"][0]] = e["source"][1]
        elif e["op"] == "replace":  # the rewritten segment holds whole sequences
            s["segments"] = [x for x in s["segments"] if x["id"] not in e["gone"]] + e["new"]
        elif e["op"] == "trim":
            s["segments"], s["trimmed"] = [x for x in s["segments"] if x["id"] not in e["gone"]], max(s["trimmed"], e["upto"])
        elif e["op"] == "lease":
            s["leases"] = {k: v for k, v in s["leases"].items() if v[1] > e["now"]} | {e["id"]: [e["seq"], e["until"]]}
        elif e["op"] == "snapshot":
            s["snapshot"] = [e["seq"], e["folder"]]

    def _add(self, entry: dict) -> None:
        """Adds a manifest entry after whatever others have added; raises Taken only within."""
        while True:
            seq = (self.state(), self._seq)[1] + 1
            try:
                self.manifest.append(seq, entry)
                break
            except Taken:
                continue
        self.state()
        if seq % CHECKPOINT == 0 and self._seq == seq:
            self.manifest.save_checkpoint(seq, self._state)

    def segments(self) -> DataFrame:
        """(part, segment, id, first_seq, end_seq, n, bytes) of what the manifest holds; segments of a partition are numbered by age."""
        order = sorted(self.state()["segments"], key=lambda x: (x["part"], x["first"]))
        counts: dict[int, int] = {}
        rows = []
        for x in order:
            counts[x["part"]] = counts.get(x["part"], -1) + 1
            rows.append((x["part"], counts[x["part"]], x["id"], x["first"], x["end"], x["n"], x["bytes"]))
        return self.spark.createDataFrame(rows, "part long, segment long, id string, first_seq long, end_seq long, n long, bytes long")

    def _path(self, segment: dict) -> str:
        return f"{self.root}/segments/{segment['id'].split('/')[0]}/part={segment['part']}"

    # -- append and read

    def append(self, df: DataFrame, now: int, *order: str, source: tuple[str, int] | None = None) -> DataFrame | None:
        """Appends events (path, payload and any of kind, operation, ts_ms, event_id, producer_id, idem_key) in the given order.

        Returns (seq, event_id, path, replay) of every row.  A row whose producer_id and idem_key (both not null) were among the last
        REMEMBERED such keys within TTL_MS is not appended: it has the first entry's sequence and event id, and ``replay`` is true.  A null path
        is an error; partitions are CRC-32C of the path.  ``source``: a stream and its batch number; a batch that is there already is
        left out as a whole, and None returned.
        """
        if source and self.state()["sources"].get(source[0], -1) >= source[1]:
            return None
        have = {c.lower() for c in df.columns}
        default = {"kind": F.lit("event"), "operation": F.lit("put"), "ts_ms": F.lit(now).cast("long"), "event_id": F.expr("uuid()")}
        value = lambda f: F.coalesce(
            F.col(f.name), default[f.name],
        ) if f.name in have and f.name in default else F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))
        keep = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)] or [F.monotonically_increasing_id().alias("_o0")]
        own = df.select(*(value(f).cast(f.dataType).alias(f.name) for f in EVENT.fields), *keep)
        folder = uuid.uuid4().hex
        staged = f"{self.root}/staged/{folder}"
        numbered(own, 0, *(f"_o{i}" for i in range(len(keep)))).withColumnRenamed("sequence", "row").write.parquet(staged)
        rows = self.spark.read.parquet(staged).select("row", *(f.name for f in EVENT.fields))
        if rows.where("path is null").limit(1).count():
            raise ValueError("an event without a path")
        keyed = F.col("producer_id").isNotNull() & F.col("idem_key").isNotNull()
        known = None
        if rows.where(keyed).limit(1).count():
            known = self._remembered(now)
            first = rows.where(keyed).groupBy("producer_id", "idem_key").agg(F.min("row").alias("first_row"))
            rows = rows.join(first, ["producer_id", "idem_key"], "left").join(known, ["producer_id", "idem_key"], "left")
            rows = rows.withColumn("replay", F.coalesce(F.col("old_seq").isNotNull() | (F.col("row") > F.col("first_row")), F.lit(False)))
        else:
            rows = rows.select(
                "*", F.lit(None).cast("long").alias("first_row"), F.lit(None).cast("long").alias("old_seq"),
                F.lit(None).cast("string").alias("old_id"), F.lit(False).alias("replay"),
            )
        fresh = numbered(rows.where(~F.col("replay")), 0, "row").withColumnRenamed("sequence", "ord").withColumn(
            "part", partition_of("path", self.partitions),
        )
        fresh.select("part", "row", *(f.name for f in _FILE.fields)).write.partitionBy("part").parquet(f"{self.root}/segments/{folder}")
        written = self.spark.read.schema(
            T.StructType([T.StructField("part", T.LongType()), T.StructField("row", T.LongType()), *_FILE.fields])
        ).parquet(f"{self.root}/segments/{folder}")
        size = F.length("path") + F.coalesce(F.length("payload"), F.lit(0))
        per = written.groupBy("part").agg(
            F.min("ord").alias("low"), F.max("ord").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"),
        ).collect()  # a row for each partition
        segments = [{"id": f"{folder}/{r.part}", "part": r.part, "low": r.low, "high": r.high, "n": r.n, "bytes": r.bytes} for r in per]
        total = sum(x["n"] for x in segments)
        if total or source:
            self._add({"op": "append", "n": total, "segments": segments, "source": source})
        base = next((x["base"] for x in self.state()["segments"] if segments and x["id"] == segments[0]["id"]), 0)
        new = written.select("row", (F.col("ord") + base).alias("seq"), F.col("event_id").alias("new_id"))
        origin = F.when(F.col("replay") & F.col("old_seq").isNull(), F.col("first_row")).otherwise(F.col("row"))
        out = rows.withColumn("origin", origin).join(new.withColumnRenamed("row", "origin"), "origin", "left")
        return out.select(F.coalesce("old_seq", "seq").alias("seq"), F.coalesce("old_id", "new_id").alias("event_id"), "path", "replay")

    def _remembered(self, now: int) -> DataFrame:
        """(producer_id, idem_key, old_seq, old_id) of the keys that still count."""
        recent = self.read().where("producer_id is not null and idem_key is not null").where(F.col("ts_ms") > now - TTL_MS)
        recent = recent.orderBy(F.desc("seq")).limit(REMEMBERED)
        return recent.groupBy("producer_id", "idem_key").agg(F.min("seq").alias("old_seq"), F.min_by("event_id", "seq").alias("old_id"))

    def read(self, since: int = 0, upto: int | None = None) -> DataFrame:
        """Events (seq, part, ...) after ``since`` up to ``upto``; only segments that reach into the range are read."""
        chosen = [x for x in self.state()["segments"] if x["end"] > since and (upto is None or x["first"] <= upto)]
        if not chosen:
            return self.spark.createDataFrame(
                [], T.StructType([T.StructField("seq", T.LongType()), T.StructField("part", T.LongType()), *EVENT.fields]),
            )
        files = self.spark.read.schema(_FILE).parquet(*(self._path(x) for x in chosen))
        place = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(r"/([0-9a-f]{32})/part=(\d+)/"), F.lit(1))
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/part=(\d+)/[^/]*$", 1)
        rows = files.select("*", F.element_at(place, -1).alias("folder"), part.cast("long").alias("part"))
        bases = self.spark.createDataFrame(sorted({(x["id"].split("/")[0], x["base"]) for x in chosen}), "folder string, base long")
        rows = rows.join(F.broadcast(bases) if len(chosen) <= FEW else bases, "folder").withColumn("seq", F.col("base") + F.col("ord"))
        rows = rows.where(F.col("seq") > since)
        if upto is not None:
            rows = rows.where(F.col("seq") <= upto)
        return rows.select("seq", "part", *(f.name for f in EVENT.fields))

    def checked(self, since: int = 0) -> DataFrame:
        """``read`` in sequence order, after a look for missing and repeated sequences, which are an error."""
        rows = self.read(since)
        bad = sequence_faults(rows, "seq").limit(1).collect()
        if bad:
            raise SequenceFault(f"{bad[0].fault} at {bad[0].seq}")
        return rows.orderBy("seq")

    # -- paths

    def put(self, path: str, payload: str, now: int, kind: str = "data_put", scope: str | None = None) -> int:
        return self._one(path, payload, "put", now, kind, scope)

    def delete(self, path: str, now: int) -> int:
        return self._one(path, None, "delete", now, "data_delete", None)

    def seal(self, path: str, payload: str, now: int) -> int:
        """Writes a path's base value, over which puts and deletes lie; the latest seal counts."""
        return self._one(path, payload, "seal", now, "data_put", None)

    def _one(self, path: str, payload: str | None, operation: str, now: int, kind: str, scope: str | None) -> int:
        if scope is not None and not (path == scope.rstrip("/") or path.startswith(scope.rstrip("/") + "/")):
            raise OutsideScope(path)
        part, folder, event = int(crc32c([path.encode()])[0]) % self.partitions, uuid.uuid4().hex, uuid.uuid4()
        target = {"id": f"{folder}/{part}", "part": part, "low": 0, "high": 0, "n": 1, "bytes": len(path) + len(payload or "")}
        row = (0, str(event), now, path, kind, operation, payload, None, None)
        self.spark.createDataFrame([row], _FILE).coalesce(1).write.parquet(self._path(target))  # one event: nothing to number or to route
        self._add({"op": "append", "n": 1, "segments": [target], "source": None})
        return next(x["first"] for x in self.state()["segments"] if x["id"] == target["id"])

    def _layers(self, upto: int | None = None) -> DataFrame:
        """(path, operation, payload, seq) of what concerns paths: the published snapshot and the events after it."""
        snap = self.state()["snapshot"]
        own = ["path", "operation", "payload", "seq"]
        rows = self.read(snap[0] if snap else 0, upto).where("operation in ('put', 'delete', 'seal')").select(*own)
        return rows.unionByName(self.spark.read.parquet(f"{self.root}/snapshots/{snap[1]}")) if snap else rows

    def base(self) -> DataFrame:
        return O.latest(self._layers().where("operation = 'seal'").select("path", "payload", "seq")).select("path", "payload")

    def patches(self) -> DataFrame:
        return self._layers().where("operation <> 'seal'").select(
            "path", "seq", (F.col("operation") == "delete").alias("deleted"), "payload",
        )

    def resolve(self, path: str | None = None) -> DataFrame:
        """(path, payload, base_present, overlay_present, layer_seq) of live paths: a delete hides, a put wins, else the base."""
        at = F.col("path") == path if path is not None else F.lit(True)
        return O.resolve(self.base().where(at), self.patches().where(at))

    def list(self, prefix: str = "") -> DataFrame:
        return O.list_keys(self.base(), self.patches(), prefix)

    # -- dead letters: envelopes at paths of their own

    def bury(self, consumer: str, entry: DataFrame, now: int) -> None:
        """Puts envelopes (seq, event_id, path, payload, attempts, first_at, last_at, reason) under the consumer's path; one for each sequence."""
        body = F.to_json(F.struct("seq", "event_id", "path", "payload", "attempts", "first_at", "last_at", "reason"))
        own = F.concat_ws("/", F.lit(DEAD), F.lit(consumer), F.col("seq").cast("string"))
        self.append(entry.select(own.alias("path"), body.alias("payload"), F.lit("dead_letter").alias("kind"), "seq"), now, "seq")

    def dead(self, consumer: str | None = None) -> DataFrame:
        """Dead letters (consumer, seq, event_id, path, payload, attempts, first_at, last_at, reason), in sequence order."""
        prefix = DEAD if consumer is None else f"{DEAD}/{consumer}"
        live = O.resolve(self.base().where("false"), self.patches().where(within("path", prefix)))
        kind = "seq long, event_id string, path string, payload string, attempts long, first_at long, last_at long, reason string"
        return live.select(
            F.element_at(F.split("path", "/"), -2).alias("consumer"), F.from_json("payload", kind).alias("e"),
        ).select("consumer", "e.*").orderBy("seq")

    def discard_dead(self, consumer: str, seq: int, now: int) -> bool:
        """Deletes a dead letter by a tombstone; false if there is none."""
        path = f"{DEAD}/{consumer}/{seq}"
        if not self.resolve(path).limit(1).count():
            return False
        self.delete(path, now)
        return True

    # -- retention

    def replay(self, start: int, limit: int, now: int) -> DataFrame:
        """Entries from a sequence on; offsets do not move, and for LEASE_MS nothing from there on is trimmed."""
        oldest = self.oldest()
        if start < oldest:
            raise HistoryUnavailable(f"the journal begins at {oldest}")
        self._add({"op": "lease", "id": uuid.uuid4().hex, "seq": start - 1, "until": now + LEASE_MS, "now": now})
        return self.read(start - 1).orderBy("seq").limit(limit)

    def oldest(self) -> int:
        return min((x["first"] for x in self.state()["segments"]), default=self.state()["end"] + 1)

    def publish(self) -> int:
        """Writes the last seal and the last patch of each path as of the head; reads of paths begin there."""
        at, folder = self.state()["end"], uuid.uuid4().hex
        layers = self._layers(at).withColumn("sealed", F.col("operation") == "seal")
        last = layers.groupBy("path", "sealed").agg(F.max_by(F.struct("operation", "payload", "seq"), "seq").alias("r"))
        last.select("path", "r.operation", "r.payload", "r.seq").write.parquet(f"{self.root}/snapshots/{folder}")
        self._add({"op": "snapshot", "seq": at, "folder": folder})
        return at

    def floor(self, now: int, offsets: list[int] = (), policy: int | None = None) -> int | None:
        """The last sequence that nobody needs: the least of consumer offsets, the published snapshot, living leases and a policy; null without any."""
        s = self.state()
        pins = [
            *offsets, *([s["snapshot"][0]] if s["snapshot"] else []), *(seq for seq, until in s["leases"].values() if until > now),
            *([policy] if policy is not None else []),
        ]
        return min(pins, default=None)

    def trim(self, upto: int, floor: int | None) -> int:
        """Drops whole segments that end at or before ``upto`` from the manifest, then their files.

        Refused past the floor, and past the published snapshot, which holds what paths still show of trimmed events.
        """
        snap = self.state()["snapshot"]
        J.trim(self.segments().limit(0), min(floor, snap[0]) if snap and floor is not None else None, upto)
        gone = [x for x in self.state()["segments"] if x["end"] <= upto]
        if gone:
            self._add({"op": "trim", "gone": [x["id"] for x in gone], "upto": upto})
            self._delete(gone)
        return len(gone)

    def _delete(self, segments: list[dict]) -> None:
        for x in segments:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(x))
            p.getFileSystem(self.manifest.conf).delete(p, True)

    def compact(self, min_segments: int, max_bytes: int) -> int:
        """Merges the oldest run of a partition's segments that fits into one, every record kept; readers see either form.

        Records are sorted by range over as many tasks as Spark's sizes ask for.  Returns how many segments became one.
        """
        best = J.compaction_candidate(self.segments(), min_segments, max_bytes).first()
        if best is None:
            return 0
        old = sorted((x for x in self.state()["segments"] if x["part"] == best.part), key=lambda x: x["first"])[: best.n_segments]
        folder = uuid.uuid4().hex
        rows = None
        for x in old:
            part = self.spark.read.schema(_FILE).parquet(self._path(x)).withColumn("ord", F.col("ord") + F.lit(x["base"]))
            rows = part if rows is None else rows.unionByName(part)
        target = {
            "id": f"{folder}/{best.part}", "part": best.part, "base": 0, "first": old[0]["first"], "end": max(x["end"] for x in old),
            "n": sum(x["n"] for x in old), "bytes": sum(x["bytes"] for x in old),
        }
        rows.repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(self._path(target))
        gone = [x["id"] for x in old]
        there = {x["id"] for x in self.state()["segments"]}
        if not set(gone) <= there:  # trimmed or compacted by another meanwhile
            self._delete([target])
            return 0
        self._add({"op": "replace", "gone": gone, "new": [target]})
        self._delete(old)
        return len(old)
