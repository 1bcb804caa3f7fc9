"""Versioned tables and their catalog as one append-only change log.

A commit writes the row events of its statements to folders of their own and then appends one marker that names them, together
with its catalog changes.  Events without a marker are never read.  A row is known by (born, stmt, ord): the sequence of the commit
that inserted it, the statement within it and a number within that, so identities never depend on other sessions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from copy import deepcopy

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.journal import snapshot
from tidemark.plans.catalog import Catalog, Table
from tidemark.plans.markers import CHECKPOINT, Markers, Taken

#: Event folders of a table after which its state is published.
PUBLISH = 48
OWN = -1  # ``born`` of a row that its own transaction inserted
_LONG = T.LongType()
ROW_ID = T.StructType([T.StructField(c, _LONG) for c in ("born", "stmt", "ord")])
AT = T.StructType([T.StructField("seq", _LONG), T.StructField("stmt", _LONG)])


class WriteConflict(Exception):
    """A row or definition that this transaction wrote was changed after its snapshot."""


class State:
    """The log up to a sequence: its catalog, and for each table its published state and the event folders since."""

    def __init__(self, seq: int = 0, catalog: Catalog | None = None, tables: dict | None = None):
        self.seq, self.catalog, self.tables = seq, catalog or Catalog(), tables or {}

    def copy(self) -> "State":
        return State(self.seq, deepcopy(self.catalog), deepcopy(self.tables))

    def apply(self, seq: int, entry: dict) -> None:
        for event in entry["catalog"]:
            self.catalog.apply(event, seq)
        for table, stmt, folder in entry["folders"]:
            self.tables.setdefault(table, {"base": None, "folders": []})["folders"].append([folder, seq, stmt])
        if "published" in entry:
            table, folder, at = entry["published"]
            own = self.tables.setdefault(table, {"base": None, "folders": []})
            own["base"], own["folders"] = [folder, at], [f for f in own["folders"] if f[1] > at]
        self.seq = seq

    def plain(self) -> dict:
        return {"catalog": self.catalog.plain(), "tables": self.tables}

    @staticmethod
    def of(seq: int, plain: dict) -> "State":
        return State(seq, Catalog.of(plain["catalog"]), plain["tables"])


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.markers = Markers(spark, f"{self.root}/commits")
        self.entries: dict[int, dict] = {}
        self._state: State | None = None

    def entry(self, seq: int) -> dict:
        """A marker; they never change, so the latest are kept."""
        if seq not in self.entries:
            self.entries = {k: v for k, v in self.entries.items() if k > seq - 4 * CHECKPOINT} | {seq: self.markers.read(seq)}
        return self.entries[seq]

    def head(self) -> int:
        return self.markers.head()

    def state(self) -> State:
        """The state at the head: the last checkpoint and the markers after it."""
        if self._state is None:
            seq, plain = self.markers.checkpoint()
            self._state = State.of(seq, plain) if plain else State()
        for seq in range(self._state.seq + 1, self.head() + 1):
            self._state.apply(seq, self.entry(seq))
        return self._state

    def state_at(self, upto: int) -> State:
        """The state at an earlier sequence."""
        seq, plain = self.markers.checkpoint(upto)
        out = State.of(seq, plain) if plain else State()
        for k in range(out.seq + 1, min(upto, self.head()) + 1):
            out.apply(k, self.entry(k))
        return out

    def write(self, table: str, events: DataFrame) -> str:
        """Writes events (op, row_id, physical columns) to a folder of their own; they count once a marker names it."""
        folder = uuid.uuid4().hex
        events.write.parquet(f"{self.root}/events/{table}/{folder}")
        return folder

    def commit(self, folders: list[list], catalog: list[dict], check: Callable[[int], None]) -> int:
        """Appends one marker over all folders and catalog changes.

        ``check(seq)`` is called with the state at ``seq - 1`` read and raises to refuse; if another commit then takes ``seq`` it is
        called again for the next one, so that nothing is committed over an unseen change.
        """
        while True:
            seq = self.state().seq + 1
            check(seq)
            try:
                self.markers.append(seq, {"folders": folders, "catalog": catalog})
                break
            except Taken:
                continue
        state = self.state()
        if seq % CHECKPOINT == 0 and state.seq >= seq:
            self.markers.save_checkpoint(state.seq, state.plain())
        for table in {f[0] for f in folders}:
            if len(state.tables[table]["folders"]) > PUBLISH and state.catalog.by_id(table):
                self.publish(state.catalog.by_id(table))
        return seq

    def publish(self, table: Table) -> int:
        """Writes a table's state at the head; later reads replay only what came after it."""
        state = self.state()
        at, folder = state.seq, uuid.uuid4().hex
        self._raw(table, state.tables.get(table.id)).write.parquet(f"{self.root}/states/{table.id}/{folder}")
        while True:
            seq = self.state().seq + 1
            try:
                self.markers.append(seq, {"folders": [], "catalog": [], "published": [table.id, folder, at]})
                return self.state().seq and at
            except Taken:
                continue

    def _folders(self, table: Table, folders: list[list]) -> DataFrame:
        """Events of folders [name, seq, stmt] with their place in the log, in one scan."""
        physical = [T.StructField(c.physical, c.type) for c in table.columns]
        kind = T.StructType([T.StructField("op", T.StringType()), T.StructField("row_id", ROW_ID), *physical])
        if not folders:
            return self.spark.createDataFrame([], T.StructType([T.StructField("at", AT), *kind.fields]))
        read = self.spark.read.schema(kind).parquet(*(f"{self.root}/events/{table.id}/{name}" for name, _, _ in folders))
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/[^/]*$", 1)
        seq = F.element_at(F.create_map(*(F.lit(x) for f in folders for x in (f[0], f[1]))), name).cast("long")
        stmt = F.element_at(F.create_map(*(F.lit(x) for f in folders for x in (f[0], f[2]))), name).cast("long")
        own = read.select(seq.alias("seq"), stmt.alias("stmt"), "op", "row_id", *(c.physical for c in table.columns))
        born = F.when(F.col("row_id.born") == OWN, F.col("seq")).otherwise(F.col("row_id.born"))
        row_id = F.struct(born.alias("born"), F.col("row_id.stmt").alias("stmt"), F.col("row_id.ord").alias("ord"))
        return own.select(F.struct("seq", "stmt").alias("at"), "op", row_id.alias("row_id"), *(c.physical for c in table.columns))

    def _raw(self, table: Table, own: dict | None, staged: list[list] = ()) -> DataFrame:
        """The last event of each live row under physical names."""
        own = own or {"base": None, "folders": []}
        log = self._folders(table, own["folders"])
        if own["base"]:
            log = log.unionByName(self.spark.read.schema(log.schema).parquet(f"{self.root}/states/{table.id}/{own['base'][0]}"))
        if staged:
            mine = self._folders(table, [[f, OWN, stmt] for f, stmt in staged])  # the rows it inserted keep OWN
            mine = mine.withColumn("at", F.struct(F.lit((1 << 62)).cast("long").alias("seq"), F.col("at.stmt").alias("stmt")))
            log = log.unionByName(mine)
        return snapshot(log, seq="at")

    def rows(self, table: Table, own: dict | None, staged: list[list] = ()) -> DataFrame:
        """Live rows (row_id, columns); an event older than a column has that column's default."""

        def value(c) -> Col:
            if c.added is None or c.default is None:
                return F.col(c.physical).alias(c.name)
            before = F.col("at") < F.struct(F.lit(c.added[0]).cast("long").alias("seq"), F.lit(c.added[1]).cast("long").alias("stmt"))
            return F.when(before, F.expr(c.default).cast(c.type)).otherwise(F.col(c.physical)).alias(c.name)

        return self._raw(table, own, staged).select("row_id", *(value(c) for c in table.columns))

    def newer(self, table: Table, since: int) -> DataFrame | None:
        """Events after a sequence, None without any."""
        folders = [[f, k, stmt] for k in range(since + 1, self.head() + 1) for t, stmt, f in self.entry(k)["folders"] if t == table.id]
        return self._folders(table, folders) if folders else None
