import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.crc32c import crc32c
from tidemark.operators import journal as J
from tidemark.operators.journal import TrimUnsafe
from tidemark.sources.journal import HistoryUnavailable, Journal, OutsideScope
from tidemark.sources.tables import OutOfOrder, generator, merge, numbered, sequence_faults
from tidemark.streaming import flows
from tidemark.streaming.consumers import Backpressure, Fenced, Group, GroupPolicy, Retries, Subscription

ROWS = [(i, f"{'a' if i % 3 else 'b'}/{i % 4}", "put", i % 5 == 0, f"p{i}") for i in range(1, 41)]
SCHEMA = "seq long, path string, kind string, deleted boolean, payload string"


@pytest.fixture()
def journal(spark, tmp_path):
    path = f"{tmp_path}/journal"
    spark.createDataFrame(ROWS, SCHEMA).repartition(4).write.parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), path


def test_ingest_keeps_its_scope_once(spark, journal, tmp_path):
    j = Journal(spark, f"file://{tmp_path}/j")
    triggers = spark.createDataFrame([("t", "put", "b/0", "out")], "trigger_id string, on_kind string, path_prefix string, target string")
    for _ in range(2):
        flows.ingest(journal[0], flows.StreamSpec("s", "b"), j, f"{tmp_path}/cp", triggers).awaitTermination()
    flows.ingest(
        journal[0], flows.StreamSpec("s", "b"), j, f"{tmp_path}/cp-lost", triggers,
    ).awaitTermination()  # its checkpoint was lost: batches come again
    want = [(r[1], r[4]) for r in ROWS if r[1].startswith("b/")]
    want += [(f"_streams/out/{p}", x) for p, x in want if p == "b/0"]
    assert sorted((r.path, r.payload) for r in j.checked().collect()) == sorted(want)
    with pytest.raises(flows.NotInbound):
        flows.ingest(journal[0], flows.StreamSpec("s", "b", "outbound"), j, f"{tmp_path}/cp3")


@pytest.mark.parametrize("every", [16, 2])
def test_overlay_sink_equals_batch(spark, journal, tmp_path, monkeypatch, every):
    from tidemark.operators.overlay import latest

    monkeypatch.setattr(flows, "MERGE_EVERY", every)
    flows.overlay_sink(journal[0], f"{tmp_path}/ov", f"{tmp_path}/cp2").awaitTermination()
    got = {(r.path, r.seq) for r in flows.read_overlay(spark, f"{tmp_path}/ov").collect()}
    assert got == {(r.path, r.seq) for r in latest(spark.createDataFrame(ROWS, SCHEMA)).collect()}


def test_live_feed_loses_the_oldest(spark, journal, tmp_path):
    feed = flows.LiveFeed(journal[0], f"{tmp_path}/live", capacity=6)
    take = feed.subscribe()
    feed.run().awaitTermination()
    assert len(take()) == 6 and take() == [] and feed.lost[0] == len(ROWS) - 6


def test_triggers_and_dedupe_on_streams(spark, journal, tmp_path):
    triggers = spark.createDataFrame([("t", "put", "b/0", "out")], "trigger_id string, on_kind string, path_prefix string, target string")
    q = flows.forward(journal[0], triggers).writeStream.format("memory").queryName("fired").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("fired").collect()) == [r[0] for r in ROWS if r[1] == "b/0"]
    key = F.when(F.col("seq") > 4, F.col("seq") % 10)
    s = journal[0].withColumn(
        "ts", F.timestamp_seconds("seq"),
    ).withColumn("producer_id", F.lit("p")).withColumn("idem_key", key).withColumn("event_id", F.col("seq"))
    q = flows.deduplicate(s).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 10 + 4  # four have no key


def test_delivery_state(spark, tmp_path):
    rows = [(0, "event", 1), (0, "event", 2), (0, "nack", 1), (0, "ack", 2), (1, "event", 7)]
    path = f"{tmp_path}/acts"
    spark.createDataFrame(rows, "part long, kind string, seq long").coalesce(1).write.parquet(path)
    s = spark.readStream.schema("part long, kind string, seq long").parquet(path)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    q = flows.deliver(s).writeStream.format("memory").queryName("delivered").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("delivered").collect()} == {(0, 2, "acked", 1), (0, 1, "retry", 2)}


@pytest.fixture()
def events(spark, tmp_path):
    """40 events in 4 appends over two partitions; two are of no operation that is delivered."""
    j = Journal(spark, f"file://{tmp_path}/events", partitions=2)
    rows = spark.createDataFrame(
        [(r[0], r[1], r[4], "event" if r[0] in (1, 2) else "put") for r in ROWS], "n long, path string, payload string, operation string",
    )
    for k in range(4):
        j.append(rows.where(f"(n - 1) div 10 = {k}"), 1000 + k, "n")
    return j


def test_append_numbers_and_routes(spark, events):
    got = events.checked().collect()
    assert [(r.seq, r.payload) for r in got] == [(i, f"p{i}") for i in range(1, 41)]
    assert {(r.path, r.part) for r in got} == {(p, int(crc32c([p.encode()])[0]) % 2) for p in {r[1] for r in ROWS}}
    assert len({r.event_id for r in got}) == 40
    assert [r.seq for r in events.read(12, 15).orderBy("seq").collect()] == [13, 14, 15]
    other = Journal(spark, events.root, partitions=2)
    assert other.put("x", "new", 5000) == 41 and events.put("y", "newer", 5000) == 42
    with pytest.raises(ValueError):
        events.append(spark.createDataFrame([(None, "p")], "path string, payload string"), 1)
    with pytest.raises(OutsideScope):
        events.put("a/1", "p", 1, scope="b")


def test_idempotent_producers(spark, events):
    rows = spark.createDataFrame(
        [
            (1, "k/1", "a", "p", "1"), (2, "k/2", "b", "p", "1"), (3, "k/3", "c", "p", None), (4, "k/4", "d", None, "1"),
            (5, "k/5", "e", "p", None),
        ],
        "n int, path string, payload string, producer_id string, idem_key string",
    )
    first = events.append(rows, 10_000, "n").orderBy("path").collect()
    assert [(r.seq, r.replay) for r in first] == [(41, False), (41, True), (42, False), (43, False), (44, False)]
    again = events.append(rows, 20_000, "n").orderBy("path").collect()
    assert [(r.seq, r.replay) for r in again] == [(41, True), (41, True), (45, False), (46, False), (47, False)]
    assert again[0].event_id == first[0].event_id
    late = events.append(rows.where("n = 1"), 10_000 + 24 * 3600 * 1000, "n").first()
    assert (late.seq, late.replay) == (48, False)


def test_paths_lie_over_a_base(events):
    events.seal("k", "base", 1)
    events.seal("k/1", "base 1", 2)
    assert events.resolve("k").first().payload == "base"
    events.put("k", "over", 3)
    at = events.publish()
    events.delete("k/1", 4)
    assert {
        (r.path, r.payload, r.base_present, r.overlay_present) for r in events.resolve().where("path like 'k%'").collect()
    } == {("k", "over", True, True)}
    assert [r.path for r in events.list("k").collect()] == ["k"]
    events.put("k/1", "back", 5)
    assert [r.path for r in events.list("k").collect()] == ["k", "k/1"]
    with pytest.raises(TrimUnsafe):
        events.trim(5, None)
    before = sorted(map(tuple, events.resolve().select("path", "payload").collect()))
    assert events.trim(at, 1000) > 0 and events.oldest() > 10  # no further than the snapshot
    assert sorted(map(tuple, events.resolve().select("path", "payload").collect())) == before
    with pytest.raises(HistoryUnavailable):
        events.replay(1, 5, 0)


def test_compaction_and_leases(spark, events):
    before = sorted(map(tuple, events.read().collect()))
    assert events.segments().count() == 8
    assert events.compact(2, 10_000) == 4 and events.segments().count() == 5
    assert sorted(map(tuple, events.read().collect())) == before
    assert events.compact(2, 10_000) == 4 and events.compact(2, 10_000) == 0
    assert sorted(map(tuple, Journal(spark, events.root, 2).read().collect())) == before
    assert events.floor(0) is None and events.floor(0, [7, 9]) == 7 and events.floor(0, [7], policy=3) == 3
    assert [r.seq for r in events.replay(5, 3, now=100).collect()] == [5, 6, 7]
    assert events.floor(200, [30]) == 4 and events.floor(100 + 15 * 60 * 1000, [30]) == 30


def test_subscription(spark, events):
    s = Subscription(events, "s1", scope="b", retries=Retries(max_attempts=2))
    assert s.consume(0) == (3, 1) and s.consume(0) == (3, 1)
    with pytest.raises(Backpressure):
        s.consume(0, max_events=5)
    assert s.fail(3, 1000) == "retry" and s.consume(1000) is None and s.consume(1100) == (3, 2)
    assert s.metrics(1050) == {"offset": 0, "head": 40, "lag": 40, "pending": 1, "dlq_count": 0, "backoff_until": 1100}
    s = Subscription(events, "s1", scope="b", retries=Retries(max_attempts=2))  # another driver goes on
    assert s.ack(3, 1) == "stale" and s.ack(5, 1) == "unknown" and s.ack(3, 2) == "acked" and s.ack(3, 2) == "acked"
    assert s.consume(0) == (6, 1) and s.fail(6, 0) == "retry" and s.fail(6, 50, "bad") == "dead" and s.offset == 6
    assert [
        (r.consumer, r.seq, r.path, r.payload, r.attempts, r.first_at, r.last_at, r.reason) for r in s.dead().collect()
    ] == [("s1", 6, "b/2", "p6", 2, 0, 50, "bad")]
    assert s.consume(60) == (9, 1)
    assert s.retry_dead(6, 60) == (6, 1) and s.retry_dead(6, 61) == (6, 2) and s.retry_dead(5, 60) is None
    assert s.ack_batch([(6, 2), (9, 1), (77, 1)]) == {"acked": [6, 9], "stale": [], "unknown": [77]}
    assert s.delete_dead(6, 70) and not s.delete_dead(6, 70) and s.dead().count() == 0
    assert [r.seq for r in s.replay(3, 4, 0).collect()] == [3, 6]
    one, two = Subscription(events, "s2", "b"), Subscription(events, "s2", "b")
    one.consume(0)
    with pytest.raises(Fenced):
        two.consume(0)
    assert two.consume(0) == (3, 1)
    everything = Subscription(events, "s3")
    seen = []
    while (got := everything.consume(0)) is not None:
        seen.append(got[0])
        everything.ack(*got)
    assert seen == list(range(3, 41))  # neither plain events nor dead letters
    with pytest.raises(ValueError):
        Subscription(events, "s4", max_batch_bytes=1).consume(0)


def test_group(spark, events):
    parts = {r.seq: r.part for r in events.read().where("seq > 2").collect()}
    seqs = {p: sorted(s for s, q in parts.items() if q == p) for p in (0, 1)}
    g = Group(events, "g", policy=GroupPolicy(max_in_flight=3, max_attempts=3))
    g.join("m1", 0)
    gen = g.join("m2", 0)
    assert g.assignment() == {0: "m1", 1: "m2"} and gen == 2
    a, b = seqs[0][:2]
    assert g.consume("m1", 2, 0) == [(0, a, 1), (0, b, 1)]
    g = Group(events, "g", policy=GroupPolicy(max_in_flight=3, max_attempts=3))  # another driver goes on
    assert g.ack("m1", gen, 0, b) == "acked" and g.offset(0) == a - 1
    assert g.ack("m1", gen, 0, a) == "acked" and g.offset(0) == b
    assert g.ack("m2", gen, 0, a) == "stale" and g.ack("m1", gen, 0, a) == "unknown" and g.ack("m1", gen - 1, 0, a) == "stale"
    first = g.consume("m2", 3, 0)
    assert [s for _, s, _ in first] == seqs[1][:3]
    with pytest.raises(Backpressure):
        g.consume("m2", 1, 0)
    c = seqs[1][0]
    assert g.fail("m2", gen, 1, c, 1000) == "retry"  # the first delay is none
    assert g.consume("m2", 5, 1000) == [(1, c, 2)] and g.fail("m2", gen, 1, c, 2000) == "retry"
    with pytest.raises(Backpressure):
        g.consume("m2", 5, 2999)  # one second to wait
    assert g.consume("m2", 5, 3000) == [(1, c, 3)] and g.fail("m2", gen, 1, c, 3500, "bad") == "dead"
    assert g.offset(1) == seqs[1][1] - 1
    assert [(r.seq, r.attempts, r.reason) for r in g.dead().collect()] == [(c, 3, "bad")]
    assert [(r.part, r.member, r.pending) for r in g.describe().collect()] == [(0, "m1", 0), (1, "m2", 2)]
    assert g.expire(30_000) == ["m1", "m2"] and g.assignment() == {}
    g.join("m3", 40_000)
    assert g.consume("m3", 2, 40_000) == [(1, s, 1) for s in seqs[1][1:3]]  # recovered first
    late = Group(events, "late", policy=GroupPolicy(start="latest"))
    late.join("m", 0)
    assert late.consume("m", 5, 0) == []
    events.put("a/9", "new", 9)
    assert [s for _, s, _ in late.consume("m", 5, 0)] == [events.state()["end"]]


def test_sources(spark, tmp_path):
    df = numbered(spark.range(100).repartition(5).withColumn("k", -F.col("id")), 11, "k")
    assert sorted((r.sequence, r.id) for r in df.collect()) == [(11 + i, 99 - i) for i in range(100)]
    seqs = [1, 2, 2, 5, 32767, 32768, 32768, 32770, 100_000, 5_000_000_000]
    want = {(2, "duplicate"), (5, "gap"), (32767, "gap"), (32768, "duplicate"), (32770, "gap"), (100_000, "gap"), (5_000_000_000, "gap")}
    assert {tuple(r) for r in sequence_faults(spark.createDataFrame([(s,) for s in seqs], "sequence long")).collect()} == want
    assert sequence_faults(spark.range(1, 200_000).toDF("sequence")).collect() == []
    log = lambda seqs: spark.createDataFrame(list(enumerate(seqs)), "at long, sequence long")
    assert [r.sequence for r in merge([log([1, 4, 5]), log([2, 3])], place="at").collect()] == [1, 2, 3, 4, 5]
    for bad in ([log([1, 4, 3])], [log([1, 2]), log([2, 3])]):
        with pytest.raises(OutOfOrder):
            merge(bad, place="at")


def test_generator_emits_at_its_interval(spark, tmp_path):
    q = generator(spark, "n={n} at {ts}", 10).writeStream.format("memory").queryName("made").option(
        "checkpointLocation", f"{tmp_path}/g",
    ).trigger(processingTime="50 milliseconds").start()
    try:
        for _ in range(100):
            time.sleep(0.2)
            if spark.table("made").count() >= 3:
                break
    finally:
        q.stop()
    rows = sorted(spark.table("made").collect())
    assert [r.n for r in rows] == list(range(len(rows))) and len(rows) >= 3
    assert {(b.timestamp - a.timestamp).total_seconds() for a, b in zip(rows, rows[1:], strict=False)} == {0.05}  # 10 ms is raised to the least
    assert rows[0].payload.startswith("n=0 at ")


def test_applying_events_rejects_gaps(spark):
    state = spark.createDataFrame([(1, 1, "insert", "a")], "row_id long, seq long, op string, v string")
    more = lambda rows: spark.createDataFrame(rows, "row_id long, seq long, op string, v string, event_id string")
    got, at = J.apply_next(
        state,
        more(
            [
                (9, 1, "insert", "old", "x"), (1, 2, "update", "b", "y"), (2, 3, "insert", "c", "z"), (2, 4, "delete", None, "w"),
                (3, 5, "insert", "d", "z"),
            ]
        ),
        1,
    )
    assert sorted((r.row_id, r.v) for r in got.collect()) == [(1, "b")] and at == 5
    with pytest.raises(J.Gap):
        J.apply_next(state, more([(1, 3, "update", "b", "y")]), 1)
    assert J.apply_next(state, more([(1, 1, "update", "b", "y")]), 1)[1] == 1
    rows = spark.createDataFrame(
        [("p", "k", 1), ("p", "k", 2), (None, "k", 3), (None, "k", 4), ("p", None, 5)], "producer_id string, idem_key string, seq long",
    )
    assert sorted((r.seq, r.original_seq, r.replay) for r in J.idempotent(rows).collect()) == [
        (1, 1, False), (2, 1, True), (3, 3, False), (4, 4, False), (5, 5, False),
    ]
