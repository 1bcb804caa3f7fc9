import pytest
from pyspark.sql import functions as F

from tidemark.plans import changelog, ddl, markers
from tidemark.plans.binder import BindError
from tidemark.plans.catalog import CatalogError
from tidemark.plans.changelog import WriteConflict
from tidemark.plans.constraints import ConstraintViolation
from tidemark.plans.session import EngineSession


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/log"


@pytest.fixture()
def db(spark, root):
    s = EngineSession(spark, root)
    s.sql("CREATE TABLE users (id BIGINT PRIMARY KEY, name TEXT NOT NULL, age INTEGER, note TEXT DEFAULT 'new')")
    s.sql("INSERT INTO users (id, name, age) VALUES (1, 'ann', 30), (2, 'bob', NULL), (3, 'cyd', 50)")
    return s


def rows(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def ids(s, text="SELECT id FROM users"):
    return sorted(r[0] for r in s.sql(text).collect())


def test_changes_and_snapshots(db):
    first = db.log.head()
    assert db.sql("-- a comment\nUPDATE users SET age = 31, note = 'x,y' WHERE id = 1") == 1
    assert db.sql("/* more */ DELETE FROM users WHERE age > 40;") == 1
    assert ids(db) == [1, 2]
    assert rows(db, "SELECT age, note FROM users WHERE id = 1") == [(31, "x,y")]
    assert sorted(r.id for r in db.table("users", at=first).collect()) == [1, 2, 3]
    assert rows(db, "SELECT note FROM users WHERE id = 2") == [("new",)]
    assert db.sql("UPDATE users SET age = age + 1") == 2 and rows(db, "SELECT age FROM users ORDER BY age") == [(32,), (None,)]


def test_transaction_reads_its_writes_and_rolls_back(db):
    db.sql("BEGIN")
    db.sql("INSERT INTO users (id, name) VALUES (9, 'zed')")
    db.sql("UPDATE users SET name = 'zoe' WHERE id = 9")
    assert rows(db, "SELECT name FROM users WHERE id = 9") == [("zoe",)]
    db.sql("ROLLBACK")
    assert ids(db) == [1, 2, 3]
    db.sql("BEGIN TRANSACTION")
    db.sql("DELETE FROM users WHERE id = 1")
    db.sql("INSERT INTO users (id, name) VALUES (1, 'again')")
    db.sql("UPDATE users SET name = 'last' WHERE id = 1")
    db.sql("COMMIT")
    assert rows(db, "SELECT id, name FROM users ORDER BY id") == [(1, "last"), (2, "bob"), (3, "cyd")]


def test_sessions_share_tables_and_lose_no_rows(db, spark, root):
    other = EngineSession(spark, root)
    db.sql("INSERT INTO users (id, name) VALUES (4, 'a')")
    other.sql("INSERT INTO users (id, name) VALUES (5, 'b')")
    db.sql("INSERT INTO users (id, name) VALUES (6, 'c')")
    assert ids(db) == ids(other) == [1, 2, 3, 4, 5, 6]
    assert ids(EngineSession(spark, root)) == [1, 2, 3, 4, 5, 6]


def test_first_committer_wins(db, spark, root):
    late = EngineSession(spark, root)
    late.sql("BEGIN")
    late.sql("DELETE FROM users WHERE id = 1")
    db.sql("UPDATE users SET age = 1 WHERE id = 1")
    with pytest.raises(WriteConflict):
        late.sql("COMMIT")
    assert rows(db, "SELECT age FROM users WHERE id = 1") == [(1,)]
    late.sql("BEGIN")
    late.sql("UPDATE users SET age = 2 WHERE id = 1")
    db.sql("UPDATE users SET age = 3 WHERE id = 2")  # another row: no conflict
    late.sql("COMMIT")
    assert rows(db, "SELECT id, age FROM users WHERE id < 3 ORDER BY id") == [(1, 2), (2, 3)]


def test_keys_hold_across_open_transactions(db, spark, root):
    a, b = EngineSession(spark, root), EngineSession(spark, root)
    for s in (a, b):
        s.sql("BEGIN")
        s.sql("INSERT INTO users (id, name) VALUES (7, 'x')")
    a.sql("COMMIT")
    with pytest.raises(ConstraintViolation):
        b.sql("COMMIT")
    assert ids(db) == [1, 2, 3, 7]


def test_a_commit_between_check_and_marker_is_seen(db, spark, root):
    """Another commit takes the number while this one is being checked: it is checked again, against that commit."""
    other, late = EngineSession(spark, root), EngineSession(spark, root)
    late.sql("BEGIN")
    late.sql("DELETE FROM users WHERE id = 1")
    check, calls = late.txn.check, []

    def slow(seq):
        check(seq)
        if not calls:
            calls.append(seq)
            other.sql("UPDATE users SET age = 5 WHERE id = 1")

    late.txn.check = slow
    with pytest.raises(WriteConflict):
        late.sql("COMMIT")
    assert ids(db) == [1, 2, 3]


def test_constraints(db):
    for bad in (
        "INSERT INTO users (id, name) VALUES (1, 'dup')", "INSERT INTO users (id, age) VALUES (4, 1)",
        "UPDATE users SET id = 1 WHERE id = 2", "UPDATE users SET name = NULL",
    ):
        with pytest.raises(ConstraintViolation):
            db.sql(bad)
    db.sql("CREATE UNIQUE INDEX by_age ON users (age)")
    db.sql("INSERT INTO users (id, name) VALUES (5, 'no age')")
    with pytest.raises(ConstraintViolation):
        db.sql("INSERT INTO users (id, name, age) VALUES (6, 'same age', 30)")
    db.sql("BEGIN")
    with pytest.raises(ConstraintViolation):
        db.sql("INSERT INTO users (id, name) VALUES (8, 'p'), (8, 'q')")
    db.sql("INSERT INTO users (id, name) VALUES (8, 'r')")  # the failed statement left nothing behind
    db.sql("COMMIT")
    assert ids(db) == [1, 2, 3, 5, 8]
    db.sql("DROP INDEX by_age")
    db.sql("INSERT INTO users (id, name, age) VALUES (6, 'same age', 30)")
    with pytest.raises(ConstraintViolation):
        db.sql("CREATE UNIQUE INDEX by_age ON users (age)")


@pytest.mark.parametrize("bad", [
    "UPDATE users SET age = 1, age = 2", "INSERT INTO users (nope) VALUES (1)", "SELECT * FROM users WHERE age = NULL", "SELECT nope FROM users", "SELECT id FROM missing",
    "SELECT age * 1.5 FROM users", "SELECT id FROM users WHERE age > 1.5", "SELECT id FROM users WHERE name = 1", "SELECT name, count(*) FROM users GROUP BY age", "INSERT INTO users (id, name) VALUES (1)",
    "INSERT INTO users (id, name) VALUES ('1', 'x')", "SELECT -name FROM users", "SELECT id FROM users WHERE age", "CREATE TABLE users (a INT)", "DROP TABLE missing", "CREATE TABLE t (a NOTYPE)", "BEGIN; COMMIT",
])
def test_statements_that_do_not_bind(db, bad):
    with pytest.raises(BindError):
        db.sql(bad)


def test_sql_has_the_engines_rules(db):
    db.sql("CREATE TABLE n (k INT, a BIGINT, b BIGINT, x DOUBLE, y DOUBLE)")
    db.sql("INSERT INTO n (k, a, b, x, y) VALUES (1, 9223372036854775807, 1, 1.0, 0.0), (2, -9223372036854775808, -1, -1.0, 0.0), (3, 7, 0, 0.0, 0.0), (4, NULL, 2, NULL, 1.0)")
    assert rows(db, "SELECT a + b, a - b, a * b FROM n ORDER BY k") == [
        ((1 << 63) - 1, (1 << 63) - 2, (1 << 63) - 1), (-(1 << 63), -(1 << 63) + 1, (1 << 63) - 1), (7, 7, 0), (None, None, None),
    ]
    assert rows(db, "SELECT a / b, a % b, -a FROM n ORDER BY k") == [
        ((1 << 63) - 1, 0, -(1 << 63) + 1), ((1 << 63) - 1, 0, (1 << 63) - 1), (None, None, -7), (None, None, None),
    ]
    assert [str(r[0]) for r in db.sql("SELECT x / y FROM n ORDER BY k").collect()] == ["inf", "-inf", "nan", "None"]
    assert [r[0] for r in db.sql("SELECT a FROM n ORDER BY a").collect()] == [-(1 << 63), 7, (1 << 63) - 1, None]
    assert [r[0] for r in db.sql("SELECT a FROM n ORDER BY a DESC").collect()] == [None, (1 << 63) - 1, 7, -(1 << 63)]
    assert rows(db, "SELECT k FROM n WHERE k IN (1, NULL) OR k NOT IN (2, 3, 1) ORDER BY k") == [(1,), (4,)]
    assert rows(db, 'SELECT "k" AS "of ""k""" FROM public.n AS "N" WHERE "N".k = 1 /* c */ -- d') == [(1,)]


def test_queries(db):
    db.sql("CREATE TABLE o (id INT PRIMARY KEY, user_id INT, amount DOUBLE)")
    db.sql("INSERT INTO o (id, user_id, amount) VALUES (1, 1, 2.5), (2, 1, 4.0), (3, 3, 1.0), (4, NULL, 9.0), (5, 77, 3.0)")
    joined = "SELECT name, count(*) AS n, sum(amount) total FROM users u {} JOIN o ON u.id = o.user_id GROUP BY name HAVING count(*) > 0 ORDER BY name"
    assert rows(db, joined.format("")) == [("ann", 2, 6.5), ("cyd", 1, 1.0)]
    assert rows(db, joined.format("LEFT")) == [("ann", 2, 6.5), ("bob", 1, None), ("cyd", 1, 1.0)]
    assert rows(db, joined.format("RIGHT")) == [("ann", 2, 6.5), ("cyd", 1, 1.0), (None, 2, 12.0)]
    assert len(rows(db, "SELECT * FROM users u FULL OUTER JOIN o ON u.id = o.user_id")) == 6
    assert len(rows(db, "SELECT * FROM users, o")) == 15
    assert rows(db, "SELECT count(*), count(age), avg(age), min(name), max(age) + 1 FROM users") == [(3, 2, 40.0, "ann", 51)]
    assert rows(db, "SELECT count(*), sum(age) FROM users WHERE id > 100") == [(0, None)]
    assert rows(db, "SELECT DISTINCT user_id FROM o ORDER BY user_id LIMIT 2 OFFSET 1") == [(3,), (77,)]
    assert rows(db, "SELECT id % 2 AS odd, count(*) FROM o GROUP BY id % 2 ORDER BY odd DESC") == [(1, 3), (0, 2)]
    assert rows(db, "SELECT id FROM o OFFSET 5") == [] and rows(db, "SELECT id FROM o LIMIT 0") == []
    assert rows(db, "SELECT user_id FROM o GROUP BY user_id HAVING sum(amount) > 5.0 ORDER BY user_id") == [(1,), (None,)]
    assert rows(db, "SELECT sum(1), sum(1.0), count(1), count(TRUE) FROM o") == [(5, 5.0, 5, 5)]
    assert rows(db, "SELECT current_database(), current_schema(), version()")[0][:2] == ("default", "public")
    # beyond the grammar: Spark's parser over the same tables
    assert rows(
        db,
        "WITH big AS (SELECT id FROM public.users WHERE id > 1) SELECT upper(name) FROM Users WHERE id IN (SELECT id FROM big) ORDER BY name",
    ) == [("BOB",), ("CYD",)]
    assert rows(db, "SELECT id FROM users UNION SELECT user_id FROM o WHERE user_id > 5 ORDER BY id") == [(1,), (2,), (3,), (77,)]


def test_dropped_tables_leave_no_ghosts(db):
    db.sql("DROP TABLE users")
    with pytest.raises(BindError):
        db.sql("SELECT * FROM users")
    with pytest.raises(CatalogError):
        db.table("users")
    db.sql("CREATE TABLE users (id BIGINT, name TEXT)")
    assert rows(db, "SELECT * FROM users") == []
    db.sql("CREATE SCHEMA app")
    db.sql("CREATE TABLE app.members (id INT)")
    db.sql("INSERT INTO app.members (id) VALUES (1)")
    assert rows(db, "SELECT id FROM App.Members") == [(1,)]
    db.sql("DROP SCHEMA app")
    with pytest.raises(BindError):
        db.sql("SELECT * FROM app.members")
    db.sql("CREATE SCHEMA IF NOT EXISTS app")
    db.sql("CREATE TABLE app.members (id INT)")
    assert rows(db, "SELECT * FROM app.members") == []
    for ok in (
        "DROP TABLE IF EXISTS nope", "DROP SCHEMA IF EXISTS nope", "DROP VIEW IF EXISTS nope", "DROP INDEX IF EXISTS nope",
        "CREATE DATABASE IF NOT EXISTS d", "SET x = 1", "CREATE TABLE IF NOT EXISTS app.members (id INT)",
    ):
        assert db.sql(ok) is None


def test_columns_are_their_own(db):
    db.sql("ALTER TABLE users ADD COLUMN v TEXT")
    db.sql("UPDATE users SET v = 'old'")
    db.sql("ALTER TABLE users DROP COLUMN v")
    db.sql("ALTER TABLE users ADD v TEXT DEFAULT 'dd'")
    assert {r[0] for r in rows(db, "SELECT v FROM users")} == {"dd"}
    db.sql("UPDATE users SET v = NULL WHERE id = 1")
    db.sql("INSERT INTO users (id, name) VALUES (4, 'dan')")
    assert rows(db, "SELECT v FROM users ORDER BY id") == [(None,), ("dd",), ("dd",), ("dd",)]
    with pytest.raises(ConstraintViolation):
        db.sql("ALTER TABLE users ADD COLUMN w INT NOT NULL")
    with pytest.raises(BindError):
        db.sql("ALTER TABLE users DROP COLUMN id")


def test_definitions_are_part_of_transactions(db, spark, root):
    db.sql("BEGIN")
    db.sql("CREATE TABLE t (a INT)")
    db.sql("INSERT INTO t (a) VALUES (1)")
    db.sql("ALTER TABLE t ADD COLUMN b INT DEFAULT 5")
    assert rows(db, "SELECT a, b FROM t") == [(1, 5)]
    other = EngineSession(spark, root)
    with pytest.raises(BindError):
        other.sql("SELECT * FROM t")
    db.sql("ROLLBACK")
    with pytest.raises(BindError):
        db.sql("SELECT * FROM t")
    db.sql("BEGIN")
    db.sql("CREATE TABLE t (a INT)")
    db.sql("INSERT INTO t (a) VALUES (1)")
    db.sql("ALTER TABLE t ADD COLUMN b INT DEFAULT 5")
    db.sql("INSERT INTO t (a, b) VALUES (2, NULL)")
    db.sql("COMMIT")
    assert rows(other, "SELECT a, b FROM t ORDER BY a") == [(1, 5), (2, None)]
    db.sql("BEGIN")
    db.sql("INSERT INTO t (a) VALUES (3)")
    other.sql("DROP TABLE t")
    with pytest.raises(WriteConflict):
        db.sql("COMMIT")


def test_views_system_tables_and_statistics(db):
    db.sql("CREATE VIEW old AS SELECT id FROM users WHERE age >= 50")
    assert ids(db, "SELECT id FROM old") == [3]
    db.sql("CREATE OR REPLACE VIEW old AS SELECT id, upper(name) AS big FROM users WHERE age < 50")
    assert rows(db, "SELECT big FROM old") == [("ANN",)]
    db.sql("DROP VIEW old")
    with pytest.raises(BindError):
        db.sql("SELECT id FROM old")
    db.sql("CREATE UNIQUE INDEX by_name ON users (name)")
    assert [
        r[0] for r in rows(db, "SELECT name FROM sys_columns WHERE table_name = 'users' ORDER BY ordinal")
    ] == ["id", "name", "age", "note"]
    assert rows(db, "SELECT name, columns, unique_index FROM sys_indexes") == [("by_name", "name", True)]
    assert rows(db, "SELECT columns FROM sys_constraints WHERE table_name = 'users'") == [("id",)]
    assert ("public", "system_migrations") in rows(db, "SELECT schema_name, name FROM sys_tables")
    db.sql("INSERT INTO system_migrations (version, applied_at) VALUES ('202608210001', now())")
    assert rows(db, "SELECT version FROM system_migrations WHERE applied_at IS NOT NULL") == [("202608210001",)]
    assert {r["column"]: r.ndv for r in db.statistics("users").collect()}["age"] == 2
    assert db.statistics("users") is db.statistics("users")
    assert "Scan" in db.explain(db.sql("SELECT id FROM users"))
    assert db.fingerprint(db.table("users").where("id = 1")) == db.fingerprint(db.table("users").where("id = 1"))


def test_access(spark, root):
    seen = []

    def refuse(action, name):
        seen.append((action, name))
        if name.endswith(".closed") or action == "insert" and name.endswith(".t"):
            raise PermissionError(name)

    open_ = EngineSession(spark, root)
    open_.sql("CREATE TABLE t (a INT, secret TEXT)")
    open_.sql("INSERT INTO t (a, secret) VALUES (1, 's')")
    open_.sql("CREATE TABLE closed (a INT)")
    own = EngineSession(spark, root, refuse, {"t": {"Secret"}})
    for bad in ("INSERT INTO t (a) VALUES (1)", "SELECT * FROM CLOSED", "SELECT * FROM t, closed", "SELECT secret FROM t", "SELECT t.SECRET FROM Public.T", "SELECT * FROM t", "SELECT a FROM t WHERE secret = 's'",
                "SELECT upper(secret) FROM t", "SELECT a FROM t WHERE a IN (SELECT a FROM Closed)", "WITH x AS (SELECT secret FROM t) SELECT a FROM x", "DROP TABLE closed", "DELETE FROM closed"):
        with pytest.raises(PermissionError):
            own.sql(bad)
    assert own.table("t").columns == ["a"]
    assert rows(own, "SELECT a FROM T WHERE a = 1") == [(1,)]
    assert rows(own, "SELECT 'closed' AS x FROM t") == [("closed",)]


def test_log_of_many_commits(spark, root, monkeypatch):
    monkeypatch.setattr(markers, "CHECKPOINT", 4)
    monkeypatch.setattr(changelog, "CHECKPOINT", 4)
    monkeypatch.setattr(changelog, "PUBLISH", 3)
    db = EngineSession(spark, root)
    db.sql("CREATE TABLE t (a INT PRIMARY KEY, b TEXT DEFAULT 'x')")
    early = {}
    for i in range(8):
        db.sql(f"INSERT INTO t (a) VALUES ({i})")
        if i == 2:
            db.sql("DELETE FROM t WHERE a = 0")
        if i == 4:
            db.sql("ALTER TABLE t ADD COLUMN c INT DEFAULT 7")
        early[db.log.head()] = sorted(r.a for r in db.table("t").collect())
    new = EngineSession(spark, root)
    assert new.log.markers._checkpoints() and new.log.state().tables[new.catalog.table("t").id]["base"]
    assert len(new.log.state().tables[new.catalog.table("t").id]["folders"]) <= 3
    assert rows(new, "SELECT a, c FROM t ORDER BY a") == [(i, 7) for i in range(1, 8)]
    for at, want in early.items():
        assert sorted(r.a for r in new.table("t", at=at).collect()) == want
    with pytest.raises(ConstraintViolation):
        new.sql("INSERT INTO t (a) VALUES (1)")


def test_a_number_is_taken_once(spark, tmp_path):
    log = markers.Markers(spark, f"file://{tmp_path}/m k")
    log.append(1, {"a": "ä"})
    with pytest.raises(markers.Taken):
        log.append(1, {})
    assert log.read(1) == {"a": "ä"} and log.head() == 1 and not log.exists(2)
    log.save_checkpoint(1, {"s": 1})
    log.save_checkpoint(1, {"s": 2})
    assert log.checkpoint() == (1, {"s": 1}) and log.checkpoint(0) == (0, None)


def test_dataframes_go_in_and_joins_know_sizes(db, spark):
    big = spark.range(2000).select(F.col("id"), (F.col("id") % 3 + 1).alias("uid"))
    db.sql("CREATE TABLE visits (id BIGINT PRIMARY KEY, uid BIGINT)")
    assert db.insert("visits", big) == 2000
    db.attach("seen", big)
    for t in ("users", "visits"):
        db.statistics(t).collect()
    plan = db.sql("SELECT name, count(*) AS n FROM visits v JOIN users u ON v.uid = u.id GROUP BY name")
    assert sorted(map(tuple, plan.collect())) == [("ann", 667), ("bob", 667), ("cyd", 666)]
    assert "BroadcastHashJoin" in db.explain(plan)
    assert rows(db, "SELECT count(*) FROM seen WHERE uid = 2") == [(667,)]


def test_typed_definitions(db):
    ddl.apply(db, ddl.CreateTable("typed", [("a", "BIGINT"), ("b", "TEXT NOT NULL")], ["a"]))
    ddl.apply(db, ddl.CreateIndex("by_b", "typed", ["b"], unique=True))
    ddl.apply(db, ddl.AddColumn("typed", "c", "INT DEFAULT 3"))
    assert db.catalog.table("typed").indexes == {"by_b": (["b"], True)} and db.table("typed").columns == ["a", "b", "c"]
    ddl.apply(db, ddl.DropColumn("typed", "c"))
    ddl.apply(db, ddl.DropIndex("by_b"))
    ddl.apply(db, ddl.DropTable("typed"))
    for change in (ddl.RenameTable("users", "people"), ddl.RenameColumn("users", "a", "b"), ddl.AlterColumn("users", "age", "TEXT")):
        with pytest.raises(ddl.Unsupported):
            ddl.apply(db, change)
