"""Registered queries of the engine's operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import semantics as S
from tidemark.functions.crc32c import partition_of
from tidemark.functions.crc32c import table as crc_table
from tidemark.operators import consumers as C
from tidemark.operators import journal as J
from tidemark.operators import overlay as O
from tidemark.operators import stats as T
from tidemark.plans import catalog, constraints
from tidemark.plans.markers import workspace
from tidemark.plans.session import EngineSession
from tidemark.sources.journal import Journal
from tidemark.sources.tables import merge, sequence_faults, table
from tidemark.streaming import flows
from tidemark.streaming.consumers import Group, GroupPolicy, Retries, Subscription

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


# ---- scans, projection, predicates, arithmetic


@query("""SELECT r.r_name AS region, count(*) AS n_customers, CAST(sum(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_balance
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_acctbal > 0 GROUP BY r.r_name HAVING count(*) > 1 ORDER BY n_customers DESC NULLS FIRST, region LIMIT 5""")
def acceptance(spark, d):
    """Join, filter, group, having, order and limit in one: the flagship."""
    c = table(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 0")
    j = c.join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left",
    ).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    g = j.groupBy(F.col("r_name").alias("region")).agg(
        F.count(F.lit(1)).alias("n_customers"), (F.sum(_money("c_acctbal")).cast("double") / F.count(F.lit(1))).alias("avg_balance"),
    )
    return g.where("n_customers > 1").orderBy(S.descending("n_customers"), S.ascending("region")).limit(5)


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_project(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, o_orderkey + 1 AS next_key FROM orders")
def project_expr(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), S.sat_add("o_orderkey", F.lit(1)).alias("next_key"),
    )


@query("SELECT * FROM nation")
def wildcard(spark, d):
    return table(spark, d, "nation")


@query("SELECT n_nationkey, n_name FROM nation WHERE false")
def empty_scan(spark, d):
    return table(spark, d, "nation", "n_nationkey", "n_name").limit(0)


@query(
    "SELECT * FROM (VALUES (1, 10, 1200, true), (2, 10, 800, true), (3, 20, 1500, false), (4, NULL, NULL, NULL)) v(id, department_id, "
    "salary, active) WHERE salary >= 1000"
)
def in_memory_source(spark, d):
    return spark.createDataFrame(
        [(1, 10, 1200, True), (2, 10, 800, True), (3, 20, 1500, False), (4, None, None, None)],
        "id int, department_id int, salary int, active boolean",
    ).where("salary >= 1000")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F' AND o_orderkey <= 5000")
def filter_cmp(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 1000 AND o_orderstatus <> 'F' AND o_orderkey <= 5000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 7 OR o_orderkey BETWEEN 100 AND 200")
def index_lookup(spark, d):
    """Point and range lookups: the predicates reach the scan's row-group statistics."""
    return table(spark, d, "orders", "o_orderkey").where("o_orderkey = 7 OR (o_orderkey >= 100 AND o_orderkey <= 200)")


_NV = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS u FROM events"


def _nulls(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value")
    return e.select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("u"),
    )


@query(f"SELECT event_id, v FROM ({_NV}) WHERE v > 10 AND NOT (u < 50) OR v IS NULL AND u > 100")
def filter_3vl(spark, d):
    return _nulls(spark, d).where("v > 10 AND NOT (u < 50) OR v IS NULL AND u > 100").select("event_id", "v")


@query(f"SELECT event_id, v > 10 AND u < 50 AS both, v > 10 OR u < 50 AS either, NOT (v > 10) AS neither FROM ({_NV})")
def three_valued_logic(spark, d):
    return _nulls(spark, d).selectExpr("event_id", "v > 10 AND u < 50 AS both", "v > 10 OR u < 50 AS either", "NOT (v > 10) AS neither")


@query(f"SELECT event_id, v IS NULL AS is_null, u IS NOT NULL AS has_user FROM ({_NV})")
def is_null(spark, d):
    return _nulls(spark, d).select("event_id", F.col("v").isNull().alias("is_null"), F.col("u").isNotNull().alias("has_user"))


@query(f"SELECT event_id, u IN (1, 2, NULL) AS found, u IN (3, 4) AS plain FROM ({_NV})")
def in_list(spark, d):
    return _nulls(spark, d).select("event_id", S.in_list("u", [1, 2, None]).alias("found"), S.in_list("u", [3, 4]).alias("plain"))


@query(f"SELECT event_id, u NOT IN (1, NULL) AS missing FROM ({_NV}) WHERE u NOT IN (1, 2, 3)")
def not_in_null(spark, d):
    n = _nulls(spark, d)
    return n.where(S.in_list("u", [1, 2, 3], negated=True)).select("event_id", S.in_list("u", [1, None], negated=True).alias("missing"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (0 - l_orderkey) // (l_linenumber % 3) END AS q, "
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (0 - l_orderkey) % (l_linenumber % 3) END AS r FROM lineitem"
)
def int_div_mod_zero(spark, d):
    """Division cuts towards zero and a zero divisor gives null."""
    b = F.col("l_linenumber") % 3
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", S.int_div(-F.col("l_orderkey"), b).alias("q"), S.int_mod(-F.col("l_orderkey"), b).alias("r"),
    )


_CLAMP = "CAST(greatest(least({}, 9223372036854775807::HUGEINT), (-9223372036854775808)::HUGEINT) AS BIGINT)"


@query("SELECT p_partkey, " + ", ".join(f"{_CLAMP.format(e)} AS {n}" for e, n in (("9223372036854775000::HUGEINT + p_partkey", "plus"), ("(-9223372036854775000)::HUGEINT - p_partkey", "minus"), ("9000000000000000::HUGEINT * (p_partkey - 1000)", "times"))) + " FROM part")
def saturating_arith(spark, d):
    k, big = F.col("p_partkey"), 9223372036854775000
    return table(spark, d, "part", "p_partkey").select(
        "p_partkey", S.sat_add(F.lit(big), k).alias("plus"), S.sat_sub(F.lit(-big), k).alias("minus"),
        S.sat_mul(F.lit(9000000000000000), k - 1000).alias("times"),
    )


@query(
    "SELECT p_partkey, CASE WHEN s = 0 THEN CASE WHEN k = 0 THEN 'NaN' WHEN k > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE 'finite' END "
    "AS kind, CASE WHEN s <> 0 THEN k / s END AS quotient, CASE WHEN s <> 0 THEN k - s * trunc(k / s) + 0.0 END AS rest, s = 0 AS "
    "rest_is_nan FROM (SELECT p_partkey, CAST(p_partkey % 5 - 2 AS DOUBLE) AS k, CAST(p_size % 3 AS DOUBLE) AS s FROM part)"
)
def ieee_double(spark, d):
    q = S.ieee_div(F.col("p_partkey") % 5 - 2, F.col("p_size") % 3)
    kind = F.when(q.cast("string").isin("NaN", "Infinity", "-Infinity"), q.cast("string")).otherwise("finite")
    m = S.ieee_mod(F.col("p_partkey") % 5 - 2, F.col("p_size") % 3)
    finite = F.col("p_size") % 3 != 0
    return table(spark, d, "part", "p_partkey", "p_size").select(
        "p_partkey", kind.alias("kind"), F.when(finite, q).alias("quotient"), F.when(finite, m + F.lit(0.0)).alias("rest"),
        F.isnan(m).alias("rest_is_nan"),
    )


@query("SELECT l_orderkey, -l_quantity AS minus_quantity, -l_linenumber AS minus_line FROM lineitem")
def unary_neg(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", S.negate("l_quantity").alias("minus_quantity"), S.negate("l_linenumber", integer=True).alias("minus_line"),
    )


@query(
    "SELECT event_id, 'a\\b' || event_type AS tagged, current_database() IS NOT NULL AS has_db, version() IS NOT NULL AS has_version, "
    "current_schema() IS NOT NULL AS has_schema, now() IS NOT NULL AS has_now FROM events"
)
def literals_and_session_functions(spark, d):
    e = table(spark, d, "events", "event_id", "event_type")
    return e.select(
        "event_id", F.concat(F.lit("a\\b"), "event_type").alias("tagged"), F.current_database().isNotNull().alias("has_db"),
        F.version().isNotNull().alias("has_version"), F.current_schema().isNotNull().alias("has_schema"),
        F.current_timestamp().isNotNull().alias("has_now"),
    )


# ---- joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"),
    ).select("o_orderkey", "c_name", "o_totalprice")


def _sides(spark, d):
    """All orders and customers; keys are shifted, so that every outer join has unmatched rows on both sides."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn(
        "ok", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey")),
    )
    return o, table(spark, d, "customer", "c_custkey", "c_name")


def _outer(kind: str) -> str:
    return f"SELECT o_orderkey, c_custkey, c_name FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE -o_custkey END AS ok FROM orders) o {kind} JOIN customer c ON ok = c_custkey"


@query(_outer("LEFT"))
def join_left(spark, d):
    o, c = _sides(spark, d)
    return o.join(c, F.col("ok") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey", "c_name")


@query(_outer("RIGHT"))
def join_right(spark, d):
    o, c = _sides(spark, d)
    return o.join(c, F.col("ok") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey", "c_name")


@query(_outer("FULL"))
def join_full(spark, d):
    o, c = _sides(spark, d)
    return o.join(c, F.col("ok") == F.col("c_custkey"), "full").select("o_orderkey", "c_custkey", "c_name")


@query(
    "SELECT a.event_id, n.n_name FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 30 END AS k FROM events) a "
    "LEFT JOIN nation n ON a.k = n.n_nationkey"
)
def join_null_keys(spark, d):
    """Null keys match nothing, and a 64-bit key meets a 32-bit one by value."""
    e = table(spark, d, "events", "event_id", "user_id").select(
        "event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 30).alias("k"),
    )
    return e.join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey"), "left").select("event_id", "n_name")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return table(spark, d, "region", "r_name").crossJoin(table(spark, d, "nation", "n_name"))


@query(
    "SELECT n_name, count(*) AS n_orders FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP "
    "BY n_name"
)
def join_three_tables(spark, d):
    j = table(spark, d, "orders", "o_custkey").join(
        table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"),
    ).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE false) ON o_custkey = c_custkey")
def join_empty_side(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(
        table(spark, d, "customer", "c_custkey", "c_name").limit(0), F.col("o_custkey") == F.col("c_custkey"), "left",
    ).select("o_orderkey", "c_name")


# ---- aggregation


@query(
    "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) "
    "AS DOUBLE) / count(*) AS mean FROM lineitem"
)
def agg_global(spark, d):
    return table(spark, d, "lineitem", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_money("l_quantity")).cast("double").alias("total"),
        (F.sum(_money("l_quantity")).cast("double") / F.count(F.lit(1))).alias("mean"),
    )


@query("SELECT count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM lineitem WHERE false")
def agg_global_empty(spark, d):
    return table(spark, d, "lineitem", "l_quantity").where("false").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.avg("l_quantity").alias("mean"),
    )


@query(f"SELECT u, count(*) AS n, count(v) AS n_values, CAST(sum(u) AS BIGINT) AS sum_u FROM ({_NV}) GROUP BY u")
def count_nullable(spark, d):
    """Nulls are a group of their own, apart from zero."""
    return _nulls(spark, d).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_values"), F.sum("u").alias("sum_u"))


@query(
    "SELECT l_linenumber % 2 AS odd, l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue "
    "FROM lineitem GROUP BY l_linenumber % 2, l_returnflag"
)
def group_by_expr(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 2).alias("odd"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_money("l_extendedprice")).cast("double").alias("revenue"),
    )


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def having(spark, d):
    return table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 1000 AND count(*) >= 5")
def having_not_selected(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"),
    ).where("m > 1000 AND n >= 5").select("o_custkey")


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 0")
def having_global(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


@query(
    "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day, CAST(sum(o_custkey) AS "
    "BIGINT) + 1 AS nested FROM orders GROUP BY o_orderpriority"
)
def min_max(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.min("o_orderdate").alias("first_day"),
        (F.sum("o_custkey") + 1).alias("nested"),
    )


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus").distinct()


@query("SELECT c_nationkey FROM customer GROUP BY c_nationkey")
def group_without_aggregate(spark, d):
    return table(spark, d, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.lit(1)).select("c_nationkey")


# ---- order and limit


@query(f"SELECT event_id, u FROM ({_NV}) ORDER BY u DESC NULLS FIRST, event_id")
def order_nulls_desc(spark, d):
    return _nulls(spark, d).orderBy(S.descending("u"), S.ascending("event_id")).select("event_id", "u")


@query(f"SELECT event_id, u FROM ({_NV}) ORDER BY u ASC NULLS LAST, event_id DESC")
def order_nulls(spark, d):
    return _nulls(spark, d).orderBy(S.ascending("u"), S.descending("event_id")).select("event_id", "u")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(10).limit(20)


@query("SELECT s_suppkey FROM supplier LIMIT 0")
def limit_zero(spark, d):
    return table(spark, d, "supplier", "s_suppkey").limit(0)


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def top_k(spark, d):
    return table(spark, d, "supplier", "s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 90")
def offset_alone(spark, d):
    return table(spark, d, "supplier", "s_suppkey").orderBy("s_suppkey").offset(90)


# ---- statistics and estimates


def _stat(c: str, text: str = "") -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS ndv, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders"


@query(" UNION ALL ".join(_stat(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def table_stats(spark, d):
    return T.table_stats(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


_BELOW = "greatest(0.0, least(1.0, (5000.0 - min(o_orderkey)) / (max(o_orderkey) - min(o_orderkey))))"
_EQ = "1.0 / count(DISTINCT o_orderstatus)"
_DAY = "epoch(TIMESTAMP '1996-01-01') - epoch(min(o_orderdate))"


@query(f"""SELECT round({_EQ}, 9) AS eq, round(1.0 - {_EQ}, 9) AS ne, round({_BELOW}, 9) AS below, round(1.0 - {_BELOW}, 9) AS above,
round({_EQ} * {_BELOW}, 9) AS both, round({_EQ} + {_BELOW} - {_EQ} * {_BELOW}, 9) AS either, round(least(1.0, 2 * {_EQ}), 9) AS in_two,
round((count(*) - count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END)) / CAST(count(*) AS DOUBLE), 9) AS nulls,
round(greatest(0.0, least(1.0, ({_DAY}) / (epoch(max(o_orderdate)) - epoch(min(o_orderdate))))), 6) AS before_day FROM orders""")
def est_selectivity(spark, d):
    o = table(spark, d, "orders").withColumn("maybe", F.when(F.col("o_orderkey") % 7 != 0, 1))
    n, low, high = F.count(F.lit(1)), F.min("o_orderkey").cast("double"), F.max("o_orderkey").cast("double")
    s = o.agg(
        n.alias("n"), F.countDistinct("o_orderstatus").alias("ndv"), low.alias("lo"), high.alias("hi"),
        (n - F.count("maybe")).alias("nulls"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"),
    )
    eq, below = T.eq_selectivity(F.col("ndv")), T.range_selectivity(F.col("lo"), F.col("hi"), F.lit(5000.0))
    day = T.range_selectivity(
        T.sort_key(F.col("first"), "timestamp"), T.sort_key(F.col("last"), "timestamp"),
        T.sort_key(F.lit("1996-01-01").cast("timestamp_ntz"), "timestamp"),
    )
    found = {
        "eq": eq, "ne": T.not_selectivity(eq), "below": below, "above": T.range_selectivity(F.col("lo"), F.col("hi"), F.lit(5000.0), below=False), "both": T.and_selectivity(eq, below),
        "either": T.or_selectivity(eq, below), "in_two": T.in_selectivity(F.col("ndv"), 2), "nulls": T.null_fraction(F.col("nulls"), F.col("n")),
    }
    return s.select(*(F.round(c, 9).alias(k) for k, c in found.items()), F.round(day, 6).alias("before_day"))


@query(
    "SELECT CASE WHEN c.n < o.n THEN 'right' ELSE 'left' END AS built FROM (SELECT count(*) AS n FROM orders) o, (SELECT count(*) AS n "
    "FROM customer) c"
)
def build_side(spark, d):
    """The smaller estimated side builds; EngineSession broadcasts it where statistics show that it fits."""
    o, c = (table(spark, d, t).agg(F.count(F.lit(1)).alias(t)) for t in ("orders", "customer"))
    return o.crossJoin(c).select(T.build_side(F.col("orders"), F.col("customer")).alias("built"))


@query(
    "SELECT round(CAST(o.n * c.n AS DOUBLE) / greatest(o.k, c.k), 6) AS rows_join, least(CAST(o.n AS DOUBLE), CAST(o.k AS DOUBLE)) AS "
    "rows_group FROM (SELECT count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders) o, (SELECT count(*) AS n, count(DISTINCT "
    "c_custkey) AS k FROM customer) c"
)
def est_join_rows(spark, d):
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("on"), F.countDistinct("o_custkey").alias("ok"))
    c = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("cn"), F.countDistinct("c_custkey").alias("ck"))
    return o.crossJoin(c).select(
        F.round(T.join_rows(F.col("on"), F.col("cn"), F.col("ok"), F.col("ck")), 6).alias("rows_join"),
        T.group_rows(F.col("on"), F.col("ok")).alias("rows_group"),
    )


# ---- change log, constraints, transactions

_LOG = "SELECT event_id + 1 AS seq, user_id AS row_id, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events"


def _log(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    return e.select(
        (F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("row_id"), "value",
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
    )


def _as_of(where: str = "true") -> str:
    return f"SELECT row_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY seq DESC) AS k FROM ({_LOG}) WHERE {where}) WHERE k = 1 AND op <> 'delete'"


@query(_as_of("seq <= 600"))
def snapshot_asof(spark, d):
    return J.snapshot(_log(spark, d), 600).select("row_id", "seq", "value")


@query(_as_of())
def snapshot_head(spark, d):
    return J.snapshot(_log(spark, d)).select("row_id", "seq", "value")


@query(f"SELECT DISTINCT row_id FROM ({_LOG}) WHERE seq > 600 AND row_id IN (SELECT row_id FROM ({_LOG}) WHERE seq <= 600)")
def write_conflicts(spark, d):
    """Rows of a write set that others changed after its snapshot."""
    log = _log(spark, d)
    return log.where("seq > 600").select("row_id").join(log.where("seq <= 600"), "row_id", "left_semi").distinct()


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def pk_violations(spark, d):
    return constraints.duplicate_keys(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT u, count(*) AS n FROM ({_NV}) WHERE u IS NOT NULL GROUP BY u HAVING count(*) > 1")
def unique_violations(spark, d):
    return constraints.duplicate_keys(_nulls(spark, d), ["u"], unique=True)


@query(f"SELECT event_id FROM ({_NV}) WHERE v IS NULL")
def not_null_violations(spark, d):
    return constraints.null_rows(_nulls(spark, d), ["v"]).select("event_id")


@query(
    "SELECT table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_index) - 1 AS BIGINT) AS ordinal "
    "FROM duckdb_columns() WHERE table_name IN ('nation', 'region', 'orders')"
)
def catalog_columns(spark, d):
    return catalog.columns_of({t: table(spark, d, t) for t in ("nation", "region", "orders")})


@query("SELECT n_name AS name FROM nation WHERE n_name > 'B' AND contains(n_name, 'A') ORDER BY name LIMIT 5")
def catalog_page(spark, d):
    return catalog.page(table(spark, d, "nation").select(F.col("n_name").alias("name")), "B", 5, "A")


# ---- overlay and journal

_EV = "SELECT event_id + 1 AS seq, ts, event_type || '/' || CAST(user_id AS VARCHAR) AS path, event_type AS kind, event_type = 'error' AND event_id % 2 = 0 AS deleted, CAST(value AS VARCHAR) AS payload, event_id, user_id, (event_id % 8) AS part FROM events"
_BASE = "SELECT DISTINCT event_type || '/' || CAST(user_id % 40 AS VARCHAR) AS path, 'sealed' AS payload FROM events"


def _shaped(e: DataFrame) -> DataFrame:
    return e.select(
        (F.col("event_id") + 1).alias("seq"), "ts", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("deleted"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload"),
        "event_id", "user_id", (F.col("event_id") % 8).alias("part"),
    )


def _events(spark, d):
    return _shaped(table(spark, d, "events", "event_id", "ts", "event_type", "user_id"))


_EV = _EV.replace("CAST(value AS VARCHAR) AS payload", "'p' || CAST(event_id AS VARCHAR) AS payload")


def _base(spark, d):
    e = table(spark, d, "events", "event_type", "user_id")
    return e.select(
        F.concat_ws("/", "event_type", (F.col("user_id") % 40).cast("string")).alias("path"), F.lit("sealed").alias("payload"),
    ).distinct()


_RESOLVED = f"""SELECT coalesce(b.path, o.path) AS path, CASE WHEN o.path IS NULL THEN b.payload ELSE o.payload END AS payload, b.path IS NOT NULL AS base_present, o.path IS NOT NULL AS overlay_present, o.seq AS layer_seq
FROM ({_BASE}) b FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM ({_EV})) WHERE k = 1) o ON b.path = o.path WHERE NOT coalesce(o.deleted, false)"""


@query(_RESOLVED)
def overlay_resolve(spark, d):
    return O.resolve(_base(spark, d), _events(spark, d).select("path", "seq", "deleted", "payload"))


@query(f"SELECT path FROM ({_RESOLVED}) WHERE path = 'error' OR path LIKE 'error/%'")
def list_keys(spark, d):
    return O.list_keys(_base(spark, d), _events(spark, d).select("path", "seq", "deleted", "payload"), "error")


@query(f"SELECT seq, path FROM ({_EV}) WHERE path = 'view/1' OR path LIKE 'view/1/%'")
def prefix_scan(spark, d):
    """A prefix matches whole segments: view/1 but not view/10."""
    return _events(spark, d).where(S.within("path", "view/1")).select("seq", "path")


@query(
    f"SELECT seq, trigger_id, target FROM ({_EV}) e JOIN (VALUES ('t1', 'purchase', 'purchase', 'out-a'), ('t2', 'error', 'error/1', "
    "'out-b'), ('t3', 'purchase', 'purchase/7', 'out-c')) t(trigger_id, on_kind, path_prefix, target) ON e.kind = t.on_kind AND (e.path "
    "= t.path_prefix OR starts_with(e.path, t.path_prefix || '/'))"
)
def trigger_forward(spark, d):
    triggers = spark.createDataFrame(
        [("t1", "purchase", "purchase", "out-a"), ("t2", "error", "error/1", "out-b"), ("t3", "purchase", "purchase/7", "out-c")],
        "trigger_id string, on_kind string, path_prefix string, target string",
    )
    return flows.forward(_events(spark, d), triggers).select("seq", "trigger_id", "target")


@query(f"SELECT seq, kind FROM ({_EV}) ORDER BY seq DESC LIMIT 500")
def recent_events(spark, d):
    return _events(spark, d).select("seq", "kind").orderBy(F.desc("seq")).limit(500)


@query(f"SELECT seq, min(seq) OVER w AS original_seq, seq > min(seq) OVER w AS replay FROM ({_EV}) WINDOW w AS (PARTITION BY kind, user_id)")
def idempotent_dedupe(spark, d):
    e = _events(spark, d).select(F.col("kind").alias("producer_id"), F.col("user_id").alias("idem_key"), "seq")
    return J.idempotent(e).select("seq", "original_seq", "replay")


@query(f"SELECT kind, user_id, min(seq) AS seq FROM ({_EV}) GROUP BY kind, user_id")
def apply_once(spark, d):
    e = _events(spark, d).select(F.struct("kind", "user_id").alias("event_id"), "seq")
    return J.once(e).select("event_id.kind", "event_id.user_id", "seq")


_HOLES = f"SELECT seq FROM ({_EV}) WHERE seq % 97 <> 0 UNION ALL SELECT seq FROM ({_EV}) WHERE seq % 501 = 0"


@query(
    f"SELECT seq, 'duplicate' AS fault FROM ({_HOLES}) GROUP BY seq HAVING count(*) > 1 UNION ALL SELECT seq, 'gap' FROM (SELECT seq, "
    f"lag(seq) OVER (ORDER BY seq) AS p FROM (SELECT DISTINCT seq FROM ({_HOLES}))) WHERE seq - p > 1"
)
def seq_gap_check(spark, d):
    e = _events(spark, d).select("seq")
    return sequence_faults(e.where("seq % 97 <> 0").union(e.where("seq % 501 = 0")), "seq")


@query(f"SELECT seq, part FROM ({_EV}) ORDER BY seq")
def merge_order(spark, d):
    e = _events(spark, d).select("seq", "part")
    return merge([e.where(F.col("part") == p).withColumn("place", F.col("seq")) for p in range(8)], "seq", "place").drop("place")


def _crc32c_sql(text: str) -> str:
    """CRC-32C of ASCII text, folded byte by byte through the table of its polynomial."""
    entries = ", ".join(str(int(x)) for x in crc_table())
    step = f"xor(([{entries}])[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: CAST({step} AS BIGINT)), 4294967295::BIGINT)"


@query(f"SELECT seq, {_crc32c_sql('path')} % 8 AS partition FROM ({_EV})")
def partition_route(spark, d):
    return _events(spark, d).select("seq", partition_of("path", 8).alias("partition"))


# ---- consumers

_DELIVERED = f"SELECT 'c' || CAST(part AS VARCHAR) AS consumer, seq FROM ({_EV}) WHERE seq > 100"
_OPEN = f"SELECT consumer, seq FROM ({_DELIVERED}) WHERE seq % 211 = 0"


def _delivered(spark, d):
    return _events(spark, d).where("seq > 100").select(F.concat(F.lit("c"), F.col("part").cast("string")).alias("consumer"), "seq")


def _offsets(spark):
    return spark.range(0, 8).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("consumer"), F.lit(100).cast("long").alias("offset"),
    )


@query(f"SELECT o.consumer, greatest(100, coalesce(h.hole - 1, d.high, 100)) AS \"offset\" FROM (SELECT 'c' || CAST(range AS VARCHAR) AS consumer FROM range(8)) o LEFT JOIN (SELECT consumer, min(seq) AS hole FROM ({_OPEN}) GROUP BY consumer) h ON o.consumer = h.consumer LEFT JOIN (SELECT consumer, max(seq) AS high FROM ({_DELIVERED}) GROUP BY consumer) d ON o.consumer = d.consumer")
def contiguous_offset(spark, d):
    sent = _delivered(spark, d)
    return C.contiguous_offset(_offsets(spark), sent.where("seq % 211 <> 0"), sent)


@query(
    "SELECT consumer, seq, seq % 3 AS attempt, CASE WHEN seq % 5 = 0 THEN 'unknown' WHEN seq % 3 < 2 THEN 'stale' ELSE 'acked' END AS "
    f"outcome FROM ({_DELIVERED})"
)
def ack_batch(spark, d):
    sent = _delivered(spark, d)
    return C.classify_acks(sent.withColumn("attempt", F.col("seq") % 3), sent.where("seq % 5 <> 0").withColumn("attempt", F.lit(2)))


@query(
    "SELECT range AS attempt, CAST(least(floor(100 * pow(2, least(greatest(range - 1, 0), 16))), 30000) AS BIGINT) AS delay_ms FROM "
    "range(1, 25)"
)
def backoff_schedule(spark, d):
    return spark.range(1, 25).select(F.col("id").alias("attempt"), S.backoff("id").alias("delay_ms"))


@query(
    "SELECT consumer, seq, seq % 7 AS attempt, '_system/dlq/' || consumer || '/' || CAST(seq AS VARCHAR) AS dlq_path FROM "
    f"({_DELIVERED}) WHERE seq % 7 >= 5"
)
def dlq_split(spark, d):
    return C.dead_letters(_delivered(spark, d).withColumn("attempt", F.col("seq") % 7))


@query(f"SELECT 'c' || CAST(range AS VARCHAR) AS consumer, 100::BIGINT AS \"offset\", (SELECT max(seq) FROM ({_EV})) AS head, (SELECT max(seq) FROM ({_EV})) - 100 AS lag FROM range(8)")
def consumer_lag(spark, d):
    return C.lag(_offsets(spark), _events(spark, d))


@query(f"SELECT seq, path FROM ({_EV}) WHERE seq >= 300 ORDER BY seq LIMIT 64")
def replay_window(spark, d):
    return J.replay(_events(spark, d), 300, 64).select("seq", "path")


@query("SELECT p.range AS part, ['a', 'b', 'm'][CAST(p.range % 3 AS INTEGER) + 1] AS member FROM range(8) p")
def group_assignment(spark, d):
    members = spark.createDataFrame([("m",), ("a",), ("b",)], "member string")
    return C.assign(_events(spark, d).select("part").distinct(), members)


@query(f"SELECT part, min(seq) - 1 AS earliest, max(seq) AS latest FROM ({_EV}) GROUP BY part")
def group_offsets(spark, d):
    e = _events(spark, d)
    return C.group_start(e, "earliest").withColumnRenamed("start", "earliest").join(
        C.group_start(e, "latest").withColumnRenamed("start", "latest"), "part",
    )


@query("SELECT range AS attempt, [0, 1, 5, 30, 60][CAST(least(range, 5) AS INTEGER)]::BIGINT AS delay_s FROM range(1, 9)")
def group_backoff(spark, d):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), S.group_backoff("id").alias("delay_s"))


@query(
    "SELECT member, count(*) AS n_parts, min(part) AS first_part, max(latest) AS last_seq FROM (SELECT part, ['a', 'b', 'm'][CAST(part "
    f"% 3 AS INTEGER) + 1] AS member, max(seq) AS latest FROM ({_EV}) GROUP BY part) GROUP BY member ORDER BY member"
)
def group_describe(spark, d):
    g = group_assignment(spark, d).join(C.group_start(_events(spark, d), "latest"), "part")
    return g.groupBy("member").agg(
        F.count(F.lit(1)).alias("n_parts"), F.min("part").alias("first_part"), F.max("start").alias("last_seq"),
    ).orderBy("member")


@query(f"SELECT kind AS consumer, max(seq) AS committed FROM ({_EV}) WHERE seq % 3 = 0 GROUP BY kind")
def commit_offsets(spark, d):
    return O.latest(
        _events(spark, d).where("seq % 3 = 0").select(F.col("kind").alias("consumer"), "seq"), "consumer",
    ).select("consumer", F.col("seq").alias("committed"))


# ---- retention and compaction

_SEG = f"SELECT part, segment, max(seq) AS end_seq, CAST(sum(length(path) + length(payload)) AS BIGINT) AS bytes FROM (SELECT *, event_id // 500 AS segment FROM ({_EV})) GROUP BY part, segment"


def _segments(spark, d):
    e = _events(spark, d).withColumn("segment", S.int_div("event_id", F.lit(500)))
    return e.groupBy("part", "segment").agg(F.max("seq").alias("end_seq"), F.sum(F.length("path") + F.length("payload")).alias("bytes"))


@query(
    f"SELECT min(pin) AS floor FROM (SELECT min(seq) AS pin FROM ({_EV}) WHERE kind = 'error' UNION ALL SELECT 900::BIGINT UNION ALL "
    "SELECT NULL)"
)
def retention_watermark(spark, d):
    e = _events(spark, d)
    return J.retention_floor(
        e.where("kind = 'error'").agg(F.min("seq").alias("pin")), spark.range(900, 901).select(F.col("id").alias("pin")),
        spark.sql("SELECT CAST(NULL AS BIGINT) AS pin"),
    )


@query(
    f"SELECT max(seq) AS trim_to FROM ({_EV}) WHERE seq < (SELECT min(seq) FROM ({_EV}) WHERE ts >= (SELECT ts FROM ({_EV}) WHERE seq = "
    "400))"
)
def age_trim(spark, d):
    e = _events(spark, d)
    cutoff = e.where("seq = 400").agg(F.max("ts").alias("cutoff"))
    return J.age_trim(e.join(F.broadcast(cutoff)), F.col("cutoff"))


_SEG1 = _SEG.replace("SELECT part, segment", "SELECT segment").replace("GROUP BY part, segment", "GROUP BY segment")


@query(f"SELECT max(end_seq) AS trim_to FROM (SELECT *, sum(bytes) OVER (ORDER BY segment DESC) AS kept FROM ({_SEG1})) WHERE kept > 50000")
def bytes_trim(spark, d):
    s = _segments(spark, d).groupBy("segment").agg(F.max("end_seq").alias("end_seq"), F.sum("bytes").alias("bytes"))
    return J.bytes_trim(s, 50000)


@query(
    f"SELECT least((SELECT max(seq) FROM ({_EV}) WHERE seq < 400), (SELECT max(end_seq) FROM (SELECT *, sum(bytes) OVER (ORDER BY "
    f"segment DESC) AS kept FROM ({_SEG1})) WHERE kept > 50000)) AS trim_to"
)
def combined_policy(spark, d):
    return age_trim(spark, d).withColumnRenamed("trim_to", "a").crossJoin(bytes_trim(spark, d).withColumnRenamed("trim_to", "b")).select(F.least("a", "b").alias("trim_to"))


@query(
    "SELECT part, max(n) AS n_segments, CAST(max(total) AS BIGINT) AS total_bytes, max(end_seq) AS end_seq FROM (SELECT *, row_number() "
    f"OVER w AS n, sum(bytes) OVER w AS total FROM ({_SEG}) WINDOW w AS (PARTITION BY part ORDER BY segment)) WHERE total <= 5000 GROUP "
    "BY part HAVING max(n) >= 2 ORDER BY part LIMIT 1"
)
def compaction_candidate(spark, d):
    return J.compaction_candidate(_segments(spark, d), 2, 5000)


@query(f"SELECT part, segment FROM ({_SEG}) WHERE end_seq <= 4000")
def trim_segments(spark, d):
    """Whole segments that end before the floor, which is the sequence 4000."""
    return J.trim(_segments(spark, d), 4000, 4000).select("part", "segment")


@query(f"{_as_of()}")
def snapshot_recovery(spark, d):
    """State at a snapshot with the later events over it is the state at the head."""
    log = _log(spark, d)
    first = J.snapshot(log, 500)
    return J.snapshot(first.unionByName(log.where("seq > 500"))).select("row_id", "seq", "value")


# ---- statements through a session over a log of its own


def _session(spark, d, *tables: str) -> EngineSession:
    """A new log, with whole tables attached for reading."""
    db = EngineSession(spark, workspace(spark, "session"))
    for t in tables:
        db.attach(t, table(spark, d, t))
    return db


_FLAGSHIP = """SELECT r.r_name AS region, count(*) AS n_customers, CAST(sum(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_balance
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_acctbal > 0.0 GROUP BY r.r_name HAVING count(*) > 1 ORDER BY n_customers DESC, region LIMIT 5"""


@query(_FLAGSHIP.replace("DESC", "DESC NULLS FIRST"))
def session_query(spark, d):
    """The flagship as SQL text, parsed and bound by the engine."""
    return _session(spark, d, "customer", "nation", "region").sql(_FLAGSHIP)


@query("SELECT p_partkey, " + ", ".join(f"{_CLAMP.format(e)} AS {n}" for e, n in (("9223372036854775000::HUGEINT + p_partkey", "plus"), ("(-9223372036854775000)::HUGEINT - p_partkey", "minus"), ("9000000000000000::HUGEINT * (p_partkey - 1000)", "times"))) + ", CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE -p_partkey // (p_partkey % 3) END AS quotient FROM part")
def session_arithmetic(spark, d):
    """SQL text has the engine's arithmetic: held at 64 bits, null for a zero divisor."""
    return _session(spark, d, "part").sql("SELECT p_partkey, 9223372036854775000 + p_partkey AS plus, -9223372036854775000 - p_partkey AS minus, 9000000000000000 * (p_partkey - 1000) AS times, -p_partkey / (p_partkey % 3) AS quotient FROM part")


@query(f"SELECT event_id, u FROM ({_NV}) WHERE u IN (1, 2, 3) OR u IS NULL ORDER BY u DESC NULLS FIRST, event_id OFFSET 7")
def session_order(spark, d):
    db = _session(spark, d)
    db.attach("events", _nulls(spark, d))
    return db.sql("SELECT event_id, u FROM events WHERE u IN (1, 2, 3) OR u IS NULL ORDER BY u DESC, event_id OFFSET 7")


def _customers(spark, d) -> EngineSession:
    db = _session(spark, d)
    db.sql("CREATE TABLE customer (id BIGINT PRIMARY KEY, name TEXT NOT NULL, balance DOUBLE, segment TEXT, note TEXT DEFAULT 'none')")
    db.insert(
        "customer",
        table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"),
    )
    return db


@query(
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'none' AS note FROM customer UNION ALL SELECT -1, 'new', -2.5, 'a,b' "
    "UNION ALL SELECT -2, 'newer', NULL, 'none'"
)
def session_insert(spark, d):
    db = _customers(spark, d)
    db.sql("INSERT INTO customer (id, name, balance, note) VALUES (-1, 'new', -2.5, 'a,b')")
    db.sql("INSERT INTO customer (id, name) VALUES (-2, 'newer')")
    return db.sql("SELECT id, name, balance, note FROM customer")


@query(
    "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 THEN 'was ' || "
    "'low' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'none' END AS note FROM customer"
)
def session_update(spark, d):
    db = _customers(spark, d)
    db.sql("UPDATE customer SET note = NULL WHERE segment = 'BUILDING'")
    db.sql("UPDATE customer SET balance = 0.0, note = 'was low' WHERE balance < 0.0")
    return db.sql("SELECT id, balance, note FROM customer")


@query("SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal > 5000 AND c_mktsegment <> 'BUILDING')")
def session_delete(spark, d):
    db = _customers(spark, d)
    db.sql("DELETE FROM customer WHERE balance > 5000.0 AND segment <> 'BUILDING'")
    return db.sql("SELECT id FROM customer")


@query(
    "SELECT 'open' AS seen_in, c_custkey AS id, 'mine' AS note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'other', "
    "c_custkey, 'none' FROM customer UNION ALL SELECT 'after', c_custkey, 'mine' FROM customer WHERE c_custkey % 2 = 0"
)
def session_transaction(spark, d):
    """An open transaction reads its own writes, another session does not, until they are committed; a rolled-back one leaves nothing."""
    db = _customers(spark, d)
    other = EngineSession(spark, db.log.root)
    db.sql("BEGIN")
    db.sql("DELETE FROM customer")
    db.sql("ROLLBACK")
    db.sql("BEGIN")
    db.sql("DELETE FROM customer WHERE id % 2 = 1")
    db.sql("UPDATE customer SET note = 'mine'")
    seen = lambda s, name: s.sql("SELECT id, note FROM customer").select(F.lit(name).alias("seen_in"), "id", "note")
    mine, before = seen(db, "open"), seen(other, "other")
    db.sql("COMMIT")
    return mine.unionByName(before).unionByName(seen(other, "after"))


@query("SELECT c_custkey AS id, 'first' AS version FROM customer UNION ALL SELECT c_custkey, 'head' FROM customer WHERE c_acctbal >= 0")
def session_snapshot(spark, d):
    """A read as of an earlier sequence beside one of the head."""
    db = _customers(spark, d)
    at = db.log.head()
    db.sql("DELETE FROM customer WHERE balance < 0.0")
    first, head = db.table("customer", at=at), db.table("customer")
    return first.select("id", F.lit("first").alias("version")).unionByName(head.select("id", F.lit("head").alias("version")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 3 END AS rank FROM customer")
def session_alter(spark, d):
    """A column that is dropped and added again starts with its default."""
    db = _customers(spark, d)
    db.sql("ALTER TABLE customer ADD COLUMN rank INT")
    db.sql("UPDATE customer SET rank = 99")
    db.sql("ALTER TABLE customer DROP COLUMN rank")
    db.sql("ALTER TABLE customer ADD COLUMN rank INT DEFAULT 3")
    db.sql("UPDATE customer SET rank = 7 WHERE id % 2 = 0")
    return db.sql("SELECT id, rank FROM customer")


@query(
    "SELECT * FROM (VALUES ('column', 'customer', 'id', 0), ('column', 'customer', 'name', 1), ('column', 'customer', 'balance', 2), "
    "('column', 'customer', 'segment', 3), ('column', 'customer', 'note', 4), ('index', 'customer', 'by_name', NULL), ('view', 'rich', "
    "'rich', NULL)) v(kind, table_name, name, ordinal)"
)
def session_catalog(spark, d):
    """The system tables after definitions."""
    db = _customers(spark, d)
    db.sql("CREATE UNIQUE INDEX by_name ON customer (name)")
    db.sql("CREATE VIEW rich AS SELECT id FROM customer WHERE balance > 9000.0")
    db.sql("CREATE TABLE gone (a INT)")
    db.sql("DROP TABLE gone")
    columns = db.sql("SELECT table_name, name, ordinal FROM sys_columns WHERE table_name <> 'system_migrations'").select(F.lit("column").alias("kind"), "*")
    indexes = db.sql("SELECT table_name, name FROM sys_indexes").select(
        F.lit("index").alias("kind"), "*", F.lit(None).cast("int").alias("ordinal"),
    )
    views = db.sql("SELECT name FROM sys_views").select(
        F.lit("view").alias("kind"), F.col("name").alias("table_name"), "name", F.lit(None).cast("int").alias("ordinal"),
    )
    return columns.unionByName(indexes).unionByName(views)


@query("SELECT * FROM (VALUES (1, 'b_table'), (1, 'c_table'), (2, 'd_table')) v(page, name)")
def session_pages(spark, d):
    """Names of tables in pages of two, from a cursor on and with a part of the name."""
    db = _session(spark, d)
    for n in ("d_table", "b_table", "other", "c_table", "a_table"):
        db.sql(f"CREATE TABLE {n} (a INT)")
    first = db.objects("table", "a_table", 2, "_table")
    second = db.objects("table", "c_table", 2, "_table")
    return first.select(F.lit(1).alias("page"), "name").unionByName(second.select(F.lit(2).alias("page"), "name"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000")
def session_view(spark, d):
    db = _customers(spark, d)
    db.sql("CREATE VIEW rich AS SELECT id, balance FROM customer WHERE balance > 0.0")
    db.sql("CREATE OR REPLACE VIEW rich AS SELECT id FROM customer WHERE balance > 9000.0")
    return db.sql("SELECT id FROM rich")


@query(
    "SELECT * FROM (VALUES ('primary key', 'refused'), ('not null', 'refused'), ('unique', 'refused'), ('null key', 'taken'), "
    "('conflict', 'refused'), ('null comparison', 'refused'), ('types', 'refused')) v(rule, outcome)"
)
def session_constraints(spark, d):
    """What the engine refuses, over the whole customer table."""
    from tidemark.plans.changelog import WriteConflict
    from tidemark.plans.validator import BindError

    db = _customers(spark, d)
    db.sql("CREATE UNIQUE INDEX by_note ON customer (name, note)")

    def conflict():
        late = EngineSession(spark, db.log.root)
        late.sql("BEGIN")
        late.sql("UPDATE customer SET note = 'late' WHERE id = 1")
        db.sql("UPDATE customer SET note = 'early' WHERE id = 1")
        late.sql("COMMIT")

    name = db.table("customer").where("id = 2").first()["name"]
    tries = {
        "primary key": lambda: db.sql("INSERT INTO customer (id, name) VALUES (1, 'x')"), "not null": lambda: db.sql("UPDATE customer SET name = NULL WHERE id = 3"),
        "unique": lambda: db.sql(f"INSERT INTO customer (id, name) VALUES (-5, '{name}')"), "null key": lambda: db.sql(f"INSERT INTO customer (id, name, note) VALUES (-6, '{name}', NULL)"),
        "conflict": conflict, "null comparison": lambda: db.sql("SELECT id FROM customer WHERE note = NULL"), "types": lambda: db.sql("SELECT balance * id FROM customer"),
    }
    out = []
    for rule, attempt in tries.items():
        try:
            attempt()
            out.append((rule, "taken"))
        except (constraints.ConstraintViolation, WriteConflict, BindError):
            out.append((rule, "refused"))
    return spark.createDataFrame(out, "rule string, outcome string")


@query(
    "SELECT * FROM (VALUES ('column', 'refused'), ('star', 'refused'), ('other case', 'refused'), ('nested', 'refused'), ('write', "
    "'refused'), ('allowed', 'taken')) v(access, outcome)"
)
def session_access(spark, d):
    """Revoked columns and grants hold however a name is written."""

    def grants(action: str, name: str) -> None:
        if action != "select" or name.endswith(".nation"):
            raise PermissionError(name)

    db = EngineSession(spark, workspace(spark, "session"), None, {"customer": {"c_acctbal"}})
    db.authorize = grants
    for t in ("customer", "nation"):
        db.attach(t, table(spark, d, t))
    tries = {
        "column": "SELECT c_acctbal FROM customer", "star": "SELECT * FROM customer",
        "other case": "SELECT c_custkey FROM Nation, Customer",
        "nested": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM NATION)", "write": "CREATE TABLE t (a INT)",
        "allowed": "SELECT c_custkey FROM CUSTOMER",
    }
    out = []
    for access, text in tries.items():
        try:
            db.sql(text)
            out.append((access, "taken"))
        except PermissionError:
            out.append((access, "refused"))
    return spark.createDataFrame(out, "access string, outcome string")


@query(
    " UNION ALL ".join(
        _stat(c).replace(
            "FROM orders", "FROM (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0)",
        ) for c in ("id", "name", "segment")
    )
)
def session_statistics(spark, d):
    """Statistics follow the commits: rows that were deleted do not count."""
    db = _customers(spark, d)
    db.statistics("customer").collect()
    db.sql("DELETE FROM customer WHERE id % 5 = 0")
    return db.statistics("customer").where("column in ('id', 'name', 'segment')")


# ---- a journal of its own, filled with all events


@query(f"SELECT seq, {_crc32c_sql('path')} % 8 AS part, path, kind FROM ({_EV})")
def journal_append(spark, d):
    """Sequences without a hole in the order of events, dealt to partitions by CRC-32C."""
    j = Journal(spark, workspace(spark, "journal"), 8)
    j.append(
        _events(spark, d).select("seq", "path", "payload", "kind", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")), 0, "seq",
    )
    return j.checked().select("seq", "part", "path", "kind")


@query(f"SELECT seq, path FROM ({_EV}) WHERE seq > 200")
def journal_compaction(spark, d):
    """Compaction and a trim up to 200 (events 1 to 200 are an append of their own) leave the other entries as they were."""
    j = Journal(spark, workspace(spark, "journal"), 4)
    rows = _events(spark, d).select("seq", "path", "payload")
    j.append(rows.where("seq <= 200"), 0, "seq")
    j.append(rows.where("seq > 200 AND seq <= 600"), 0, "seq")
    j.append(rows.where("seq > 600"), 0, "seq")
    j.publish()
    j.trim(200, j.floor(0))
    while j.compact(2, 1 << 40):
        pass
    return j.read().select("seq", "path")


@query(_RESOLVED.replace("'sealed' AS payload FROM events", "'sealed' AS payload FROM events WHERE false"))
def journal_paths(spark, d):
    """Live paths of the journal: read from a published snapshot and the events after it."""
    j = Journal(spark, workspace(spark, "journal"), 4)
    e = _events(spark, d)
    rows = e.select(
        "seq", "path", F.when(~F.col("deleted"), F.col("payload")).alias("payload"),
        F.when(F.col("deleted"), "delete").otherwise("put").alias("operation"),
    )
    j.append(rows.where("seq <= 500"), 0, "seq")
    j.publish()
    j.append(rows.where("seq > 500"), 0, "seq")
    return j.resolve()


@query(f"SELECT path, min(seq) OVER w AS first_seq, seq > min(seq) OVER w AS replay FROM ({_EV}) WINDOW w AS (PARTITION BY kind, user_id)")
def journal_idempotent(spark, d):
    """Entries that repeat a producer's key resolve to the first one; original numbers are carried in the payload."""
    j = Journal(spark, workspace(spark, "journal"), 4)
    e = _events(spark, d)
    out = j.append(
        e.select(
            "seq", "path", F.col("seq").cast("string").alias("payload"), F.col("kind").alias("producer_id"),
            F.col("user_id").cast("string").alias("idem_key"),
        ),
        0, "seq",
    )
    kept = j.read().select("seq", F.col("payload").cast("long").alias("first_seq"))
    return out.join(kept, "seq").select("path", "first_seq", "replay")


@query(f"SELECT 'c' || CAST(part AS VARCHAR) AS consumer, seq, path, seq % 7 AS attempts FROM ({_EV}) WHERE seq % 7 >= 5 AND seq % 2 = 0")
def dead_letter_list(spark, d):
    """Dead letters are envelopes at paths of their own; discarded ones (odd sequences) are hidden by tombstones."""
    j = Journal(spark, workspace(spark, "journal"), 4)
    e = _events(spark, d).where("seq % 7 >= 5").withColumn("consumer", F.concat(F.lit("c"), F.col("part").cast("string")))
    own = F.concat_ws("/", F.lit("_system/dlq"), "consumer", F.col("seq").cast("string"))
    body = F.to_json(F.struct("seq", "path", (F.col("seq") % 7).alias("attempts")))
    j.append(e.select("seq", own.alias("path"), body.alias("payload"), F.lit("dead_letter").alias("kind")), 0, "seq")
    j.append(e.where("seq % 2 = 1").select("seq", own.alias("path"), F.lit("delete").alias("operation")), 0, "seq")
    return j.dead().select("consumer", "seq", "path", "attempts")


# ---- streams and consumers, run to their end


def _stream(spark, d, fields: str) -> DataFrame:
    """All events as a stream of the fields of ``_events``."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    return _shaped(raw).selectExpr(*fields.split(", "))


@query(f"""SELECT path, count(*) AS n FROM (SELECT path FROM ({_EV}) WHERE path LIKE 'purchase/%'
UNION ALL SELECT '_streams/out/' || path FROM ({_EV}) WHERE path = 'purchase/7') GROUP BY path""")
def stream_ingest(spark, d):
    """A stream's entries within its scope, once each though the stream runs twice from nothing, and what a trigger forwards."""
    j, home = Journal(spark, workspace(spark, "journal"), 4), workspace(spark, "stream")
    triggers = spark.createDataFrame(
        [("t", "purchase", "purchase/7", "out")], "trigger_id string, on_kind string, path_prefix string, target string",
    )
    for k in range(2):
        source = _stream(spark, d, "path, payload, kind")
        flows.ingest(source, flows.StreamSpec("s", "purchase"), j, f"{home}/{k}", triggers).awaitTermination()
    return j.read().groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT path, max(seq) AS seq FROM ({_EV}) GROUP BY path")
def stream_overlay(spark, d):
    """The latest patch of each path, kept by a streaming sink."""
    home = workspace(spark, "stream")
    flows.overlay_sink(_stream(spark, d, "path, seq, payload, deleted"), f"{home}/overlay", f"{home}/checkpoint").awaitTermination()
    return flows.read_overlay(spark, f"{home}/overlay").select("path", "seq")


@query(f"""SELECT part, seq, 'retry' AS state, 2::BIGINT AS attempts FROM ({_EV}) WHERE seq % 3 = 0
UNION ALL SELECT part, seq, 'acked', CASE WHEN seq % 3 = 0 THEN 2::BIGINT ELSE 1 END FROM ({_EV}) WHERE seq % 2 = 0""")
def stream_delivery(spark, d):
    """Deliveries, refusals (every third) and acknowledgements (every second) through map state by partition."""
    home, store = workspace(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    acts = _stream(spark, d, "part, seq").select("*", F.explode(F.array(*map(F.lit, ("event", "nack", "ack")))).alias("kind")).where("kind = 'event' or kind = 'nack' and seq % 3 = 0 or kind = 'ack' and seq % 2 = 0")
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = flows.deliver(acts).writeStream.format("parquet").option("path", f"{home}/out").option(
            "checkpointLocation", f"{home}/checkpoint",
        )
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.parquet(f"{home}/out").select("part", "seq", "state", "attempts")


_FIRST = f"SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM ({_EV}) WHERE path LIKE 'view/%'"


@query(f"""SELECT k AS step, seq, CASE k WHEN 1 THEN 'acked' WHEN 2 THEN 'retry, dead' ELSE 'stale, acked' END AS outcome FROM ({_FIRST}) WHERE k <= 3
UNION ALL SELECT 4, seq, 'dead letter' FROM ({_FIRST}) WHERE k = 2 UNION ALL SELECT 5, seq, 'offset' FROM ({_FIRST}) WHERE k = 3""")
def subscription_run(spark, d):
    """A subscription that another driver takes over: an acknowledged entry, one that dies, one acknowledged late; its dead letter and offset."""
    j = Journal(spark, workspace(spark, "journal"), 4)
    j.append(_events(spark, d).select("seq", "path", "payload"), 0, "seq")
    open_ = lambda: Subscription(j, "reader", "view", Retries(max_attempts=2))
    s, out = open_(), []
    seq, attempt = s.consume(0)
    out.append((1, seq, s.ack(seq, attempt)))
    seq, _ = s.consume(10)
    fate = [s.fail(seq, 10)]
    s.consume(200)
    out.append((2, seq, ", ".join([*fate, s.fail(seq, 200)])))
    s = open_()
    seq, _ = s.consume(300)
    s.fail(seq, 300)
    again = s.consume(500)
    out.append((3, seq, ", ".join([s.ack(seq, 1), s.ack(*again)])))
    rows = spark.createDataFrame(out, "step long, seq long, outcome string")
    dead = s.dead().select(F.lit(4).cast("long").alias("step"), "seq", F.lit("dead letter").alias("outcome"))
    return rows.unionByName(dead).unionByName(spark.createDataFrame([(5, s.offset, "offset")], "step long, seq long, outcome string"))


_ROUTED = f"SELECT seq, {_crc32c_sql('path')} % 2 AS part FROM ({_EV})"


@query(f"""SELECT part, seq, CASE WHEN part = 0 AND k = 1 THEN 'retry, dead' WHEN part = 0 THEN 'acked' ELSE 'given back' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) AS k FROM ({_ROUTED})) WHERE k <= 3 AND part = 0 OR k <= 2 AND part = 1""")
def group_run(spark, d):
    """Two members of a group: one acknowledges out of order beside an entry that dies, the other leaves and its entries go to the first."""
    j = Journal(spark, workspace(spark, "journal"), 2)
    j.append(_events(spark, d).select("seq", "path", "payload"), 0, "seq")
    g, out = Group(j, "readers", policy=GroupPolicy(max_attempts=2)), []
    g.join("a", 0)
    generation = g.join("b", 0)
    (_, first, _), (_, second, _), (_, third, _) = g.consume("a", 3, 0)
    theirs = g.consume("b", 2, 0)
    out += [(0, third, g.ack("a", generation, 0, third)), (0, second, g.ack("a", generation, 0, second))]
    states = [g.fail("a", generation, 0, first, 0)]
    g.consume("a", 1, 5)
    states.append(g.fail("a", generation, 0, first, 10))
    out.append((0, first, ", ".join(states)))
    assert g.offset(0) == third
    g.leave("b")
    back = g.consume("a", 2, 20)
    out += [(p, s, "given back") for p, s, _ in back if (p, s) in {(p, s) for p, s, _ in theirs}]
    return spark.createDataFrame(out, "part long, seq long, outcome string")


@query(
    "SELECT * FROM (VALUES ('same plan, same fingerprint', true), ('another plan, another fingerprint', true), ('explain shows the "
    "scan', true)) v(rule, holds)"
)
def session_plans(spark, d):
    db = _session(spark, d, "orders")
    one, two, other = (db.sql(f"SELECT o_orderkey FROM orders WHERE o_custkey = {k}") for k in (1, 1, 2))
    holds = [
        ("same plan, same fingerprint", db.fingerprint(one) == db.fingerprint(two)), ("another plan, another fingerprint", db.fingerprint(one) != db.fingerprint(other)),
        ("explain shows the scan", "parquet" in db.explain(one)),
    ]
    return spark.createDataFrame(holds, "rule string, holds boolean")
