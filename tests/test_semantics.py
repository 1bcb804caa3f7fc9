import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import semantics as S
from tidemark.functions.crc32c import crc32c
from tidemark.operators import stats
from tidemark.plans import syntax as X
from tidemark.plans.validator import BindError, arithmetic_type, comparable

MAX, MIN = S.MAX, S.MIN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "f,a,b,want",
    [
        (S.sat_add, MAX, 1, MAX), (S.sat_add, MIN, -1, MIN), (S.sat_add, 1, 2, 3), (S.sat_sub, MIN, 1, MIN), (S.sat_sub, 0, MIN, MAX),
        (S.sat_mul, MAX, -2, MIN), (S.sat_mul, MIN, -1, MAX), (S.int_div, 7, -2, -3), (S.int_div, 7, 0, None), (S.int_div, MIN, -1, MAX),
        (S.int_mod, -7, 3, -1), (S.int_mod, 7, 0, None), (S.int_mod, MIN, -1, 0),
    ],
)
def test_integers(spark, f, a, b, want):
    assert one(spark, f(F.lit(a), F.lit(b))) == want
    assert one(spark, f(F.lit(None).cast("long"), F.lit(b))) is None


@pytest.mark.parametrize(
    "a,b,want", [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (1.0, -0.0, -math.inf), (0.0, 0.0, None), (3.0, 2.0, 1.5)],
)
def test_ieee_division(spark, a, b, want):
    got = one(spark, S.ieee_div(F.lit(a), F.lit(b)))
    assert math.isnan(got) if want is None else got == want
    assert math.isnan(one(spark, S.ieee_mod(F.lit(a), F.lit(0.0))))


def test_in_list(spark):
    assert one(spark, S.in_list(F.lit(1), [1, None])) is True
    assert one(spark, S.in_list(F.lit(2), [1, None])) is None
    assert one(spark, S.in_list(F.lit(None).cast("int"), [1])) is None
    assert one(spark, S.in_list(F.lit(2), [1], negated=True)) is True


def test_crc32c_known_values():
    assert crc32c([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, 0xC1D04330]


def test_negation_is_held_in_64_bits(spark):
    assert one(spark, S.negate(F.lit(MIN), integer=True)) == MAX and one(spark, S.negate(F.lit(2.5))) == -2.5


def test_validator():
    assert arithmetic_type(T.IntegerType(), T.LongType()) == T.LongType()
    for pair in ((T.DoubleType(), T.LongType()), (T.StringType(), T.StringType())):
        with pytest.raises(BindError):
            arithmetic_type(*pair)
    with pytest.raises(BindError):
        comparable(T.StringType(), T.LongType())


def test_grammar():
    e = lambda text: X.Parser(text).expression()
    assert e("a OR b AND NOT c = 1 + 2 * -d") == X.Binary(
        "or", X.Name(("a",)),
        X.Binary(
            "and", X.Name(("b",)),
            X.Unary(
                "not",
                X.Binary("=", X.Name(("c",)), X.Binary("+", X.Literal(1), X.Binary("*", X.Literal(2), X.Unary("-", X.Name(("d",)))))),
            ),
        ),
    )
    assert e("x /* a 'b' */ IS NOT NULL -- c\n") == X.IsNull(X.Name(("x",)), True)
    assert e("'it''s' ") == X.Literal("it's") and e(r"'a\nb\'c\q'") == X.Literal("a\nb'cq") and e('"a ""b"""') == X.Name(('a "b"',))
    assert e("-9223372036854775808") == X.Literal(MIN) and e("1.5e3") == X.Literal(1500.0) and e("a-1") == X.Binary(
        "-", X.Name(("a",)), X.Literal(1),
    )
    assert e("a NOT IN (1, NULL)") == X.In(X.Name(("a",)), (X.Literal(1), X.Literal(None)), True)
    with pytest.raises(BindError):
        e("9223372036854775808")
    for beyond in (
        "SELECT a FROM (SELECT 1)", "SELECT a FROM t UNION SELECT b FROM u", "SELECT sum(a) OVER () FROM t",
        "WITH x AS (SELECT 1) SELECT 1", "SELECT a FROM", "SELECT CASE WHEN a THEN 1 END FROM t",
    ):
        with pytest.raises(X.Beyond):
            X.Parser(beyond).select()


def test_estimates(spark):
    keys = [one(spark, stats.sort_key(F.lit(x), "text")) for x in ("", "A", "Apple", "apple", "b", "zzzzzzzzz")]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    share = lambda *a, **k: one(spark, stats.range_selectivity(*map(F.lit, a), **k))
    assert share(0.0, 10.0, 2.5) == 0.25 and share(
        0.0, 10.0, 2.5, below=False,
    ) == 0.75 and share(0.0, 10.0, 99.0) == 1.0 and share(0.0, 10.0, -9.0) == 0.0 and share(5.0, 5.0, 5.0) == 0.5
    assert one(spark, stats.eq_selectivity(F.lit(0))) == 0.5 and one(
        spark, stats.in_selectivity(F.lit(4), 3),
    ) == 0.75 and one(spark, stats.in_selectivity(F.lit(2), 3)) == 1.0
    assert one(spark, stats.sort_key(F.lit("1970-01-03"), "date")) == 2.0
    got = {
        (r["column"], r.row_count, r.null_count, r.min, r.max) for r in stats.table_stats(
            spark.createDataFrame([(1, "b"), (None, "a"), (3, None)], "i int, `t x` string"), approximate=True,
        ).collect()
    }
    assert got == {("i", 3, 1, "1", "3"), ("t x", 3, 1, "a", "b")}
    assert got == {
        (r["column"], r.row_count, r.null_count, r.min, r.max) for r in stats.table_stats(
            spark.createDataFrame([(1, "b"), (None, "a"), (3, None)], "i int, `t x` string")
        ).collect()
    }
    assert [(r.row_count, r.ndv, r.min) for r in stats.table_stats(spark.createDataFrame([], "i int")).collect()] == [(0, 0, None)]
