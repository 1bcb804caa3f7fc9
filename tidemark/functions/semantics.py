"""Column expressions whose null, overflow and division rules differ from Spark's ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def _long(c) -> Column:
    return _col(c).cast("long")


def _bound(high: Column) -> Column:
    return F.when(high, F.lit(MAX)).otherwise(F.lit(MIN).cast("long"))


def sat_add(a, b) -> Column:
    """a + b held within 64 bits; null if either is null."""
    a, b = _long(a), _long(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), _bound(a > 0)))


def sat_sub(a, b) -> Column:
    """a - b held within 64 bits."""
    a, b = _long(a), _long(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_subtract(a, b), _bound(a >= 0)))


def sat_mul(a, b) -> Column:
    """a * b held within 64 bits."""
    a, b = _long(a), _long(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_multiply(a, b), _bound((a < 0) == (b < 0))))


def int_div(a, b) -> Column:
    """a / b cut towards zero; null for a zero divisor; the least integer over -1 is held at the greatest."""
    a, b = _long(a), _long(b)
    quotient = F.call_function("div", F.when(b != -1, a).otherwise(F.lit(0).cast("long")), F.nullif(b, F.lit(0).cast("long")))
    return F.when(b == -1, sat_sub(F.lit(0), a)).otherwise(quotient)


def int_mod(a, b) -> Column:
    """Remainder with the sign of a; null for a zero divisor."""
    a, b = _long(a), _long(b)
    return F.when(b == -1, F.when(a.isNotNull(), F.lit(0).cast("long"))).otherwise(a % F.nullif(b, F.lit(0).cast("long")))


def ieee_div(a, b) -> Column:
    """a / b of doubles with infinities and NaN for a zero divisor."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    negative = (a < 0) != b.cast("string").startswith("-")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def ieee_mod(a, b) -> Column:
    """Remainder of doubles; NaN for a zero divisor."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b != 0, b))


def negate(a, integer: bool = False) -> Column:
    """-a; an integer's is held within 64 bits, so the least one gives the greatest."""
    return sat_sub(F.lit(0), a) if integer else -_col(a)


def ascending(c) -> Column:
    """Ascending order puts nulls last."""
    return _col(c).asc_nulls_last()


def descending(c) -> Column:
    """Descending order puts nulls first: the reverse of ascending as a whole."""
    return _col(c).desc_nulls_first()


def in_list(c, values: list, negated: bool = False) -> Column:
    """[NOT] IN: null for a null probe, and for no match beside a null member."""
    out = _col(c).isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    if None in values:
        out = F.when(out, F.lit(True))
    out = F.when(_col(c).isNotNull(), out)
    return ~out if negated else out


def backoff(attempt, initial_ms: int = 100, multiplier: float = 2.0, max_ms: int = 30_000) -> Column:
    """Exponential delay before an attempt, in ms; the exponent is held at 16, the delay at ``max_ms``."""
    exponent = F.least(F.greatest(_col(attempt) - 1, F.lit(0)), F.lit(16))
    return F.least(F.floor(F.lit(initial_ms) * F.pow(F.lit(float(multiplier)), exponent)).cast("long"), F.lit(max_ms).cast("long"))


#: Seconds before the n-th redelivery in a consumer group.
GROUP_DELAYS = [0, 1, 5, 30, 60]


def group_backoff(attempt) -> Column:
    """Delay by table, in seconds; attempts past its end keep the last delay."""
    at = F.least(F.greatest(_col(attempt), F.lit(1)), F.lit(len(GROUP_DELAYS))).cast("int")
    return F.element_at(F.array(*map(F.lit, GROUP_DELAYS)), at).cast("long")


def within(path, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; segments are never cut."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (_col(path) == prefix) | _col(path).startswith(prefix + "/")
