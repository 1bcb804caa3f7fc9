"""Rules that reject a statement before Spark sees it."""

from __future__ import annotations

from pyspark.sql import types as T


class BindError(Exception):
    pass


_INTEGERS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def arithmetic_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Operands have one numeric type, or are integers of two widths, which widen to 64 bits."""
    if isinstance(a, _INTEGERS) and isinstance(b, _INTEGERS):
        return a if type(a) is type(b) else T.LongType()
    if type(a) is type(b) and isinstance(a, T.NumericType):
        return a
    raise BindError(f"no arithmetic between {a.simpleString()} and {b.simpleString()}")


def comparable(a: T.DataType, b: T.DataType) -> None:
    if type(a) is not type(b) and not (isinstance(a, _INTEGERS) and isinstance(b, _INTEGERS)):
        raise BindError(f"{a.simpleString()} and {b.simpleString()} do not compare")
