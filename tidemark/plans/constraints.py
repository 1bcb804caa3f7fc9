"""NOT NULL, primary-key and unique checks as queries that return the rows at fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintViolation(Exception):
    pass


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])) if columns else df.limit(0)


def duplicate_keys(df: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """(keys, n) held by several rows.  A unique index exempts keys with any null, a primary key those with nulls alone."""
    nulls = [F.col(k).isNull() for k in keys]
    exempt = reduce(lambda a, b: a | b, nulls) if unique else reduce(lambda a, b: a & b, nulls)
    return df.where(~exempt).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_keys(rows: DataFrame, keys_of: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Keys among those of ``keys_of`` that several of ``rows`` hold; the rest of the table is only looked up, not grouped."""
    wanted = keys_of.select(*(F.col(f"`{k}`").alias(f"w{i}") for i, k in enumerate(keys))).distinct()
    match = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"w{i}")) for i, k in enumerate(keys)])
    return duplicate_keys(rows.join(wanted, match, "left_semi"), keys, unique)
