"""Table statistics and the estimates that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def table_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, row_count, null_count, ndv, min, max) for each column.

    min and max are text, of numbers, texts, dates and timestamps only.  Each column is grouped by its values, with partial sums before
    its one shuffle, from a scan of that column alone; rows are never expanded.  ``approximate`` takes one pass over
    all columns and sketches of distinct values, for tables whose rows are costly to compute.
    """
    fields = df.schema.fields
    text = lambda c, f: c.cast("string") if isinstance(f.dataType, _ORDERED) else F.lit(None).cast("string")
    if approximate:
        aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            aggs += [
                F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}"), text(F.min(c), f).alias(f"lo{i}"),
                text(F.max(c), f).alias(f"hi{i}"),
            ]
        parts = [
            F.struct(F.lit(f.name).alias("column"), F.col("rows").alias("row_count"), (F.col("rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"d{i}").alias("ndv"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, f in enumerate(fields)
        ]
        return df.agg(*aggs).select(F.inline(F.array(*parts)))
    out = None
    for f in fields:
        values = df.select(F.col(f"`{f.name}`").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        nulls = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
        one = values.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), nulls.alias("null_count"), F.count("v").alias("ndv"),
            text(F.min("v"), f).alias("min"), text(F.max("v"), f).alias("max"),
        )
        one = one.select(F.lit(f.name).alias("column"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def null_fraction(null_count, row_count) -> Column:
    return F.when(row_count > 0, null_count / row_count).otherwise(0.0)


def eq_selectivity(ndv) -> Column:
    """Share of rows equal to a value: one of the distinct values; a half where nothing is known."""
    return F.when(ndv > 0, 1.0 / ndv).otherwise(0.5)


def range_selectivity(low, high, value, below: bool = True) -> Column:
    """Share of rows under (or over) a value, linear between the column's bounds."""
    share = F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return share if below else 1.0 - share


def not_selectivity(a) -> Column:
    """Share of rows that a condition of this share leaves: <> beside =, IS NOT NULL beside IS NULL."""
    return 1.0 - a


def in_selectivity(ndv, members: int) -> Column:
    """Share of rows equal to one of so many values."""
    return F.least(F.lit(1.0), eq_selectivity(ndv) * members)


def sort_key(value: Column, kind: str) -> Column:
    """A number in the order of a text, date or timestamp, for linear estimates; of a text its first six bytes count."""
    if kind == "date":
        return F.unix_date(value.cast("date")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if kind == "text":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return value.cast("double")


def and_selectivity(a, b) -> Column:
    return a * b


def or_selectivity(a, b) -> Column:
    return a + b - a * b


def join_rows(left, right, ndv_left, ndv_right) -> Column:
    """Rows of an equality join: the product over the larger number of distinct keys."""
    return left * right / F.greatest(ndv_left, ndv_right, F.lit(1))


def group_rows(rows, *ndvs) -> Column:
    """Groups: the product of the keys' distinct counts, no more than rows."""
    product = F.lit(1.0)
    for n in ndvs:
        product = product * n
    return F.least(rows.cast("double"), product)


def build_side(left_rows: Column, right_rows: Column, left_first: bool = True) -> Column:
    """The side that a hash join builds: the smaller; of equal ones that of the lower table id."""
    tie = F.lit("left" if left_first else "right")
    return F.when(left_rows < right_rows, "left").when(right_rows < left_rows, "right").otherwise(tie)
