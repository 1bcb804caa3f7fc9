"""Reading tables, merging ordered logs, generating events and appending to logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.markers import workspace


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's scan; columns and later filters reach the Parquet reader."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


class OutOfOrder(Exception):
    """A partition log repeats a sequence or goes backwards."""


def merge(logs: list[DataFrame], seq: str = "sequence", place: str | None = None) -> DataFrame:
    """Partition logs in one global order.

    With ``place``, the column of an entry's place in its own log, a sequence that is repeated anywhere, or lower than the one
    before it in its log, is an error.
    """
    out = None
    for i, log in enumerate(logs):
        log = log.withColumn("_log", F.lit(i))
        out = log if out is None else out.unionByName(log)
    if place is not None:
        bad = out.groupBy(seq).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(seq).alias("at"))
        before = F.lag(seq).over(Window.partitionBy("_log", F.col(place) - F.pmod(place, F.lit(_RUN))).orderBy(place))
        # Runs of places are looked at side by side; where two runs meet, their ends are compared
        inside = out.withColumn("_b", before).where(F.col(seq) <= F.col("_b")).select(F.col(seq).alias("at"))
        runs = out.groupBy("_log", F.floor(F.col(place) / _RUN).alias("r")).agg(
            F.min_by(seq, place).alias("lo"), F.max_by(seq, place).alias("hi"),
        )
        meets = runs.withColumn(
            "_b", F.lag("hi").over(Window.partitionBy("_log").orderBy("r")),
        ).where("lo <= _b").select(F.col("lo").alias("at"))
        first = bad.union(inside).union(meets).limit(1).collect()
        if first:
            raise OutOfOrder(f"sequence {first[0][0]}")
    return out.drop("_log").orderBy(seq)


def sequence_faults(log: DataFrame, seq: str = "sequence") -> DataFrame:
    """(seq, fault) for repeated and missing sequences: duplicate, or gap before it.

    Runs of _RUN numbers are summed to a count and a bitmap each, by partial aggregation; only runs that are not whole are looked at
    closely, and where two runs meet only their ends count.  The log is never sorted in one task.
    """
    rows = log.select(F.col(seq).cast("long").alias("seq"), F.bitmap_bucket_number(F.col(seq).cast("long")).alias("run"))
    seen = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("seq")))
    runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), seen.alias("seen"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    odd = runs.where((F.col("n") != F.col("seen")) | (F.col("seen") != F.col("hi") - F.col("lo") + 1))
    inside = rows.join(odd.select("run"), "run", "left_semi").groupBy("run", "seq").agg(F.count(F.lit(1)).alias("n"))
    close = inside.select("seq", "n", (F.col("seq") - F.lag("seq").over(Window.partitionBy("run").orderBy("seq"))).alias("step"))
    block = F.floor(F.col("run") / _RUN)
    meets = runs.select("lo", (F.col("lo") - F.lag("hi").over(Window.partitionBy(block).orderBy("run"))).alias("step"))
    blocks = runs.groupBy(block.alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    far = blocks.select("lo", (F.col("lo") - F.lag("hi").over(Window.orderBy("b"))).alias("step"))  # a row for _RUN * _RUN numbers
    gaps = close.where("step > 1").select("seq").union(meets.where("step > 1").select("lo")).union(far.where("step > 1").select("lo"))
    return close.where("n > 1").select("seq", F.lit("duplicate").alias("fault")).union(gaps.select("seq", F.lit("gap").alias("fault")))


#: Numbers in a run that is checked as one, as many as a bitmap has bits.
_RUN = 32768
#: Milliseconds between two generated events at the least.
LEAST_INTERVAL = 50


def generator(spark: SparkSession, template: str, interval_ms: int = 1000) -> DataFrame:
    """A stream of (n, timestamp, payload), one for each ``interval_ms`` (LEAST_INTERVAL or more), from a template with ``{n}`` and ``{ts}``.

    Trigger it with ``processingTime`` of the same interval for one event at a time.
    """
    step = max(interval_ms, LEAST_INTERVAL)
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", step).load()
    payload: Column = F.replace(
        F.replace(F.lit(template), F.lit("{n}"), F.col("value").cast("string")), F.lit("{ts}"), F.unix_millis("timestamp").cast("string"),
    )
    return rate.select(F.col("value").alias("n"), "timestamp", payload.alias("payload"))


def numbered(df: DataFrame, first: int, *order: str) -> DataFrame:
    """``df`` with gap-free sequences from ``first`` in the given order; ties stand in any order.

    Counts of range partitions give each its first number; only one row for each partition meets in one place.  The ordered rows
    are written to the shared folder once, so that a lost executor cannot number them anew.
    """
    spark = df.sparkSession
    own = workspace(spark, "numbered")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).write.parquet(own)
    written = spark.read.parquet(own)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_low"))
    starts = starts.select("_p", "_low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = written.join(F.broadcast(starts), "_p")  # a row for each partition
    return placed.withColumn("sequence", F.lit(first) + F.col("_start") + F.col("_i") - F.col("_low")).drop("_p", "_i", "_low", "_start")
