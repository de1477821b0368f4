"""Dense numbers in a global order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.frames import checkpointed


def numbered(df: DataFrame, ordinal: str, name: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``name``: its place from 0 in the order of the distinct, non-negative integers ``ordinal``.

    Places within a range of ``width`` ordinals are counted in parallel; the ranges' offsets are a running
    sum over one row for each range.
    """
    ranged = df.withColumn("_range", F.expr(f"{ordinal} div {width}"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(ordinal)) - 1
    return ranged.withColumn("_in", inside).join(offsets, "_range").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_range", "_in", "_before")


def even_width(df: DataFrame, ordinal: str, ranges: int = 4096) -> int:
    """The width that cuts the integers ``ordinal`` into at most ``ranges`` ranges between their ends, whatever their size."""
    low, high = df.agg(F.min(ordinal), F.max(ordinal)).first()
    return 1 if low is None else max(1, -(-(high - low + 1) // ranges))


def running_total(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to and with its ``order``, equals together.

    Rows are dealt by ranges of ``order`` that hold about as many each.  Sums run within ranges in parallel, and from range to range over one
    row for each, so that a hub is no single group.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(tasks, order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    before = sums.select(by, "_range", F.coalesce(F.sum("_sum").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(W.partitionBy(by, "_range").orderBy(order))
    return ranged.withColumn("_inside", inside).join(before, [by, "_range"]).withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).select(*df.columns, name)


def ratio_split(df: DataFrame, order, shares: tuple[float, ...], names: tuple[str, ...], total: int) -> DataFrame:
    """``df`` cut by exact shares of its ``total`` rows in the order of the 32-bit hash ``order``.

    ``order`` must be unique up to a tiebreak column ``_tie``; cuts are at int(share * total).
    """
    ranged = df.withColumn("_range", F.shiftright(order, 16))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(order, "_tie")) - 1 + F.col("_before")
    cuts, at = [], 0.0
    for s in shares[:-1]:
        at += s
        cuts.append(int(round(at * total, 6)))
    split = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts))):
        split = F.when(F.col("_place") < cut, name).otherwise(split)
    return ranged.join(offsets, "_range").withColumn("_place", place).withColumn("split", split).drop("_range", "_before", "_place")


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows of ``df`` without replacement, the same ones each time: those with the least digests of ``key``."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def first_in_order(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``ordinal``, as a file would give them."""
    return df.orderBy(ordinal).limit(n)
