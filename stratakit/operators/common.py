"""Helpers for loops over DataFrames."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that driver and executors share, so that a loop's plan stays short and survives lost executors.

    Where the session names none, a temporary folder serves a local master; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratakit-"))
    return df.checkpoint(eager=True)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def total(condition: Column | None = None, value: Column | str | None = None) -> Column:
    """A count, or a sum that is zero over nothing."""
    if value is None:
        return F.count_if(condition) if condition is not None else F.count(F.lit(1))
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, column) if condition is not None else column), F.lit(0).cast("bigint"))


def numbered_all(df: DataFrame, order: list[Column | str], out: str = "position", start: int = 0) -> DataFrame:
    """Positions over the whole table in order, without gaps: ranges are sorted apart, then shifted by what lies before them."""
    return numbered_within(df, [], order, out, start)


def numbered_within(df: DataFrame, group: list[str], order: list[Column | str], out: str = "position", start: int = 0, size: str | None = None) -> DataFrame:
    """Positions in order inside each group, and the group's ``size`` if a name is given; null is a group like any other.

    The table is cut into ranges of (group, order), so a large group lies in many ranges and no task sees more than
    one; a range's rows of a group are shifted by the group's rows in the ranges before. The rows behind the counts
    are one for each range and group in it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id()))
    key = [F.col(g) for g in group] or [F.lit(0)]
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__range").alias("__rr"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*key)).alias("__size"))
    within = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    same = F.col("__range") == F.col("__rr")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    ranked = dealt.withColumn("__r", within).join(starts, same)
    sizes = [F.col("__size").cast("bigint").alias(size)] if size else []
    return ranked.select(*df.columns, (F.col("__start") + F.col("__r") - 1 + start).cast("bigint").alias(out), *sizes)


def least_of_each(df: DataFrame, group: list[str], order: list[Column | str], most: int, out: str = "position") -> DataFrame:
    """The ``most`` least rows of each group, with positions from 1; every partition sends no more than that many of a group."""
    local = Window.partitionBy(*group, "__part").orderBy(*order)
    few = df.withColumn("__part", F.spark_partition_id()).withColumn("__k", F.row_number().over(local)).where(F.col("__k") <= most).drop("__k", "__part")
    return few.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(out) <= most)
