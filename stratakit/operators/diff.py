"""Differences between two versions of a set of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakit.operators.common import total


def compare(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], complete: bool = True) -> DataFrame:
    """Full outer join on ``keys``; change_type is added, deleted, modified or unchanged.

    Values are equal if all are null-safe equal. What is missing from an incomplete ``after`` is ``unknown``.
    Columns: keys, change_type, before_<value>, after_<value>.
    """
    a = before.select(*keys, *[F.col(v).alias(f"before_{v}") for v in values], F.lit(True).alias("__a"))
    b = after.select(*keys, *[F.col(v).alias(f"after_{v}") for v in values], F.lit(True).alias("__b"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted" if complete else "unknown").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").withColumn("change_type", kind).drop("__a", "__b").select(*keys, "change_type", *[f"{side}_{v}" for v in values for side in ("before", "after")])


def content_diff(entries: DataFrame, working: DataFrame, complete: bool = True) -> DataFrame:
    """By content and mtime; size is not compared."""
    return compare(entries, working, ["path"], ["object_id", "modified_at_utc"], complete)


def metadata_diff(entries: DataFrame, working: DataFrame, complete: bool = True) -> DataFrame:
    """By size and mtime alone: no content is read, and an edit that keeps both is missed."""
    return compare(entries, working, ["path"], ["size_bytes", "modified_at_utc"], complete)


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[total(F.col("change_type") == kind).alias(f"{kind}_count") for kind in ("added", "modified", "deleted", "unchanged", "unknown")])


def changes_only(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change_type").isin("added", "modified", "deleted"))


def of_type(changes: DataFrame, kind: str) -> DataFrame:
    """``all`` keeps added, modified and deleted."""
    return changes_only(changes) if kind == "all" else changes.where(F.col("change_type") == kind)


def concatenated(added: DataFrame, modified: DataFrame, deleted: DataFrame) -> DataFrame:
    parts = [df.withColumn("change_type", F.lit(kind)) for df, kind in ((added, "added"), (modified, "modified"), (deleted, "deleted"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def actionable(failed: Column, complete: Column, unknown: Column, n_warnings: Column) -> Column:
    return ~failed & complete & (unknown == 0) & (n_warnings == 0)
