"""The list of snapshots as users see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions.display import matches_search
from stratakit.operators.common import total


def ranked(snapshots: DataFrame, group: str = "project_id") -> DataFrame:
    """Newest first, ties by id, as ``position`` from 1 within each project."""
    order = Window.partitionBy(group).orderBy(F.desc("created_at_utc"), F.desc("snapshot_id"))
    return snapshots.withColumn("position", F.row_number().over(order).cast("bigint"))


def with_names(snapshots: DataFrame, overrides: DataFrame) -> DataFrame:
    """Names given later replace those of the headers."""
    given = overrides.select("snapshot_id", F.col("name").alias("__given"))
    return snapshots.join(given, "snapshot_id", "left").withColumn("name", F.coalesce("__given", "name")).drop("__given")


def search(snapshots: DataFrame, query: str) -> DataFrame:
    return snapshots.where(matches_search(query, F.col("name"), F.col("snapshot_id"), F.col("created_at_utc")))


def set_name(overrides: DataFrame, snapshot_id, name: str | None) -> DataFrame:
    """One override set, or cleared by None."""
    rest = overrides.where(~F.col("snapshot_id").eqNullSafe(F.lit(snapshot_id)))
    if name is None:
        return rest
    return rest.union(overrides.sparkSession.createDataFrame([(snapshot_id, name)], overrides.schema))


def pruned(overrides: DataFrame, live: DataFrame) -> DataFrame:
    return overrides.join(live.select("snapshot_id"), "snapshot_id", "left_semi")


def upserted(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows with their keys."""
    return rows.join(new.select(*keys), keys, "left_anti").unionByName(new)


def refreshed_fingerprints(cache: DataFrame, updates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Updates, and what the cache knows of paths that were seen but not updated; the rest is forgotten."""
    kept = cache.join(updates.select(*keys), keys, "left_anti").join(seen.select(*keys), keys, "left_semi")
    return kept.unionByName(updates)


def series(points: DataFrame, group: list[str], number: str, value: str) -> DataFrame:
    """Each measurement with its change since the one before."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(number))
    return points.withColumn("delta", F.col(value) - before)


def running(rows: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """Prefix sums within a group: the sum up to each row."""
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prefix_sum", F.sum(value).over(frame))


def page(rows: DataFrame, key: str, after, size: int = 4096) -> DataFrame:
    """Keyset paging: the ``size`` rows behind ``after``."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """(warning): trimmed, not empty, each once."""
    return warnings.select(F.trim("warning").alias("warning")).where("warning <> ''").distinct()


def warning_banner(warnings: DataFrame, most: int = 5) -> DataFrame:
    """(warning, position) by first appearance (``position``); the first ``most`` are shown and the rest counted in ``omitted``."""
    first = warnings.select(F.trim("warning").alias("warning"), "position").where("warning <> ''").groupBy("warning").agg(F.min("position").alias("first_seen"))
    n = first.agg(total().alias("n"))
    shown = first.orderBy("first_seen").limit(most)
    return shown.join(n).select("warning", "first_seen", F.greatest(F.lit(0).cast("bigint"), F.col("n") - most).alias("omitted"))


def recent_projects(history: DataFrame, most: int = 12) -> DataFrame:
    """The projects opened last, each once: (path, opened_at)."""
    return history.groupBy("path").agg(F.max("opened_at").alias("opened_at")).orderBy(F.desc("opened_at"), "path").limit(most)


def merged_options(options: DataFrame, group: str) -> DataFrame:
    """Queued refreshes as one: wanted or busy if any is, quick or silent only if all are."""
    return options.groupBy(group).agg(F.bool_or("refresh_project").alias("refresh_project"), F.bool_or("allow_busy").alias("allow_busy"), F.bool_and("metadata_only").alias("metadata_only"), F.bool_and("silent").alias("silent"))


def retained_size(summary: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """A size that is not known now keeps its last known value."""
    old = previous.select(key, F.col("stored_size_bytes").alias("__old"))
    return summary.join(old, key, "left").withColumn("stored_size_bytes", F.coalesce("stored_size_bytes", "__old")).drop("__old")
