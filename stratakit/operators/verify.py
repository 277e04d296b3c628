"""Integrity checks; each gives rows (check, subject, detail), and no rows mean that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions.paths import ancestors, path_problem

MOST_ERRORS = 1024


def _found(df: DataFrame, check: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def duplicate_paths(entries: DataFrame) -> DataFrame:
    twice = entries.groupBy("snapshot_id", "path").count().where("count > 1")
    return _found(twice, "duplicate path", F.concat_ws("/", "snapshot_id", "path"), F.col("count"))


def key_collisions(entries: DataFrame) -> DataFrame:
    """Distinct paths of one snapshot with one portable key."""
    found = entries.groupBy("snapshot_id", "portable_key").agg(F.count_distinct("path").alias("n"), F.min("path").alias("first")).where("n > 1")
    return _found(found, "portable key collision", F.concat_ws("/", "snapshot_id", "first"), F.col("n"))


def ancestor_conflicts(entries: DataFrame) -> DataFrame:
    """Entries that lie below another entry: every proper prefix is looked up, so siblings between them hide nothing."""
    up = entries.select("snapshot_id", "path", F.explode(ancestors(F.col("path"))).alias("above"))
    own = entries.select("snapshot_id", F.col("path").alias("above")).distinct()
    return _found(up.join(own, ["snapshot_id", "above"], "left_semi"), "ancestor is a file", F.concat_ws("/", "snapshot_id", "path"), F.col("above"))


def size_conflicts(entries: DataFrame) -> DataFrame:
    found = entries.groupBy("object_id").agg(F.min("size_bytes").alias("lo"), F.max("size_bytes").alias("hi")).where("not lo <=> hi")
    return _found(found, "object with two sizes", F.col("object_id"), F.concat_ws(" and ", "lo", "hi"))


def invalid_paths(entries: DataFrame) -> DataFrame:
    return _found(entries.withColumn("__p", path_problem(F.col("path"))).where("__p is not null"), "invalid path", F.col("path"), F.col("__p"))


def negative_sizes(entries: DataFrame) -> DataFrame:
    return _found(entries.where("size_bytes < 0"), "negative size", F.col("path"), F.col("size_bytes"))


def header_mismatches(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Headers whose counts or sums differ from their entries', and names that are empty, padded or too long."""
    sums = entries.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    joined = snapshots.join(sums, "snapshot_id", "left")
    zero = F.lit(0)
    wrong = ~F.col("file_count").eqNullSafe(F.coalesce("n", zero)) | ~F.col("logical_size_bytes").eqNullSafe(F.coalesce("b", zero))
    name = F.coalesce("name", F.lit(""))
    bad_name = (name == "") | (F.trim(name) != name) | (F.octet_length(name) > 4096)
    return _found(joined.where(wrong), "header differs from entries", F.col("snapshot_id")).union(_found(joined.where(bad_name), "bad name", F.col("snapshot_id"), F.col("name")))


def verify(entries: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """All checks over the entries, and over the headers if given."""
    parts = [duplicate_paths(entries), key_collisions(entries), ancestor_conflicts(entries), size_conflicts(entries), invalid_paths(entries), negative_sizes(entries)]
    if snapshots is not None:
        parts.append(header_mismatches(snapshots, entries))
    return reduce(DataFrame.union, parts)


def object_verification(expected: DataFrame, present: DataFrame, full: bool = False) -> DataFrame:
    """(object_id, problem): the size always, the hash of ``content`` only in full mode, which alone reads it."""
    columns = ["object_id", F.col("size_bytes").alias("__size"), F.lit(True).alias("__here")]
    if full:
        columns.append(F.sha2(F.col("content"), 256).alias("__hash"))
    joined = expected.select("object_id", "size_bytes").join(present.select(*columns), "object_id", "left")
    problem = F.when(F.col("__here").isNull(), "missing").when(~F.col("size_bytes").eqNullSafe(F.col("__size")), "size mismatch")
    if full:
        problem = problem.when(~F.col("__hash").eqNullSafe(F.col("object_id")), "hash mismatch")
    return joined.withColumn("problem", problem).where("problem is not null").select("object_id", "problem")


def capped_errors(errors: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """Distinct errors (error), the first ``most`` by text, and one line that counts the others."""
    every = errors.select("error").distinct()
    n = every.count()
    shown = every.orderBy("error").limit(most)
    if n <= most:
        return shown
    return shown.union(every.sparkSession.createDataFrame([(f"... and {n - most} more",)], "error string"))


def adjacent(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Rows whose key equals, or comes before, the key of the row in front of them (by arrival ``position``)."""
    ahead = F.lag(key).over(Window.partitionBy(*group).orderBy("position"))
    return rows.withColumn("previous", ahead).where(F.col("previous") >= F.col(key))


def completeness(rows: DataFrame, group: list[str], number: str, ident: str) -> DataFrame:
    """Groups whose numbers are not exactly 1..n, or whose ids repeat or are null: (group, n, problem)."""
    checked = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count_distinct(ident).alias("ids"))
    problem = F.when((F.col("d") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "numbers").when(F.col("ids") != F.col("n"), "ids")
    return checked.withColumn("problem", problem).where("problem is not null").select(*group, "n", "problem")


def bad_root_names(names: DataFrame) -> DataFrame:
    """(location, warning) for files among the snapshot roots whose name is no id, or that lie in a wrong shard."""
    parts = F.split("location", "/", -1)
    name = F.element_at(parts, -1)
    shard = F.concat(F.substring(name, 1, 2), F.lit("/"), F.substring(name, 3, 2))
    warning = F.when(~name.rlike(r"\A[0-9a-f]{64}\z"), "invalid snapshot file name").when(F.array_join(F.slice(parts, F.size(parts) - 2, 2), "/") != shard, "wrong shard")
    return names.withColumn("warning", F.when(F.size(parts) < 3, "wrong depth").otherwise(warning)).where("warning is not null").select("location", "warning")
