"""What an interrupted transaction left behind, classified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.operators.common import total

TERMINAL = ("committed", "recovered")


def conflicts(operations: DataFrame, working: DataFrame) -> DataFrame:
    """(path, operation_type, current_hash, size_bytes, modified_at_utc, metadata_only, failed) for files that neither
    the state before nor the one after an operation explains.

    restore: anything but the state after; replace: neither state; delete: anything but the state before;
    setMetadata: changed content (or no file) ``failed``, a third mtime is a metadata-only conflict.
    """
    now = working.select("path", F.col("object_id").alias("current_hash"), "size_bytes", "modified_at_utc", F.lit(True).alias("__here"))
    j = operations.join(now, "path", "left")
    c = F.col
    before = c("before_hash").eqNullSafe(c("current_hash")) & c("before_size_bytes").eqNullSafe(c("size_bytes"))
    after = c("after_hash").eqNullSafe(c("current_hash")) & c("after_size_bytes").eqNullSafe(c("size_bytes"))
    kind, here = c("operation_type"), c("__here").isNotNull()
    meta = kind == "setMetadata"
    third = ~c("before_modified_at_utc").eqNullSafe(c("modified_at_utc")) & ~c("after_modified_at_utc").eqNullSafe(c("modified_at_utc"))
    metadata_only = here & meta & before & third
    failed = meta & (~here | ~before)
    content = here & (((kind == "restore") & ~after) | ((kind == "replace") & ~before & ~after) | ((kind == "delete") & ~before))
    return j.where(content | metadata_only | failed).select("path", "operation_type", "current_hash", "size_bytes", "modified_at_utc", metadata_only.alias("metadata_only"), failed.alias("failed"))


def grouped_conflicts(found: DataFrame) -> DataFrame:
    """(id, paths, size_bytes): a file and its X.meta are one group; negative sizes count as zero."""
    key = F.regexp_replace("path", r"\.meta\z", "")
    size = F.greatest(F.lit(0).cast("bigint"), F.coalesce("size_bytes", F.lit(0).cast("bigint")))
    return found.groupBy(key.alias("id")).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.sum(size).alias("size_bytes"))


def pending(journals: DataFrame) -> DataFrame:
    return journals.where(~F.col("state").isin(*TERMINAL))


def needs_rollback(journals: DataFrame, operations: DataFrame, payload: DataFrame, working: DataFrame) -> DataFrame:
    """(transaction_id, needs_rollback): applying; or a backup exists; or staged, and a file already is what it was to become.

    payload (transaction_id, side, path) with side ``backup`` or ``staged``.
    """
    backups = payload.where("side = 'backup'").select("transaction_id").distinct().withColumn("__backup", F.lit(True))
    staged = payload.where("side = 'staged'").select("transaction_id", "path")
    now = working.select("path", F.col("object_id").alias("after_hash"))
    live = operations.where("after_hash is not null").join(staged, ["transaction_id", "path"], "left_anti").join(now, ["path", "after_hash"], "left_semi").select("transaction_id").distinct().withColumn("__live", F.lit(True))
    j = journals.join(backups, "transaction_id", "left").join(live, "transaction_id", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    return j.select("transaction_id", ((F.col("state") == "applying") | yes("__backup") | ((F.col("state") == "staged") & yes("__live"))).alias("needs_rollback"))


def payload_check(payload: DataFrame, allowed: DataFrame) -> DataFrame:
    """(transaction_id, path, known): payload files, and whether the journal allows them."""
    marked = allowed.select("transaction_id", "path", F.lit(True).alias("__ok")).distinct()
    return payload.join(marked, ["transaction_id", "path"], "left").select("transaction_id", "path", F.coalesce("__ok", F.lit(False)).alias("known"))


def unresolved_quarantine(records: DataFrame, resolutions: DataFrame, payload: DataFrame) -> DataFrame:
    """(quarantine_id, quarantined_at_utc, reason) of records that are neither verified before nor resolved, that
    cannot be read, or of payload without a record.

    records (quarantine_id, quarantined_at_utc, readable, verified_before, digest); resolutions bind a digest.
    """
    done = resolutions.select("quarantine_id", "digest").distinct()
    open_ = records.where("readable and not verified_before").join(done, ["quarantine_id", "digest"], "left_anti").select("quarantine_id", "quarantined_at_utc", F.lit("unresolved").alias("reason"))
    broken = records.where("not readable").select("quarantine_id", F.lit(None).cast("string").alias("quarantined_at_utc"), F.lit("unreadable").alias("reason"))
    orphans = payload.select("quarantine_id").distinct().join(records, "quarantine_id", "left_anti").select("quarantine_id", F.lit(None).cast("string").alias("quarantined_at_utc"), F.lit("orphan payload").alias("reason"))
    return open_.union(broken).union(orphans)


def still_pending(failures: DataFrame, pending_now: DataFrame) -> DataFrame:
    return failures.join(pending_now.select("transaction_id"), "transaction_id", "left_semi")


def cleanup_plan(journals: DataFrame, files: DataFrame) -> DataFrame:
    """(transaction_id, location, file_count, total_bytes) of finished transactions, by location and id."""
    ended = journals.where(F.col("state").isin(*TERMINAL)).select("transaction_id", "location")
    sums = files.groupBy("transaction_id").agg(total().alias("file_count"), total(None, "size_bytes").alias("total_bytes"))
    zero = F.lit(0).cast("bigint")
    return ended.join(sums, "transaction_id", "left").select("transaction_id", "location", F.coalesce("file_count", zero).alias("file_count"), F.coalesce("total_bytes", zero).alias("total_bytes"))


def cleanup_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(total().alias("directory_count"), total(None, "file_count").alias("file_count"), total(None, "total_bytes").alias("total_bytes"))


def recovery_result(outcomes: DataFrame) -> DataFrame:
    """One row: how many recovered and failed, and their sorted ids, joined: a report on the transactions at hand.

    The row holds every id, so one task makes it; for more outcomes than a row should hold, read them as rows.
    """
    ids = lambda ok: F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col("transaction_id").cast("string")))), ",")
    good = F.col("error").isNull()
    return outcomes.agg(total(good).alias("recovered_count"), total(~good).alias("failed_count"), ids(good).alias("recovered_ids"), ids(~good).alias("failed_ids"))
