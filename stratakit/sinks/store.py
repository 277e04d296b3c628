"""Writes: content-addressed objects, snapshot versions with a commit row, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.functions.paths import object_location
from stratakit.operators.common import total
from stratakit.sinks.log import Log, Moved


def representatives(files: DataFrame) -> DataFrame:
    """One file for each content: the smallest path."""
    return files.groupBy("object_id").agg(F.min(F.struct("path", "size_bytes")).alias("f")).select("object_id", "f.path", "f.size_bytes")


def put_actions(files: DataFrame, objects: DataFrame, durable: DataFrame | None = None) -> DataFrame:
    """(object_id, path, size_bytes, action): ``skip`` if stored and valid, ``repair`` if stored and damaged, else ``write``.

    objects (object_id, valid). Objects in ``durable`` (object_id) are skipped without looking at the store.
    """
    chosen = representatives(files)
    if durable is not None:
        chosen = chosen.join(durable.select("object_id"), "object_id", "left_anti")
    have = objects.select("object_id", F.col("valid").alias("__v"))
    action = F.when(F.col("__v").isNull(), "write").when(F.col("__v"), "skip").otherwise("repair")
    return chosen.join(have, "object_id", "left").select("object_id", "path", "size_bytes", action.alias("action"))


def known_durable(parent_entries: DataFrame, integrity: DataFrame) -> DataFrame:
    """Objects of the parent snapshot whose size the integrity cache confirms."""
    seen = integrity.select("object_id", "size_bytes").distinct()
    return parent_entries.select("object_id", "size_bytes").distinct().join(seen, ["object_id", "size_bytes"], "left_semi").select("object_id")


def new_objects(actions: DataFrame) -> DataFrame:
    """What to write, with its shard: a partition column, so that a lookup reads one shard."""
    return actions.where("action <> 'skip'").select("object_id", "path", "size_bytes", object_location(F.col("object_id")).alias("location"), F.substring("object_id", 1, 2).alias("shard"))


def publish_version(spark: SparkSession, entries: DataFrame, header: DataFrame, directory: str, snapshot_id: str, expected_head: int | None = None) -> int:
    """Entries first, then the header, then the state in the log that commits both -> the new head.

    A version without a state does not exist for readers. Publishing a version again changes nothing; with
    ``expected_head`` another writer's state in between is an error, and the version stays unseen.
    """
    log = Log(spark, directory)
    done = log.states().where((F.col("operation") == "add") & (F.col("snapshot_id") == snapshot_id)).agg(F.max("generation")).first()[0]
    if done is not None:
        return done
    head = log.head()
    if expected_head is not None and head != expected_head:
        raise Moved("the head moved")
    entries.drop("snapshot_id").write.mode("overwrite").parquet(f"{directory}/entries/snapshot_id={snapshot_id}")
    header.drop("snapshot_id").write.mode("overwrite").parquet(f"{directory}/headers/snapshot_id={snapshot_id}")
    return log.append("add", snapshot_id, head, snapshot_id)


def published(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(headers, entries) of committed versions."""
    live = Log(spark, directory).states().groupBy("snapshot_id").agg(F.max_by("operation", "generation").alias("operation")).where("operation = 'add'").select("snapshot_id")
    read = lambda name: spark.read.parquet(f"{directory}/{name}").withColumn("snapshot_id", F.col("snapshot_id").cast("string")).join(live, "snapshot_id", "left_semi")
    return read("headers"), read("entries")


def replace_index(index: DataFrame, directory: str, version: str, head_before: str, head_now: str) -> str:
    """A rebuilt index under a version of its own; refused if the inventory moved while it was built."""
    index.write.mode("overwrite").parquet(f"{directory}/{version}")
    if head_before != head_now:
        raise ValueError("the inventory changed while the index was built")
    return f"{directory}/{version}"


def index_upsert(index: DataFrame, summary: DataFrame) -> DataFrame:
    """One snapshot's summary added; the same row again changes nothing, another one under its id is an error."""
    keys = ["snapshot_id"]
    values = [c for c in summary.columns if c not in keys]
    old = index.select("snapshot_id", *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__had"))
    both = summary.join(old, keys, "left")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    fresh = both.where(F.assert_true(F.col("__had").isNull() | same, F.lit("the index holds another summary of this snapshot")).isNull()).where("__had is null")
    return index.unionByName(fresh.select(*summary.columns))


def append_events(events: DataFrame, path: str) -> None:
    """JSON lines."""
    events.write.mode("append").json(path)


def export_conflicts(conflicts: DataFrame, selected: DataFrame, path: str) -> None:
    """The chosen conflicts' rows; a choice that is no conflict is an error."""
    unknown = selected.select("path").join(conflicts.select("path"), "path", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("selected paths are not all in conflict")
    conflicts.join(selected.select("path"), "path", "left_semi").write.mode("overwrite").parquet(path)


def io_metrics(events: DataFrame) -> DataFrame:
    """(run, total_micros, phase_micros, other_micros) from events (run, phase, micros); what phases do not explain is ``other``."""
    whole = F.col("phase") == "total"
    sums = events.groupBy("run").agg(total(whole, "micros").alias("total_micros"), total(~whole, "micros").alias("phase_micros"))
    return sums.withColumn("other_micros", F.greatest(F.lit(0).cast("bigint"), F.col("total_micros") - F.col("phase_micros")))


def portable_export(tables: dict[str, DataFrame], directory: str) -> list[str]:
    """Copy the tables that make up a dataset; what can be derived again (index, caches) stays behind."""
    kept = [name for name in ("config", "refs", "inventory_states", "snapshots", "snapshot_entries", "objects") if name in tables]
    for name in kept:
        tables[name].write.mode("overwrite").parquet(f"{directory}/{name}")
    return kept


def with_resolution(resolutions: DataFrame, quarantine_id: str, digest: str, records: DataFrame) -> DataFrame:
    """One resolution added; it binds the record's digest, so a changed record is open again."""
    if records.where((F.col("quarantine_id") == quarantine_id) & (F.col("digest") == digest)).isEmpty():
        raise ValueError("no record with this digest")
    return resolutions.union(resolutions.sparkSession.createDataFrame([(quarantine_id, digest)], resolutions.schema))


