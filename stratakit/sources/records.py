"""Readers for JSON records with fixed schemas, and for the tables of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.functions.paths import is_object_id, is_tracked_path, location_problem
from stratakit.schema import schema

JOURNAL_VERSION = 3
STATES = ("created", "staged", "applying", "committed", "recovered")


def strict_json(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """Rows of a relation; a field of the wrong type fails the read."""
    return spark.read.schema(schema(relation)).option("mode", "FAILFAST").json(path)


def journal_states(raw: DataFrame) -> DataFrame:
    """(transaction_id, state) from raw texts (transaction_id, json): a state, ``unreadable``, ``unsupportedSchema:n`` or ``unknown``."""
    parsed = raw.withColumn("j", F.try_parse_json("json"))
    version = F.try_variant_get("j", "$.schemaVersion", "int")
    state = F.try_variant_get("j", "$.state", "string")
    shown = F.when(F.col("j").isNull() | version.isNull(), "unreadable").when(version != JOURNAL_VERSION, F.concat(F.lit("unsupportedSchema:"), version.cast("string"))).when(state.isin(*STATES), state).otherwise("unknown")
    return parsed.select("transaction_id", shown.alias("state"))


def snapshot_entries(entries: DataFrame, snapshot_id) -> DataFrame:
    return entries.where(F.col("snapshot_id") == snapshot_id)


def headers(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Headers alone: entries live in another table and are not touched."""
    return snapshots.select(*columns)


def snapshot_ids(locations: DataFrame) -> DataFrame:
    """Ids from locations of two-level shards; other names are skipped."""
    name = F.element_at(F.split("location", "/"), -1)
    return locations.select(name.alias("snapshot_id")).where(is_object_id(F.col("snapshot_id"))).distinct()


def object_listing(files: DataFrame) -> DataFrame:
    """Stored objects with the validity of their place: (location, object_id, size_bytes, location_problem)."""
    problem = location_problem(F.col("location"))
    return files.select("location", F.when(problem.isNull(), F.element_at(F.split("location", "/"), -1)).alias("object_id"), "size_bytes", problem.alias("location_problem"))


def valid_fingerprints(cache: DataFrame) -> DataFrame:
    """Cache rows with a valid path and id; others are skipped, for a cache may always be thrown away."""
    return cache.where(is_tracked_path(F.col("path")) & is_object_id(F.col("object_id")))


def index_if_current(index: DataFrame, state: str) -> DataFrame:
    if state != "current":
        raise ValueError(f"the index is {state}: rebuild it first")
    return index
