"""Reference counts of stored objects: from entries, incrementally, and over a shared graph of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.operators.common import settled, together, total

NO_CONFLICT = "an object has two sizes"


def object_refs(entries: DataFrame) -> DataFrame:
    """(object_id, reference_count, size_bytes, conflicting): counts entries, so an object at two paths counts twice."""
    counted = entries.groupBy("object_id").agg(F.count(F.lit(1)).alias("reference_count"), F.min("size_bytes").alias("size_bytes"), F.max("size_bytes").alias("__most"))
    return counted.select("object_id", "reference_count", "size_bytes", (~F.col("size_bytes").eqNullSafe(F.col("__most"))).alias("conflicting"))


def _strict(refs: DataFrame, low: str, high: str) -> DataFrame:
    checked = F.assert_true(F.col(low).eqNullSafe(F.col(high)), F.lit(NO_CONFLICT)).isNull()
    return refs.where(checked)


def add_refs(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """``refs`` (object_id, reference_count, size_bytes) with one snapshot's entries counted in; fails on two sizes."""
    new = entries.groupBy("object_id").agg(F.count(F.lit(1)).alias("reference_count"), F.min("size_bytes").alias("size_bytes"), F.max("size_bytes").alias("most"))
    old = refs.select("object_id", "reference_count", "size_bytes", F.col("size_bytes").alias("most"))
    both = old.unionByName(new).groupBy("object_id").agg(F.sum("reference_count").alias("reference_count"), F.min("size_bytes").alias("size_bytes"), F.max("most").alias("most"))
    return _strict(both, "size_bytes", "most").select("object_id", "reference_count", "size_bytes")


def remove_refs(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """``refs`` without one snapshot's entries; what falls to zero goes, and a count below zero fails."""
    gone = entries.groupBy("object_id").agg(F.count(F.lit(1)).alias("__gone"))
    left = refs.join(gone, "object_id", "full_outer").withColumn("reference_count", F.coalesce("reference_count", F.lit(0)) - F.coalesce("__gone", F.lit(0)))
    checked = left.where(F.assert_true(F.col("reference_count") >= 0, F.lit("an object has fewer references than are removed")).isNull())
    return checked.where("reference_count > 0").select("object_id", "reference_count", "size_bytes")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent_id", "child_id").agg(F.count(F.lit(1)).alias("n"))


def leaf_counts(leaf_entries: DataFrame) -> DataFrame:
    return leaf_entries.groupBy("chunk_id", "object_id").agg(F.count(F.lit(1)).alias("n"))


def multiplicity(roots: DataFrame, edges: DataFrame, most_depth: int = 1024) -> DataFrame:
    """(node, multiplicity): how often each node is reached, counting every way from the roots.

    roots (node, multiplicity), edges (parent_id, child_id, n). One aggregate a level, so ways are counted and
    never spelled out; a graph deeper than ``most_depth`` has a cycle, which is an error.
    """
    levels = [settled(roots.groupBy("node").agg(F.sum("multiplicity").alias("multiplicity")))]
    for _ in range(most_depth):
        step = levels[-1].join(edges, levels[-1]["node"] == edges["parent_id"]).groupBy(F.col("child_id").alias("node")).agg(F.sum(F.col("multiplicity") * F.col("n")).alias("multiplicity"))
        frontier = settled(step)
        if frontier.isEmpty():
            return together(levels).groupBy("node").agg(F.sum("multiplicity").alias("multiplicity"))
        levels.append(frontier)  # each level is written once
    raise RuntimeError("the graph has a cycle")


def graph_refs(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(object_id, reference_count) from node multiplicities and (chunk_id, object_id, n)."""
    return leaves.join(nodes, leaves["chunk_id"] == nodes["node"]).groupBy("object_id").agg(F.sum(F.col("multiplicity") * F.col("n")).alias("reference_count"))


def storage_summary(snapshots: DataFrame, refs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row: checkpoint_count, logical_size_bytes, object_count; with ``stored`` also the bytes on disk."""
    one = snapshots.agg(total().alias("checkpoint_count"), total(None, "logical_size_bytes").alias("logical_size_bytes")).join(refs.agg(total().alias("object_count")))
    return one if stored is None else one.join(stored.agg(total(None, "size_bytes").alias("stored_size_bytes")))


def rebuild_result(snapshots: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Snapshots, referenced objects, and how many of those are missing or of another size."""
    present = objects.select("object_id", F.col("size_bytes").alias("__p"))
    joined = refs.join(present, "object_id", "left")
    counted = joined.agg(total().alias("object_count"), total(~F.col("size_bytes").eqNullSafe(F.col("__p"))).alias("unavailable_count"))
    return snapshots.agg(total().alias("snapshot_count")).join(counted)


def newly_stored(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects of ``entries`` that the store lacks, each once: count and bytes."""
    new = entries.groupBy("object_id").agg(F.min("size_bytes").alias("size_bytes")).join(objects.select("object_id"), "object_id", "left_anti")
    return new.agg(total().alias("object_count"), total(None, "size_bytes").alias("newly_stored_bytes"))


def snapshot_summary(entries: DataFrame) -> DataFrame:
    """(snapshot_id, file_count, logical_size_bytes, newly_stored_bytes = 0)"""
    return entries.groupBy("snapshot_id").agg(total().alias("file_count"), total(None, "size_bytes").alias("logical_size_bytes")).withColumn("newly_stored_bytes", F.lit(0).cast("bigint"))


def first_references(entries: DataFrame) -> DataFrame:
    """(object_id, snapshot_id, path): the first snapshot by id that holds an object, and its smallest path there."""
    return entries.groupBy("object_id").agg(F.min(F.struct("snapshot_id", "path")).alias("f")).select("object_id", "f.snapshot_id", "f.path")


def rescue_bytes(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Bytes to save before a conflict is resolved: distinct contents that are not stored yet."""
    return newly_stored(files, objects).select(F.col("object_count").alias("rescue_count"), F.col("newly_stored_bytes").alias("rescue_bytes"))
