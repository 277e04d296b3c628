"""A radix manifest over portable keys: content-addressed leaves and nodes, derived from the entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions.paths import portable_key
from stratakit.operators.common import settled, together, total

LEAF_BYTES = 32 * 1024
ROW_OVERHEAD = 64  # bytes of a row besides its path, a fixed part of the size rule
NODE, LEAF = 1, 2


def domain_hash(domain: str, *payload: Column) -> Column:
    """A digest that no other kind of record can have."""
    return F.sha2(F.concat(F.lit(domain + "\n"), *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in payload]), 256)


def manifest_rows(entries: DataFrame) -> DataFrame:
    """Entries with their key as bytes in hex, so that a prefix of an even length is a byte prefix."""
    key = F.lower(F.hex(portable_key(F.col("path")).cast("binary")))
    return entries.withColumn("key", key).withColumn("encoded_bytes", F.octet_length("path").cast("bigint") + ROW_OVERHEAD)


def build(entries: DataFrame, leaf_bytes: int = LEAF_BYTES, most_depth: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes). leaves: (prefix, key, path, size_bytes, modified_at_utc, object_id); nodes: (prefix, child, entry_count, logical_size_bytes, path_bytes).

    Level by level: keys that share a prefix form a group; a group that fits a leaf, or has one row, becomes one,
    any other becomes a node and is cut by the byte behind its longest common prefix. A round handles all groups
    of a level at once; the rows of finished groups leave the loop. The order of the input does not matter.
    """
    todo = settled(manifest_rows(entries).withColumn("group", F.lit("")))
    leaves, nodes = [], []  # of each level, written once
    for _ in range(most_depth):
        if todo.isEmpty():
            break
        sizes = todo.groupBy("group").agg(total().alias("n"), F.sum("encoded_bytes").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"), total(None, "size_bytes").alias("logical"), total(None, F.octet_length("path").cast("bigint")).alias("path_bytes"))
        # the common prefix of the least and the greatest key is common to all
        shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("lo"), F.length("hi")))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.col("lo").substr(i, F.lit(1)) == F.col("hi").substr(i, F.lit(1))), i).otherwise(acc))
        even = (shared - shared % 2).cast("int")
        sizes = settled(sizes.withColumn("prefix", F.col("lo").substr(F.lit(1), even)).withColumn("is_leaf", (F.col("bytes") <= leaf_bytes) | (F.col("n") == 1)))
        placed = settled(todo.join(sizes.select("group", "prefix", "is_leaf"), "group"))
        leaves.append(placed.where("is_leaf").select("prefix", "key", "path", "size_bytes", "modified_at_utc", "object_id"))
        nodes.append(sizes.where("not is_leaf").select("group", "prefix", F.col("n").alias("entry_count"), F.col("logical").alias("logical_size_bytes"), "path_bytes"))
        next_group = F.col("key").substr(F.lit(1), F.length("prefix") + 2)
        todo = placed.where("not is_leaf").withColumn("group", next_group).drop("prefix", "is_leaf")
    if not leaves:
        nothing = todo.select(F.lit("").alias("prefix"), "key", "path", "size_bytes", "modified_at_utc", "object_id")
        empty = todo.select("group", F.lit("").alias("prefix"), *[F.lit(0).cast("bigint").alias(c) for c in ("entry_count", "logical_size_bytes", "path_bytes")])
        return nothing, empty
    return together(leaves), together(nodes)


def leaf_ids(leaves: DataFrame) -> DataFrame:
    """(prefix, chunk_id, entry_count, logical_size_bytes, path_bytes): a leaf's digest over its rows in key order."""
    row = F.concat_ws("\t", "path", F.col("size_bytes").cast("string"), "modified_at_utc", "object_id")
    rows = F.array_sort(F.collect_list(F.struct("key", row.alias("row"))))
    return leaves.groupBy("prefix").agg(domain_hash("leaf", F.array_join(F.transform(rows, lambda r: r["row"]), "\n")).alias("chunk_id"), total().alias("entry_count"), total(None, "size_bytes").alias("logical_size_bytes"), total(None, F.octet_length("path").cast("bigint")).alias("path_bytes"))


def root_digest(leaves: DataFrame, digits: int = 4) -> DataFrame:
    """One row: equal for equal entries, in whatever order they came.

    Leaves are dealt to 16 ** ``digits`` parts by a hash of their prefix, each part is hashed over its leaves in
    order, and the root over the parts, so no task holds all leaves.
    """
    ids = leaf_ids(leaves).withColumn("part", F.substring(F.sha2("prefix", 256), 1, digits))
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: F.concat(x[key], F.lit(" "), x[value])), "\n")
    parts = ids.groupBy("part").agg(domain_hash("part", joined("prefix", "chunk_id")).alias("part_id"))
    return parts.agg(domain_hash("root", joined("part", "part_id")).alias("root_id"))


def in_key_order(leaves: DataFrame) -> DataFrame:
    return leaves.orderBy("key", "path")


def lookup(leaves: DataFrame, path: str) -> DataFrame:
    """The entry at a path: a filter on its key."""
    wanted = leaves.sparkSession.range(1).select(F.lower(F.hex(portable_key(F.lit(path)).cast("binary")))).first()[0]
    return leaves.where(F.col("key") == wanted)


def chunk_summary(leaf_entries: DataFrame) -> DataFrame:
    """(chunk_id, entry_count, logical_size_bytes, path_bytes)"""
    return leaf_entries.groupBy("chunk_id").agg(total().alias("entry_count"), total(None, "size_bytes").alias("logical_size_bytes"), total(None, F.octet_length("path").cast("bigint")).alias("path_bytes"))


def node_problems(edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """(parent_id, problem): fewer than two children, a repeated edge, edges not rising by position, or child sums that
    differ from the parent's. edges (parent_id, edge, position, child_id), summaries (id, entry_count, logical_size_bytes)."""
    child = summaries.select(F.col("id").alias("child_id"), F.col("entry_count").alias("__n"), F.col("logical_size_bytes").alias("__b"))
    ahead = F.lag("edge").over(Window.partitionBy("parent_id").orderBy("position"))
    marked = edges.withColumn("__before", ahead).join(child, "child_id", "left")
    sums = marked.groupBy("parent_id").agg(total().alias("n"), F.coalesce(F.bool_or(F.col("__before") >= F.col("edge")), F.lit(False)).alias("falling"), F.sum("__n").alias("entries"), F.sum("__b").alias("bytes"))
    own = summaries.select(F.col("id").alias("parent_id"), "entry_count", "logical_size_bytes")
    problem = F.when(F.col("n") < 2, "fewer than two children").when(F.col("falling"), "edges do not rise").when(~F.col("entries").eqNullSafe(F.col("entry_count")) | ~F.col("bytes").eqNullSafe(F.col("logical_size_bytes")), "sums differ")
    return sums.join(own, "parent_id", "left").withColumn("problem", problem).where("problem is not null").select("parent_id", "problem")
