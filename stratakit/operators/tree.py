"""Changes as a folder tree, held as flat rows: counts by folder, compressed folders, visible rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakit.functions.paths import ancestors, base_name
from stratakit.operators.common import numbered_all, numbered_within, settled, total

TYPES = ("added", "modified", "deleted")


def parent(path: Column) -> Column:
    """The folder a path lies in; empty for the top."""
    return F.coalesce(F.try_element_at(ancestors(path), F.lit(-1)), F.lit(""))


def folder_rollup(changes: DataFrame) -> DataFrame:
    """(folder, depth, added, modified, deleted): each change counts once in every folder above it."""
    up = changes.select("change_type", F.explode(ancestors(F.col("path"))).alias("folder"))
    counts = [total(F.col("change_type") == t).alias(t) for t in TYPES]
    return up.groupBy("folder").agg(*counts).withColumn("depth", F.size(F.split("folder", "/")).cast("bigint"))


def compressed_folders(changes: DataFrame, most_depth: int = 256) -> DataFrame:
    """(folder, shown_as): where a chain of folders, each with no file and one folder, ends.

    Chains are followed by doubling, so their length costs its logarithm in joins.
    """
    folders = changes.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    with_files = changes.select(parent(F.col("path")).alias("folder")).distinct()
    children = folders.select(parent(F.col("folder")).alias("up"), F.col("folder").alias("child")).groupBy("up").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("child"))
    alone = children.where("n = 1").join(with_files, F.col("up") == F.col("folder"), "left_anti").select(F.col("up").alias("folder"), F.col("child").alias("next"))
    step = settled(folders.join(alone, "folder", "left").select("folder", F.coalesce("next", "folder").alias("next")))
    for _ in range(most_depth.bit_length()):
        ahead = step.select(F.col("folder").alias("next"), F.col("next").alias("__then"))
        further = settled(step.join(ahead, "next").select("folder", F.col("__then").alias("next")))
        if further.join(step, ["folder", "next"], "left_anti").isEmpty():
            break
        step = further
    return step.select("folder", F.col("next").alias("shown_as"))


def tree_rows(changes: DataFrame, locale: bool = False) -> DataFrame:
    """(kind, path, parent, name, change_type, pos_in_set, set_size, depth): all rows of the compressed tree.

    Folders come before files; folders by name, files by change type (added, modified, deleted), then name.
    ``locale`` sorts names by the collation ``ja`` rather than by bytes.
    """
    shown = compressed_folders(changes)
    inner = shown.where("folder <> shown_as").select(F.col("folder").alias("path"))
    starts = shown.withColumn("up", parent(F.col("folder")))
    # a visible folder starts below the top, or below a folder that is shown as itself
    real = shown.where("folder = shown_as").select(F.col("folder").alias("up")).union(shown.sparkSession.createDataFrame([("",)], "up string"))
    visible = starts.join(real, "up", "left_semi")
    up_depth = lambda c: F.size(F.split(c, "/"))
    folders = visible.select(F.lit("folder").alias("kind"), F.col("shown_as").alias("path"), F.col("up").alias("parent"), base_name(F.col("folder")).alias("name"), F.lit(None).cast("string").alias("change_type"))
    files = changes.select(F.lit("file").alias("kind"), "path", parent(F.col("path")).alias("parent"), base_name(F.col("path")).alias("name"), "change_type")
    rows = folders.unionByName(files)
    order_name = F.collate("name", "ja") if locale else F.col("name")
    rank = F.when(F.col("change_type") == "added", 0).when(F.col("change_type") == "modified", 1).otherwise(2)
    order = [F.when(F.col("kind") == "folder", 0).otherwise(1), F.when(F.col("kind") == "file", rank), order_name, F.col("path")]
    numbered = numbered_within(rows, ["parent"], order, "pos_in_set", start=1, size="set_size")
    # depth counts visible folders above: ancestors less those that were folded into a longer one
    above = numbered.select("kind", "path", F.explode(ancestors(F.col("path"))).alias("__up"))
    folded = above.join(inner.select(F.col("path").alias("__up")), "__up", "left_semi").groupBy("kind", "path").agg(F.count(F.lit(1)).alias("__f"))
    joined = numbered.join(folded, ["kind", "path"], "left")
    return joined.select("kind", "path", "parent", "name", "change_type", "pos_in_set", "set_size", (up_depth("path") - 1 - F.coalesce("__f", F.lit(0))).cast("bigint").alias("depth"))


def flattened(rows: DataFrame, open_folders: DataFrame) -> DataFrame:
    """``tree_rows`` that are visible when ``open_folders`` (path) are open, with their ``position`` in pre-order.

    A row shows if all visible folders above it are open. Sorting by the positions along the way from the top
    gives pre-order without recursion.
    """
    folders = rows.where("kind = 'folder'").select(F.col("path").alias("__up"), F.col("pos_in_set").alias("__pos"), F.col("depth").alias("__depth"))
    opened = open_folders.select(F.col("path").alias("__up"), F.lit(True).alias("__open")).distinct()
    folders = folders.join(opened, "__up", "left")
    above = rows.select("kind", "path", F.explode(ancestors(F.col("path"))).alias("__up")).join(folders, "__up")
    way = above.groupBy("kind", "path").agg(F.bool_and(F.coalesce("__open", F.lit(False))).alias("__shown"), F.array_sort(F.collect_list(F.struct("__depth", "__pos"))).alias("__way"))
    seen = rows.join(way, ["kind", "path"], "left").where(F.coalesce("__shown", F.lit(True)))
    key = F.concat(F.coalesce(F.col("__way.__pos"), F.array().cast("array<bigint>")), F.array("pos_in_set"))
    # lengths differ, so each step is padded text that sorts like its numbers
    text = F.array_join(F.transform(key, lambda x: F.lpad(x.cast("string"), 12, "0")), ".")
    return seen.withColumn("__key", text).drop("__way", "__shown")


def positions(flat: DataFrame) -> DataFrame:
    """``flattened`` with ``position`` from 0 instead of its sort key."""
    return numbered_all(flat, ["__key"]).drop("__key")


def selected_range(rows: DataFrame, anchor: str, target: str) -> DataFrame:
    """Rows (path, position) from anchor to target in either direction; if the anchor is hidden, the target alone."""
    ends = rows.where(F.col("path").isin(anchor, target)).agg(F.max(F.when(F.col("path") == anchor, F.col("position"))).alias("a"), F.max(F.when(F.col("path") == target, F.col("position"))).alias("t"))
    both = rows.join(ends)
    return both.where((F.col("path") == target) | F.col("position").between(F.least("a", "t"), F.greatest("a", "t")) & F.col("a").isNotNull()).select(*rows.columns)


def window_slice(rows: DataFrame, count: int, top: float, height: float, row_height: float, overscan: int) -> DataFrame:
    """The rows of a scrolled viewport by ``position``, with some more at both ends."""
    if count <= 0:
        return rows.limit(0)
    unit = max(1.0, row_height)
    first = min(count - 1, max(0, int(max(0.0, top) // unit)))
    last = max(first + 1, -int(-(max(0.0, top) + max(0.0, height)) // unit))
    return rows.where(F.col("position").between(max(0, first - overscan), min(count, last + overscan) - 1))


def below(rows: DataFrame, folder: str) -> DataFrame:
    """Everything under a folder: a prefix filter that reaches the scan."""
    return rows.where(F.col("path").startswith(folder.rstrip("/") + "/"))
