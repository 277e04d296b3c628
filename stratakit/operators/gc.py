"""What is reachable, what may go, and what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakit.operators.common import least_of_each, settled, together, total


def reachable(roots: DataFrame, edges: DataFrame, most_depth: int = 1024) -> DataFrame:
    """(node): everything on a way from ``roots`` (node) along ``edges`` (parent_id, child_id); each node once.

    Breadth first: a level is joined with the edges and what was seen before is taken away, so shared parts and
    cycles cost nothing twice.
    """
    levels = [settled(roots.select("node").distinct())]
    for _ in range(most_depth):
        step = levels[-1].join(edges, levels[-1]["node"] == edges["parent_id"]).select(F.col("child_id").alias("node")).distinct()
        frontier = settled(step.join(together(levels), "node", "left_anti"))
        if frontier.isEmpty():
            return together(levels)
        levels.append(frontier)  # each level is written once
    raise RuntimeError("the graph is deeper than allowed")


def unreferenced(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(live.select(*keys).distinct(), keys, "left_anti")


def reference_problems(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_id, expected_size_bytes, present_size_bytes, problem): referenced objects that are missing or of another size."""
    present = objects.select("object_id", F.col("size_bytes").alias("present_size_bytes"), F.lit(True).alias("__here"))
    joined = refs.select("object_id", F.col("size_bytes").alias("expected_size_bytes")).join(present, "object_id", "left")
    problem = F.when(F.col("__here").isNull(), "missing").when(~F.col("expected_size_bytes").eqNullSafe(F.col("present_size_bytes")), "size mismatch")
    return joined.withColumn("problem", problem).where("problem is not null").drop("__here")


def gc_summary(candidates: DataFrame) -> DataFrame:
    """(family, count, bytes) over candidates (family, id, size_bytes), every family with a row of its own."""
    families = candidates.sparkSession.createDataFrame([("object",), ("chunk",), ("inventory",)], "family string")
    found = candidates.groupBy("family").agg(total().alias("n"), total(None, "size_bytes").alias("b"))
    zero = F.lit(0).cast("bigint")
    return families.join(found, "family", "left").select("family", F.coalesce("n", zero).alias("candidate_count"), F.coalesce("b", zero).alias("candidate_bytes"))


def truncated(rows: DataFrame, group: list[str], order: list[Column], most: int = 1000) -> DataFrame:
    """At most ``most`` rows of each group for display, with the exact count and whether some are left out.

    Partial limits are taken in each partition before a group meets in one task.
    """
    counts = rows.groupBy(*group).agg(total().alias("group_count"))
    top = least_of_each(rows, group, order, most)
    return top.join(counts, group).withColumn("details_truncated", F.col("group_count") > most)


def apply_gc(candidates: DataFrame, expected_plan: str, current_plan: str, has_problems: bool, delete: Callable[[list], int], lot: int = 1000) -> dict:
    """Delete candidates (location, id), lot by lot; the executors call ``delete`` with a list of rows.

    Refused if the plan changed since it was shown or if integrity problems exist. Candidates are cut into ranges;
    a range is worked through in order and stops at its first failure, others go on. The failure that comes first in
    order is reported. A task that is run again deletes again, so ``delete`` must count what is gone already as done.
    """
    if has_problems:
        raise ValueError("integrity problems: nothing is deleted")
    if expected_plan != current_plan:
        raise ValueError("candidates changed since the plan was made")

    def in_lots(batches: Iterator) -> Iterator:
        import pandas as pd

        done, failure = 0, (None, None, None)
        rows = (row for batch in batches for row in batch.itertuples(index=False, name="Candidate"))
        while part := list(islice(rows, lot)):
            try:
                done += delete(part)
            except OSError as e:
                failure = (part[0].location, str(part[0].id), str(e))
                break
        yield pd.DataFrame([(done, *failure)], columns=["deleted", "location", "id", "error"])

    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = candidates.select("location", "id").repartitionByRange(parts, "location", "id").sortWithinPartitions("location", "id")
    outcome = settled(ranges.mapInPandas(in_lots, "deleted bigint, location string, id string, error string"))  # once, whatever is asked of it
    done, first = outcome.agg(F.coalesce(F.sum("deleted"), F.lit(0)), F.min(F.when(F.col("error").isNotNull(), F.struct("location", "id", "error")))).first()
    return {"deleted": done, "complete": first is None, "error": first["error"] if first else None}


def chunk_churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks (chunk_id, stored_bytes) of ``new`` that ``old`` lacks: count, bytes, and how many are shared."""
    marked = new.join(old.select("chunk_id", F.lit(True).alias("__old")).distinct(), "chunk_id", "left")
    fresh = F.col("__old").isNull()
    return marked.agg(total(fresh).alias("new_chunks"), total(fresh, "stored_bytes").alias("new_bytes"), total(~fresh).alias("shared_chunks"))


def temp_totals(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("location", "size_bytes").unionByName(second.select("location", "size_bytes")).agg(total().alias("file_count"), total(None, "size_bytes").alias("total_bytes"))
