"""The append-only log of snapshots, and sets derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakit.operators.common import least_of_each, settled, together, total


def membership(states: DataFrame) -> DataFrame:
    """(project_id, snapshot_id): what the last operation on it added."""
    last = states.where("snapshot_id is not null").groupBy("project_id", "snapshot_id").agg(F.max_by("operation", "generation").alias("operation"))
    return last.where("operation = 'add'").select("project_id", "snapshot_id")


def latest_after_delete(states: DataFrame, removed: DataFrame) -> DataFrame:
    """(project_id, latest) after removal: the current latest unless it goes; then its parent if that survives;
    else the surviving snapshot that was added last. ``removed``: (project_id, snapshot_id, current_latest, parent)."""
    members = membership(states)
    left = members.join(removed.select("project_id", "snapshot_id"), ["project_id", "snapshot_id"], "left_anti")
    added = states.where("operation = 'add'").join(left, ["project_id", "snapshot_id"], "left_semi").groupBy("project_id").agg(F.max_by("snapshot_id", "generation").alias("newest"))
    alive = left.select("project_id", F.col("snapshot_id").alias("parent"), F.lit(True).alias("__alive"))
    joined = removed.join(added, "project_id", "left").join(alive, ["project_id", "parent"], "left")
    latest = F.when(~F.col("current_latest").eqNullSafe(F.col("snapshot_id")), F.col("current_latest")).when(F.col("__alive"), F.col("parent")).otherwise(F.col("newest"))
    return joined.select("project_id", latest.alias("latest"))


def generation_gaps(states: DataFrame, group: str = "project_id", number: str = "generation") -> DataFrame:
    before = F.lag(number).over(Window.partitionBy(group).orderBy(number))
    return states.withColumn("previous", before).where(F.col(number) - F.col("previous") != 1).select(group, number, "previous")


def shape_problems(states: DataFrame) -> DataFrame:
    """States whose fields do not fit their operation."""
    nothing = F.lit("0" * 64)
    some = F.col("parent_id").isNotNull() & F.col("snapshot_id").isNotNull() & (F.col("operation_id") != nothing) & (F.col("generation") > 0)
    valid = (
        F.when(F.col("operation") == "initialize", (F.col("generation") == 0) & (F.col("count") == 0) & F.col("parent_id").isNull() & F.col("snapshot_id").isNull() & (F.col("operation_id") == nothing))
        .when(F.col("operation") == "add", some & (F.col("count") > 0))
        .when(F.col("operation") == "remove", some)
        .otherwise(F.lit(False))
    )
    return states.where(~F.coalesce(valid, F.lit(False)))


def count_problems(states: DataFrame) -> DataFrame:
    """(project_id, stated, members): the newest state's count against the members of the log."""
    stated = states.groupBy("project_id").agg(F.max_by("count", "generation").alias("stated"))
    have = membership(states).groupBy("project_id").agg(F.count(F.lit(1)).alias("members"))
    return stated.join(have, "project_id", "left").withColumn("members", F.coalesce("members", F.lit(0))).where("stated <> members")


def added_to(members: DataFrame, new: DataFrame) -> DataFrame:
    """Union; what is a member already is an error."""
    keys = new.columns
    twice = new.join(members.select(*keys, F.lit(True).alias("__in")), keys, "left")
    return members.select(*keys).union(twice.where(F.assert_true(F.col("__in").isNull(), F.lit("already a member")).isNull()).select(*keys))


def removed_from(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Difference; what is no member is an error."""
    keys = gone.columns
    marked = members.select(*keys, F.lit(True).alias("__in")).join(gone.select(*keys, F.lit(True).alias("__gone")), keys, "full_outer")
    return marked.where(F.assert_true(F.col("__in").isNotNull(), F.lit("no such member")).isNull()).where("__gone is null").select(*keys)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(columns, side): rows that only one of two sets has."""
    return left.exceptAll(right).distinct().withColumn("side", F.lit("left")).union(right.exceptAll(left).distinct().withColumn("side", F.lit("right")))


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: equal, left_is_subset, common_count, from one full outer join on all columns."""
    keys = left.columns
    both = left.distinct().withColumn("__l", F.lit(True)).join(right.distinct().withColumn("__r", F.lit(True)), keys, "full_outer")
    only_left, only_right = total(F.col("__r").isNull()), total(F.col("__l").isNull())
    return both.agg(((only_left == 0) & (only_right == 0)).alias("equal"), (only_left == 0).alias("left_is_subset"), total(F.col("__l") & F.col("__r")).alias("common_count"))


def sample_differences(left: DataFrame, right: DataFrame, most: int = 8) -> DataFrame:
    """A few rows of each side, smallest first, for a message."""
    return least_of_each(differences(left, right), ["side"], list(left.columns), most)


def parent_chain(states: DataFrame, head: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(head, state_id, generation, step) from each head (state_id) to the first state.

    Steps double: every state knows its 2^k-th ancestor, so a chain of n states takes log2 n joins. Chains of
    several heads may meet. A chain that leads back to itself is an error.
    """
    jump = settled(states.select(F.col("state_id").alias("s"), F.col("parent_id").alias("p")))
    levels = [settled(head.select(F.col("state_id").alias("head"), "state_id", F.lit(0).cast("bigint").alias("step")).distinct())]
    width = 1
    while width <= most:
        reached = together(levels)
        ahead = settled(reached.join(jump, reached["state_id"] == jump["s"]).where("p is not null").select("head", F.col("p").alias("state_id"), (F.col("step") + width).alias("step")))
        if ahead.isEmpty():
            return reached.join(states.select("state_id", "generation"), "state_id").select("head", "state_id", "generation", "step")
        levels.append(ahead)
        if together(levels).groupBy("head", "state_id").count().where("count > 1").limit(1).count():
            raise ValueError("the chain has a cycle")
        j2 = jump.select(F.col("s").alias("__m"), F.col("p").alias("__q"))
        jump = settled(jump.join(j2, jump["p"] == j2["__m"], "left").select("s", F.col("__q").alias("p")))
        width = 2 * width
    raise ValueError("the chain does not end")


def append_state(states: DataFrame, new: dict, expected_head: str | None) -> DataFrame:
    """The log with one more state. Repeating an operation id changes nothing; a moved head is an error."""
    if states.where(F.col("operation_id") == new["operation_id"]).limit(1).count():
        return states
    head = states.where(F.col("project_id") == new["project_id"]).agg(F.max_by("state_id", "generation")).first()[0]
    if head != expected_head:
        raise ValueError("the head moved")
    row = states.sparkSession.createDataFrame([tuple(new[c] for c in states.columns)], states.schema)
    return states.union(row)
