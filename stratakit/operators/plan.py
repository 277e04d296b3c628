"""Plans that bring a working tree back to a snapshot, their checks and their effect."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.functions.paths import ancestors, companion, depth
from stratakit.operators.common import numbered_all, settled, total

COLUMNS = ["operation_type", "path", "before_hash", "before_size_bytes", "before_modified_at_utc", "after_hash", "after_size_bytes", "after_modified_at_utc"]


def _state(df: DataFrame, side: str) -> DataFrame:
    return df.select("path", F.col("object_id").alias(f"{side}_hash"), F.col("size_bytes").alias(f"{side}_size_bytes"), F.col("modified_at_utc").alias(f"{side}_modified_at_utc"), F.lit(True).alias(f"__{side}"))


def restore_plan(entries: DataFrame, working: DataFrame) -> DataFrame:
    """What turns ``working`` into ``entries``: restore, replace, setMetadata or delete; equal files need no row.

    before_* describes the working file, after_* the snapshot's; both come from one full outer join.
    """
    both = _state(entries, "after").join(_state(working, "before"), "path", "full_outer")
    kind = (
        F.when(F.col("__before").isNull(), "restore")
        .when(F.col("__after").isNull(), "delete")
        .when(~F.col("before_hash").eqNullSafe(F.col("after_hash")), "replace")
        .when(~F.col("before_modified_at_utc").eqNullSafe(F.col("after_modified_at_utc")), "setMetadata")
    )
    return both.withColumn("operation_type", kind).where("operation_type is not null").select(*COLUMNS)


def discard_plan(entries: DataFrame, working: DataFrame, selection: DataFrame) -> DataFrame:
    """The restore plan of the selected paths only; a path on neither side gives no row."""
    chosen = selection.select("path").distinct()
    return restore_plan(entries.join(chosen, "path", "left_semi"), working.join(chosen, "path", "left_semi"))


def covered(paths: DataFrame, selection: DataFrame) -> DataFrame:
    """Paths that are selected or lie below a selected folder: an equi-join on exploded ancestors, no nested loop."""
    chosen = selection.select(F.col("path").alias("__up")).distinct()
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("__up"))
    return up.join(chosen, "__up", "left_semi").select("path").distinct()


def with_companions(selection: DataFrame, known: DataFrame) -> DataFrame:
    """The selection and the companions of its paths that are known."""
    paths = known.select("path").distinct()
    more = selection.select(companion(F.col("path")).alias("path")).where("path is not null").join(paths, "path", "left_semi")
    return selection.select("path").union(more).distinct()


def selection_closure(requested: DataFrame, entries: DataFrame, working: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Companions and blockers, added until nothing changes. A blocker is a working file at a folder that a
    selected snapshot file needs, or a working file below a selected snapshot file's path."""
    known = settled(entries.select("path").union(working.select("path")).distinct())
    now = settled(covered(known, requested).union(requested.select("path")).distinct())
    size = now.count()
    for _ in range(most_rounds):
        wanted = now.join(entries.select("path"), "path", "left_semi")
        above = wanted.select(F.explode(ancestors(F.col("path"))).alias("path")).join(working.select("path"), "path", "left_semi")
        below = covered(working.select("path"), wanted)
        now = settled(with_companions(now.union(above).union(below), known))
        grown = now.count()
        if grown == size:
            return now
        size = grown
    raise RuntimeError("the selection did not settle")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts by type, bytes to stage (restore and replace) and to back up (delete and replace)."""
    kind = F.col("operation_type")
    staged = total(kind.isin("restore", "replace"), "after_size_bytes")
    backup = total(kind.isin("delete", "replace"), "before_size_bytes")
    return plan.agg(
        total(kind == "restore").alias("restore_count"), total(kind == "replace").alias("replace_count"),
        total(kind == "delete").alias("delete_count"), total(kind == "setMetadata").alias("metadata_count"),
        staged.alias("staged_bytes"), backup.alias("backup_bytes"), (staged + backup).alias("total_bytes"),
    )


def required_bytes(plan: DataFrame) -> DataFrame:
    kind, zero = F.col("operation_type"), F.lit(0).cast("bigint")
    before, after = F.coalesce("before_size_bytes", zero), F.coalesce("after_size_bytes", zero)
    repository = total(kind.isin("restore", "replace"), after) + total(kind.isin("delete", "replace"), before)
    project = total(None, F.when(kind == "restore", after).when(kind == "replace", F.greatest(zero, after - before)).otherwise(zero))
    return plan.agg(repository.alias("repository_bytes"), project.alias("project_bytes"))


def shape_violations(plan: DataFrame, summary: DataFrame) -> DataFrame:
    """(field, stated, derived) where a stored one-row summary and its plan disagree, and repeated paths."""
    derived = plan_summary(plan)
    names = derived.columns
    stack = lambda df, out: df.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, cast({n} as bigint)' for n in names)}) as (field, {out})"))
    wrong = stack(summary, "stated").join(stack(derived, "derived"), "field").where("not stated <=> derived")
    repeats = plan.groupBy("path").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return wrong.select("field", "stated", "derived").union(repeats.select(F.lit("repeated paths"), F.lit(0).cast("bigint"), "n"))


def operation_violations(operations: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, operation_type, problem): each type has its own rule about before_*, after_* and the snapshot's entry."""
    snapshot = entries.select("path", F.col("object_id").alias("__h"), F.col("size_bytes").alias("__s"), F.col("modified_at_utc").alias("__m"), F.lit(True).alias("__in"))
    joined = operations.join(snapshot, "path", "left")
    c = F.col
    before = [c("before_hash"), c("before_size_bytes"), c("before_modified_at_utc")]
    after = [c("after_hash"), c("after_size_bytes"), c("after_modified_at_utc")]
    every = lambda cols, f: f(cols[0]) & f(cols[1]) & f(cols[2])
    null, given = (lambda x: x.isNull()), (lambda x: x.isNotNull())
    to_entry = c("after_hash").eqNullSafe(c("__h")) & c("after_size_bytes").eqNullSafe(c("__s")) & c("after_modified_at_utc").eqNullSafe(c("__m"))
    same_content = c("before_hash").eqNullSafe(c("__h")) & c("before_size_bytes").eqNullSafe(c("__s"))
    kind, here = c("operation_type"), c("__in").isNotNull()
    problem = (
        F.when((kind != "delete") & ~here, "missing snapshot entry")
        .when((kind == "restore") & ~(every(before, null) & to_entry), "invalid restore")
        .when((kind == "replace") & ~(every(before, given) & to_entry), "invalid replace")
        .when((kind == "delete") & ~(every(before, given) & every(after, null) & ~here), "invalid delete")
        .when((kind == "setMetadata") & ~(every(before, given) & same_content & to_entry & ~c("before_modified_at_utc").eqNullSafe(c("after_modified_at_utc"))), "invalid metadata")
        .when(~kind.isin("restore", "replace", "delete", "setMetadata"), "unknown type")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select("path", "operation_type", "problem")


def before_mismatches(operations: DataFrame, working: DataFrame) -> DataFrame:
    """Operations whose file is no longer in the state they were planned for (null-safe; a missing file is all null)."""
    now = working.select("path", F.col("object_id").alias("__h"), F.col("size_bytes").alias("__s"), F.col("modified_at_utc").alias("__m"))
    same = F.col("before_hash").eqNullSafe(F.col("__h")) & F.col("before_size_bytes").eqNullSafe(F.col("__s")) & F.col("before_modified_at_utc").eqNullSafe(F.col("__m"))
    return operations.join(now, "path", "left").where(~same).select("path", "operation_type")


def apply_plan(working: DataFrame, plan: DataFrame) -> DataFrame:
    """The working tree after the plan: (path, object_id, size_bytes, modified_at_utc)."""
    todo = plan.select("path", "operation_type", "after_hash", "after_size_bytes", "after_modified_at_utc")
    both = working.select("path", "object_id", "size_bytes", "modified_at_utc").join(todo, "path", "full_outer").where(~F.col("operation_type").eqNullSafe(F.lit("delete")))
    planned = F.col("operation_type").isNotNull()
    pick = lambda new, old: F.when(planned, F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select("path", pick("after_hash", "object_id"), pick("after_size_bytes", "size_bytes"), pick("after_modified_at_utc", "modified_at_utc"))


def inverse(plan: DataFrame) -> DataFrame:
    """The plan that undoes ``plan``: sides swapped, restore and delete exchanged."""
    kind = F.when(F.col("operation_type") == "restore", "delete").when(F.col("operation_type") == "delete", "restore").otherwise(F.col("operation_type"))
    swap = lambda c: c.replace("before_", "~").replace("after_", "before_").replace("~", "after_")
    return plan.select(kind.alias("operation_type"), "path", *[F.col(swap(c)).alias(c) for c in COLUMNS[2:]])


def directories(plan: DataFrame, working: DataFrame) -> DataFrame:
    """(action, path, depth, position): folders that lose their last file go deepest first, missing ones come by path."""
    after = apply_plan(working, plan)
    folders = lambda df: df.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    old, new = folders(working), folders(after)
    gone = old.join(new, "path", "left_anti").select(F.lit("remove").alias("action"), "path", depth(F.col("path")).alias("depth"))
    come = new.join(old, "path", "left_anti").select(F.lit("create").alias("action"), "path", depth(F.col("path")).alias("depth"))
    return numbered_all(gone, [-F.col("depth"), "path"], start=1).union(numbered_all(come, ["path"], start=1))


def topology_blockers(operations: DataFrame, working: DataFrame) -> DataFrame:
    """Working files at a folder that an operation writes below, and not removed by the plan itself."""
    written = operations.where("operation_type in ('restore', 'replace')").select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    removed = operations.where("operation_type = 'delete'").select("path")
    return working.select("path").join(written, "path", "left_semi").join(removed, "path", "left_anti")


def digest(rows: DataFrame, order: list[str], values: list[str], groups: list[str] = (), out: str = "digest") -> DataFrame:
    """SHA-256 over a group's rows in order, each value with its length before it, so that no two row sets read alike."""
    item = F.concat(*[F.concat(F.length(F.coalesce(F.col(v).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(v).cast("string"), F.lit(""))) for v in values])
    listed = F.array_sort(F.collect_list(F.struct(*order, item.alias("__item"))))
    return rows.groupBy(*groups).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["__item"]), "|"), 256).alias(out))


def plan_id(plan: DataFrame) -> DataFrame:
    """One row: the hash of the sorted operations; a plan may be applied only while its id stays the same.

    Rows are digested by folder first, so that no task holds the whole plan's text.
    """
    named = plan.withColumn("__folder", F.coalesce(F.element_at(ancestors(F.col("path")), -1), F.lit("")))
    by_folder = digest(named, ["path"], COLUMNS, ["__folder"], "d")
    return digest(by_folder, ["__folder"], ["__folder", "d"], out="plan_id")


def mac(plan_identity: str, key: bytes) -> str:
    return hmac.new(key, plan_identity.encode(), hashlib.sha256).hexdigest()


def mac_matches(plan_identity: str, key: bytes, stated: str) -> bool:
    return hmac.compare_digest(mac(plan_identity, key), stated)


def is_redundant(entries: DataFrame, working: DataFrame, n_warnings: int = 0) -> bool:
    """After a full restore a new plan must be empty, and nothing may have been warned of."""
    return n_warnings == 0 and restore_plan(entries, working).isEmpty()


def scope_violations(requested: DataFrame, selected: DataFrame, entries: DataFrame, working: DataFrame) -> DataFrame:
    """(path, side): a stated selection must be exactly the closure of what was requested."""
    right = selection_closure(requested, entries, working)
    missing = right.join(selected.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("side"))
    return missing.union(selected.select("path").join(right, "path", "left_anti").select("path", F.lit("extra").alias("side")))


