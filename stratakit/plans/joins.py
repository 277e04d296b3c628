"""Queries that are joins: diffs, plans, coverage, references, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.operators import diff, gc, history, inventory, plan, recovery
from stratakit.operators.common import total
from stratakit.plans.registry import query
from stratakit.sources import scan

DIFF = """
SELECT coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN '{missing}'
       WHEN a.{v} IS NOT DISTINCT FROM b.{v} AND a.modified_at_utc IS NOT DISTINCT FROM b.modified_at_utc THEN 'unchanged' ELSE 'modified' END AS change_type,
  a.{v} AS before_{v}, b.{v} AS after_{v}, a.modified_at_utc AS before_modified_at_utc, b.modified_at_utc AS after_modified_at_utc
FROM entries_a a FULL JOIN working_b b ON a.path = b.path"""
CONTENT = DIFF.format(v="object_id", missing="deleted")
KINDS = ", ".join(f"count(*) FILTER (WHERE change_type = '{k}') AS {k}_count" for k in ("added", "modified", "deleted", "unchanged", "unknown"))


@query("jon01_diff_detail", CONTENT)
def _(d):
    return diff.content_diff(d.entries_a, d.working_b)


@query("jon01_diff_incomplete", f"SELECT change_type, count(*) AS n FROM ({DIFF.format(v='object_id', missing='unknown')}) GROUP BY change_type")
def _(d):
    return diff.content_diff(d.entries_a, d.working_b, complete=False).groupBy("change_type").agg(total().alias("n"))


@query("jon02_metadata_diff", DIFF.format(v="size_bytes", missing="deleted"))
def _(d):
    return diff.metadata_diff(d.entries_a, d.working_b)


@query("jon03_snapshot_diff", """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.object_id = b.object_id AND a.size_bytes = b.size_bytes THEN 'unchanged' ELSE 'modified' END AS change_type,
  a.object_id AS before_object_id, b.object_id AS after_object_id, a.size_bytes AS before_size_bytes, b.size_bytes AS after_size_bytes
FROM (SELECT path, max(object_id) AS object_id, max(size_bytes) AS size_bytes FROM sized_entries WHERE snapshot_id % 3 = 0 GROUP BY path) a
FULL JOIN (SELECT path, max(object_id) AS object_id, max(size_bytes) AS size_bytes FROM sized_entries WHERE snapshot_id % 3 = 1 GROUP BY path) b ON a.path = b.path""")
def _(d):
    side = lambda k: d.sized_entries.where(F.col("snapshot_id") % 3 == k).groupBy("path").agg(F.max("object_id").alias("object_id"), F.max("size_bytes").alias("size_bytes"))
    return diff.compare(side(0), side(1), ["path"], ["object_id", "size_bytes"])


@query("agg11_diff_summary", f"SELECT {KINDS} FROM ({CONTENT})")
def _(d):
    return diff.diff_summary(diff.content_diff(d.entries_a, d.working_b))


@query("flt09_change_filter", f"SELECT path, change_type FROM ({CONTENT}) WHERE change_type = 'modified'")
def _(d):
    return diff.of_type(diff.content_diff(d.entries_a, d.working_b), "modified").select("path", "change_type")


@query("flt12_actionable", f"SELECT transaction_id, (n % 4 <> 0) AND (n % 3 <> 0) AND unknown_n = 0 AND n % 2 = 0 AS actionable FROM (SELECT transaction_id, count(*) AS n, count(*) FILTER (WHERE role = 'system') AS unknown_n FROM journal_steps GROUP BY transaction_id)")
def _(d):
    rows = d.journal_steps.groupBy("transaction_id").agg(total().alias("n"), total(F.col("role") == "system").alias("u"))
    return rows.select("transaction_id", diff.actionable(F.col("n") % 4 == 0, F.col("n") % 3 != 0, F.col("u"), F.col("n") % 2).alias("actionable"))


@query("set08_typed_concat", f"SELECT path, change_type FROM ({CONTENT}) WHERE change_type IN ('added', 'modified', 'deleted')")
def _(d):
    found = diff.content_diff(d.entries_a, d.working_b)
    part = lambda k: diff.of_type(found, k).select("path")
    return diff.concatenated(part("added"), part("modified"), part("deleted"))


PLAN = """
SELECT * FROM (SELECT CASE WHEN b.path IS NULL THEN 'restore' WHEN a.path IS NULL THEN 'delete' WHEN a.object_id IS DISTINCT FROM b.object_id THEN 'replace'
    WHEN a.modified_at_utc IS DISTINCT FROM b.modified_at_utc THEN 'setMetadata' END AS operation_type, coalesce(a.path, b.path) AS path,
  b.object_id AS before_hash, b.size_bytes AS before_size_bytes, b.modified_at_utc AS before_modified_at_utc,
  a.object_id AS after_hash, a.size_bytes AS after_size_bytes, a.modified_at_utc AS after_modified_at_utc
FROM entries_a a FULL JOIN working_b b ON a.path = b.path) WHERE operation_type IS NOT NULL"""
SUMS = """CAST(coalesce(sum(after_size_bytes) FILTER (WHERE operation_type IN ('restore', 'replace')), 0) AS BIGINT) AS staged_bytes,
  CAST(coalesce(sum(before_size_bytes) FILTER (WHERE operation_type IN ('delete', 'replace')), 0) AS BIGINT) AS backup_bytes"""
PLAN_SUMMARY = f"""SELECT count(*) FILTER (WHERE operation_type = 'restore') AS restore_count, count(*) FILTER (WHERE operation_type = 'replace') AS replace_count,
  count(*) FILTER (WHERE operation_type = 'delete') AS delete_count, count(*) FILTER (WHERE operation_type = 'setMetadata') AS metadata_count, {SUMS}"""


@query("jon04_restore_plan", PLAN)
def _(d):
    return plan.restore_plan(d.entries_a, d.working_b)


@query("jon05_discard_plan", f"SELECT * FROM ({PLAN}) WHERE path IN (SELECT path FROM selection)")
def _(d):
    return plan.discard_plan(d.entries_a, d.working_b, d.selection)


@query("agg09_plan_summary", f"SELECT *, staged_bytes + backup_bytes AS total_bytes FROM ({PLAN_SUMMARY} FROM ({PLAN}))")
def _(d):
    return plan.plan_summary(plan.restore_plan(d.entries_a, d.working_b))


@query("agg27_required_bytes", f"""SELECT staged_bytes + backup_bytes AS repository_bytes, project_bytes FROM (SELECT {SUMS},
  CAST(coalesce(sum(CASE operation_type WHEN 'restore' THEN after_size_bytes WHEN 'replace' THEN greatest(0, after_size_bytes - before_size_bytes) ELSE 0 END), 0) AS BIGINT) AS project_bytes FROM ({PLAN}))""")
def _(d):
    return plan.required_bytes(plan.restore_plan(d.entries_a, d.working_b))


@query("snk16_apply_plan", "SELECT path, object_id, size_bytes, modified_at_utc FROM entries_a")
def _(d):
    return plan.apply_plan(d.working_b, plan.restore_plan(d.entries_a, d.working_b))


@query("snk19_rollback", "SELECT path, object_id, size_bytes, modified_at_utc FROM working_b")
def _(d):
    todo = plan.restore_plan(d.entries_a, d.working_b)
    return plan.apply_plan(plan.apply_plan(d.working_b, todo), plan.inverse(todo))


@query("cmp02_restore_is_redundant", "SELECT CAST(0 AS BIGINT) AS remaining_operations, count(*) AS file_count FROM entries_a")
def _(d):
    after = plan.apply_plan(d.working_b, plan.restore_plan(d.entries_a, d.working_b))
    return plan.restore_plan(d.entries_a, after).agg(total().alias("remaining_operations")).join(after.agg(total().alias("file_count")))


@query("flt13_plan_shape", f"SELECT 'total_bytes' AS field, staged_bytes + backup_bytes + 1 AS stated, staged_bytes + backup_bytes AS derived FROM ({PLAN_SUMMARY} FROM ({PLAN}))")
def _(d):
    todo = plan.restore_plan(d.entries_a, d.working_b)
    return plan.shape_violations(todo, plan.plan_summary(todo).withColumn("total_bytes", F.col("total_bytes") + 1))


@query("jon06_hash_reuse", """
SELECT w.path, CASE WHEN w.fingerprint = c.fingerprint AND w.size_bytes = c.size_bytes AND w.size_bytes = a.size_bytes AND w.modified_at_utc = a.modified_at_utc AND c.object_id = a.object_id THEN c.object_id END AS reused_id
FROM working_b w LEFT JOIN fingerprint_cache c ON w.path = c.path LEFT JOIN entries_a a ON w.path = a.path""")
def _(d):
    return scan.reusable(d.working_b, d.fingerprint_cache, d.entries_a).select("path", "reused_id")


@query("jon07_missing_refs", """
SELECT r.object_id, r.size_bytes AS expected_size_bytes, o.size_bytes AS present_size_bytes, CASE WHEN o.object_id IS NULL THEN 'missing' ELSE 'size mismatch' END AS problem
FROM live_refs r LEFT JOIN objects o ON r.object_id = o.object_id WHERE o.object_id IS NULL OR o.size_bytes <> r.size_bytes""")
def _(d):
    return gc.reference_problems(d.live_refs, d.objects)


@query("jon08_unreferenced", "SELECT object_id, size_bytes FROM objects WHERE object_id NOT IN (SELECT object_id FROM live_refs)")
def _(d):
    return gc.unreferenced(d.objects, d.live_refs, ["object_id"])


@query("jon09_unreferenced_chunks", "SELECT c.kind, c.id FROM (SELECT p_size % 2 AS kind, CAST(p_partkey AS BIGINT) AS id FROM part) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 0 AS kind, CAST(l_partkey AS BIGINT) AS id FROM lineitem WHERE l_orderkey % 3 = 0) l WHERE l.kind = c.kind AND l.id = c.id)")
def _(d):
    chunks = d.part.select((F.col("p_size") % 2).alias("kind"), F.col("p_partkey").cast("bigint").alias("id"))
    live = d.lineitem.where("l_orderkey % 3 = 0").select(F.lit(0).alias("kind"), F.col("l_partkey").cast("bigint").alias("id"))
    return gc.unreferenced(chunks, live, ["kind", "id"])


@query("jon10_unreachable_states", "SELECT state_id FROM states WHERE generation % 10 <> 9 AND project_id % 2 = 0")
def _(d):
    heads = d.states.where("generation % 10 = 9 or project_id % 2 = 1").select(F.col("state_id").alias("node"))
    return gc.unreferenced(d.states.select("state_id"), heads.select(F.col("node").alias("state_id")), ["state_id"])


@query("jon11_retain_visible", "SELECT s.path FROM selection s WHERE s.path IN (SELECT path FROM working_b)")
def _(d):
    return d.selection.join(d.working_b.select("path"), "path", "left_semi").select("path")


@query("jon12_retain_pending", "SELECT transaction_id, role FROM journal_steps WHERE transaction_id IN (SELECT transaction_id FROM journals WHERE state NOT IN ('committed', 'recovered')) AND generation = 0")
def _(d):
    return recovery.still_pending(d.journal_steps.where("generation = 0"), recovery.pending(d.journals)).select("transaction_id", "role")


@query("jon13_prune_overrides", "SELECT snapshot_id, name FROM overrides WHERE snapshot_id IN (SELECT snapshot_id FROM snapshots WHERE project_id % 2 = 0)")
def _(d):
    return history.pruned(d.overrides, d.snapshots.where("project_id % 2 = 0"))


@query("jon14_companions", r"""
SELECT path FROM asset_selection UNION
SELECT other FROM (SELECT CASE WHEN path LIKE 'Assets/%' THEN CASE WHEN path LIKE '%.meta' THEN left(path, length(path) - 5) ELSE path || '.meta' END END AS other FROM asset_selection) WHERE other IN (SELECT path FROM assets)""")
def _(d):
    return plan.with_companions(d.asset_selection, d.assets)


@query("jon15_prefix_cover", "SELECT DISTINCT w.path FROM working_b w JOIN selected_folders s ON w.path = s.path OR starts_with(w.path, s.path || '/')")
def _(d):
    return plan.covered(d.working_b, d.selected_folders)


@query("jon16_ancestor_conflict", """
WITH tree AS (SELECT path FROM entries_a UNION SELECT DISTINCT 'Assets/' || source || '/fr' FROM documents WHERE source IN ('src2', 'src7'))
SELECT b.path, a.path AS above FROM tree a JOIN tree b ON starts_with(b.path, a.path || '/')""")
def _(d):
    from stratakit.functions.paths import ancestors

    tree = d.entries_a.select("path").union(d.documents.where("source in ('src2', 'src7')").select(F.concat(F.lit("Assets/"), "source", F.lit("/fr")))).distinct()
    up = tree.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    return up.join(tree.select(F.col("path").alias("above")), "above", "left_semi").select("path", "above")


@query("jon18_conflicts", """
SELECT o.path, o.operation_type, w.object_id AS current_hash, w.size_bytes, w.modified_at_utc,
  coalesce(w.path IS NOT NULL AND operation_type = 'setMetadata' AND same_before AND third, FALSE) AS metadata_only, operation_type = 'setMetadata' AND NOT same_before AS failed
FROM (SELECT o.*, coalesce(o.before_hash = w.object_id AND o.before_size_bytes = w.size_bytes, FALSE) AS same_before, coalesce(o.after_hash = w.object_id AND o.after_size_bytes = w.size_bytes, FALSE) AS same_after,
        o.before_modified_at_utc IS DISTINCT FROM w.modified_at_utc AND o.after_modified_at_utc IS DISTINCT FROM w.modified_at_utc AS third
      FROM operations o LEFT JOIN working_b w ON o.path = w.path) o LEFT JOIN working_b w ON o.path = w.path
WHERE CASE operation_type WHEN 'restore' THEN w.path IS NOT NULL AND NOT same_after WHEN 'replace' THEN w.path IS NOT NULL AND NOT same_before AND NOT same_after
  WHEN 'delete' THEN w.path IS NOT NULL AND NOT same_before ELSE NOT same_before OR third END""")
def _(d):
    return recovery.conflicts(d.operations, d.working_b)


@query("jon19_before_state", """
SELECT o.path, o.operation_type FROM operations o LEFT JOIN working_b w ON o.path = w.path
WHERE o.before_hash IS DISTINCT FROM w.object_id OR o.before_size_bytes IS DISTINCT FROM w.size_bytes OR o.before_modified_at_utc IS DISTINCT FROM w.modified_at_utc""")
def _(d):
    return plan.before_mismatches(d.operations, d.working_b)


@query("flt16_preconditions", """
SELECT o.operation_type, count(*) AS n FROM operations o LEFT JOIN working_b w ON o.path = w.path
WHERE o.before_hash IS DISTINCT FROM w.object_id OR o.before_size_bytes IS DISTINCT FROM w.size_bytes OR o.before_modified_at_utc IS DISTINCT FROM w.modified_at_utc GROUP BY 1""")
def _(d):
    return plan.before_mismatches(d.operations, d.working_b).groupBy("operation_type").agg(total().alias("n"))


@query("flt14_op_validity", """
SELECT path, operation_type, problem FROM (
  SELECT o.path, operation_type, CASE
    WHEN operation_type <> 'delete' AND e.path IS NULL THEN 'missing snapshot entry'
    WHEN operation_type = 'restore' AND NOT (before_hash IS NULL AND before_size_bytes IS NULL AND before_modified_at_utc IS NULL AND to_entry) THEN 'invalid restore'
    WHEN operation_type = 'replace' AND NOT (before_hash IS NOT NULL AND before_size_bytes IS NOT NULL AND before_modified_at_utc IS NOT NULL AND to_entry) THEN 'invalid replace'
    WHEN operation_type = 'delete' AND NOT (before_hash IS NOT NULL AND before_size_bytes IS NOT NULL AND before_modified_at_utc IS NOT NULL AND after_hash IS NULL AND after_size_bytes IS NULL AND after_modified_at_utc IS NULL AND e.path IS NULL) THEN 'invalid delete'
    WHEN operation_type = 'setMetadata' AND NOT (before_hash IS NOT NULL AND before_size_bytes IS NOT NULL AND before_modified_at_utc IS NOT NULL AND before_hash IS NOT DISTINCT FROM e.object_id AND before_size_bytes IS NOT DISTINCT FROM e.size_bytes AND to_entry AND before_modified_at_utc IS DISTINCT FROM after_modified_at_utc) THEN 'invalid metadata' END AS problem
  FROM (SELECT o.*, o.after_hash IS NOT DISTINCT FROM e.object_id AND o.after_size_bytes IS NOT DISTINCT FROM e.size_bytes AND o.after_modified_at_utc IS NOT DISTINCT FROM e.modified_at_utc AS to_entry FROM operations o LEFT JOIN entries_a e ON o.path = e.path) o
  LEFT JOIN entries_a e ON o.path = e.path) WHERE problem IS NOT NULL""")
def _(d):
    return plan.operation_violations(d.operations, d.entries_a)


@query("flt15_topology", """
SELECT path FROM (SELECT path FROM working_b UNION ALL SELECT 'Assets/' || source || '/de' FROM documents GROUP BY source) w
WHERE EXISTS (SELECT 1 FROM operations o WHERE o.operation_type IN ('restore', 'replace') AND starts_with(o.path, w.path || '/')) AND path NOT IN (SELECT path FROM operations WHERE operation_type = 'delete')""")
def _(d):
    folders = d.documents.select(F.concat(F.lit("Assets/"), "source", F.lit("/de")).alias("path")).distinct()
    return plan.topology_blockers(d.operations, d.working_b.select("path").union(folders))


@query("jon20_conflict_groups", r"""
SELECT regexp_replace(path, '\.meta$', '') AS id, string_agg(path, ',' ORDER BY path) AS paths, CAST(sum(greatest(0, size_bytes)) AS BIGINT) AS size_bytes FROM (SELECT DISTINCT path, size_bytes FROM assets) GROUP BY 1""")
def _(d):
    return recovery.grouped_conflicts(d.assets.select("path", "size_bytes").distinct())


@query("agg18_group_sizes", r"""SELECT regexp_replace(path, '\.meta$', '') AS id, CAST(sum(greatest(0, size_bytes)) AS BIGINT) AS size_bytes FROM assets GROUP BY 1""")
def _(d):
    return recovery.grouped_conflicts(d.assets).select("id", "size_bytes")


@query("jon21_orphan_payload", "SELECT DISTINCT p.transaction_id FROM journal_steps p WHERE p.transaction_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM journals j WHERE j.transaction_id = p.transaction_id AND j.state = 'staged')")
def _(d):
    payload = d.journal_steps.where("transaction_id % 3 = 0").select("transaction_id").distinct()
    return gc.unreferenced(payload, d.journals.where("state = 'staged'"), ["transaction_id"])


@query("jon22_scope", """
SELECT coalesce(r.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' ELSE 'extra' END AS side
FROM (SELECT path FROM entries_a WHERE path IN (SELECT path FROM selection) UNION SELECT path FROM working_b WHERE path IN (SELECT path FROM selection) UNION SELECT path FROM selection) r
FULL JOIN (SELECT path FROM selection WHERE length(path) % 2 = 0 UNION SELECT path FROM entries_a WHERE doc_id % 50 = 1) s ON r.path = s.path WHERE r.path IS NULL OR s.path IS NULL""")
def _(d):
    stated = d.selection.where("length(path) % 2 = 0").union(d.entries_a.where("doc_id % 50 = 1").select("path")).distinct()
    return plan.scope_violations(d.selection, stated, d.entries_a, d.working_b)


@query("jon23_remove_project", "SELECT project_id, snapshot_id FROM snapshots WHERE project_id <> 7")
def _(d):
    return d.snapshots.where(~F.col("project_id").eqNullSafe(F.lit(7))).select("project_id", "snapshot_id")


@query("jon24_still_registered", "SELECT DISTINCT project_id FROM snapshots WHERE project_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(d):
    known = d.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("project_id"))
    return d.snapshots.select("project_id").distinct().join(known, "project_id", "left_semi")


@query("flt19_unresolved_quarantine", """
WITH records AS (SELECT conv_id AS quarantine_id, '2024-01-' || lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0') AS quarantined_at_utc, conv_id % 6 <> 5 AS readable, conv_id % 4 = 1 AS verified_before, 'd' || CAST(conv_id AS STRING) AS digest FROM conversations WHERE turn = 0 AND conv_id % 7 <> 0)
SELECT quarantine_id, quarantined_at_utc, 'unresolved' AS reason FROM records WHERE readable AND NOT verified_before AND quarantine_id % 5 <> 2
UNION ALL SELECT quarantine_id, NULL, 'unreadable' FROM records WHERE NOT readable
UNION ALL SELECT DISTINCT conv_id, NULL, 'orphan payload' FROM conversations WHERE conv_id NOT IN (SELECT quarantine_id FROM records)""")
def _(d):
    first = d.conversations.where("turn = 0 and conv_id % 7 <> 0")
    at = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("conv_id") % 28).cast("string"), 2, "0"))
    records = first.select(F.col("conv_id").alias("quarantine_id"), at.alias("quarantined_at_utc"), (F.col("conv_id") % 6 != 5).alias("readable"), (F.col("conv_id") % 4 == 1).alias("verified_before"), F.concat(F.lit("d"), "conv_id").alias("digest"))
    resolutions = records.where("quarantine_id % 5 = 2").select("quarantine_id", "digest")
    return recovery.unresolved_quarantine(records, resolutions, d.conversations.select(F.col("conv_id").alias("quarantine_id")))


@query("flt22_payload_check", "SELECT transaction_id, 'Assets/' || role AS path, role <> 'system' AS known FROM (SELECT DISTINCT transaction_id, role FROM journal_steps)")
def _(d):
    payload = d.journal_steps.select("transaction_id", F.concat(F.lit("Assets/"), "role").alias("path")).distinct()
    return recovery.payload_check(payload, payload.where("path <> 'Assets/system'"))


@query("flt23_needs_rollback", """
SELECT j.transaction_id, state = 'applying' OR transaction_id IN (SELECT transaction_id FROM journal_steps WHERE role = 'tool')
  OR (state = 'staged' AND transaction_id IN (SELECT o.transaction_id FROM operations o JOIN working_b w ON o.path = w.path AND o.after_hash = w.object_id WHERE length(o.path) % 2 = 1)) AS needs_rollback FROM journals j""")
def _(d):
    backups = d.journal_steps.where("role = 'tool'").select("transaction_id", F.lit("backup").alias("side"), F.lit("x").alias("path"))
    staged = d.operations.where("length(path) % 2 = 0").select("transaction_id", F.lit("staged").alias("side"), "path")
    return recovery.needs_rollback(d.journals, d.operations, backups.union(staged), d.working_b)


@query("set02_both_ways", "(SELECT path, 'left' AS side FROM (SELECT path FROM entries_a EXCEPT SELECT path FROM working_b)) UNION ALL (SELECT path, 'right' FROM (SELECT path FROM working_b EXCEPT SELECT path FROM entries_a))")
def _(d):
    return inventory.differences(d.entries_a.select("path"), d.working_b.select("path"))
