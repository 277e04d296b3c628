"""Queries for whole entry points, and for what is left of the writes and codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratakit.functions.paths import is_object_temp, is_owned_temp
from stratakit.operators import diff, history, inventory, plan, recovery, refs, verify
from stratakit.operators.common import total
from stratakit.plans.aggregates import MEMBERS
from stratakit.plans.columns import TEMP
from stratakit.plans.joins import CONTENT, DIFF, KINDS, PLAN, PLAN_SUMMARY
from stratakit.plans.registry import query


@query("snk05_publish", f"SELECT project_id, count(*) AS members, max(snapshot_id) AS newest FROM (({MEMBERS}) UNION SELECT DISTINCT project_id, 'z-new' FROM states) GROUP BY 1")
def _(d):
    new = d.states.select("project_id").distinct().withColumn("snapshot_id", F.lit("z-new"))
    grown = inventory.added_to(inventory.membership(d.states), new)
    return grown.groupBy("project_id").agg(total().alias("members"), F.max("snapshot_id").alias("newest"))


@query("snk17_export", "SELECT o.path FROM operations o JOIN working_b w ON o.path = w.path WHERE o.operation_type = 'restore' AND (o.after_hash IS DISTINCT FROM w.object_id OR o.after_size_bytes IS DISTINCT FROM w.size_bytes) AND length(o.path) % 2 = 1")
def _(d):
    found = recovery.conflicts(d.operations.where("operation_type = 'restore'"), d.working_b)
    chosen = found.where("length(path) % 2 = 1").select("path")
    return found.join(chosen, "path", "left_semi").select("path")


@query("snk18_event_lines", """SELECT event_id, '{"id":' || CAST(event_id AS STRING) || ',"type":"' || event_type || '"}' AS line FROM events""")
def _(d):
    return d.events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("line"))


@query("snk21_resolutions", "SELECT conv_id AS quarantine_id FROM conversations WHERE turn = 0 AND conv_id % 3 <> 0 AND NOT (conv_id % 3 = 1 AND conv_id % 2 = 0)")
def _(d):
    first = d.conversations.where("turn = 0 and conv_id % 3 <> 0")
    records = first.select(F.col("conv_id").alias("quarantine_id"), F.lit("t").alias("quarantined_at_utc"), F.lit(True).alias("readable"), F.lit(False).alias("verified_before"), F.col("conv_id").cast("string").alias("digest"))
    # a resolution of another digest resolves nothing
    given = records.where("quarantine_id % 2 = 0").select("quarantine_id", F.when(F.col("quarantine_id") % 3 == 1, F.col("digest")).otherwise("old").alias("digest"))
    return recovery.unresolved_quarantine(records, given, records).select("quarantine_id")


@query("jon17_adjacent_keys", "SELECT shard, position, key, previous FROM (SELECT page_id % 10 AS shard, page_id AS position, lower(url) AS key, lag(lower(url)) OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS previous FROM pages) WHERE previous >= key")
def _(d):
    listed = d.pages.select((F.col("page_id") % 10).alias("shard"), F.col("page_id").alias("position"), F.lower("url").alias("key"))
    return verify.adjacent(listed, ["shard"], "key")


def next_index(count: Column, current: Column, key: Column, page: int = 10) -> Column:
    """Where a key press leads in a list; nothing selected is -1."""
    last, none = count - 1, current < 0
    forward, backward = (lambda n: F.when(none, 0).otherwise(F.least(last, current + n))), (lambda n: F.when(none, last).otherwise(F.greatest(F.lit(0), current - n)))
    moved = F.when(key == "Home", 0).when(key == "End", last).when(key == "ArrowDown", forward(1)).when(key == "ArrowUp", backward(1)).when(key == "PageDown", forward(page)).when(key == "PageUp", backward(page)).otherwise(current)
    return F.when(count <= 0, -1).otherwise(moved).cast("bigint")


@query("lim05_page_navigation", """
SELECT doc_id, CAST(CASE WHEN n = 0 THEN -1 WHEN k = 0 THEN 0 WHEN k = 1 THEN n - 1 WHEN k = 2 THEN CASE WHEN c < 0 THEN 0 ELSE least(n - 1, c + 1) END WHEN k = 3 THEN CASE WHEN c < 0 THEN n - 1 ELSE greatest(0, c - 1) END
  WHEN k = 4 THEN CASE WHEN c < 0 THEN 0 ELSE least(n - 1, c + 10) END WHEN k = 5 THEN CASE WHEN c < 0 THEN n - 1 ELSE greatest(0, c - 10) END ELSE c END AS BIGINT) AS next FROM (SELECT doc_id, doc_id % 31 AS n, doc_id % 29 - 1 AS c, doc_id % 7 AS k FROM documents)""")
def _(d):
    i = F.col("doc_id")
    key = F.element_at(F.array(*map(F.lit, ("Home", "End", "ArrowDown", "ArrowUp", "PageDown", "PageUp", "x"))), (i % 7 + 1).cast("int"))
    return d.documents.select("doc_id", next_index(i % 31, i % 29 - 1, key).alias("next"))


def envelope_problem(data: Column, magic: str, version: int) -> Column:
    """Why a record's envelope is wrong: magic, version (two digits), flags (two zeros), length of the rest (eight digits)."""
    rest = F.length(data) - F.lit(len(magic) + 12)
    part = lambda at, n: F.substring(data, len(magic) + at, n)
    return (
        F.when(rest < 0, "too short").when(F.substring(data, 1, len(magic)) != magic, "wrong magic")
        .when(~part(1, 12).rlike("^[0-9]{12}$"), "not a number").when(part(1, 2).cast("int") != version, "unknown version")
        .when(part(3, 2) != "00", "unknown flags").when(part(5, 8).cast("bigint") != rest, "wrong length")
    )


ENVELOPE = "CASE doc_id % 6 WHEN 0 THEN 'STRA0200' || lpad(CAST(length(lang) AS STRING), 8, '0') || lang WHEN 1 THEN 'STRX020000000002xx' WHEN 2 THEN 'STRA0300' || '00000002xx' WHEN 3 THEN 'STRA020100000002xx' WHEN 4 THEN 'STRA020000000009xx' ELSE 'STRA' END"


@query("cas05_envelope", "SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'wrong magic' WHEN 2 THEN 'unknown version' WHEN 3 THEN 'unknown flags' WHEN 4 THEN 'wrong length' WHEN 5 THEN 'too short' END AS problem FROM documents")
def _(d):
    return d.documents.select("doc_id", envelope_problem(F.expr(ENVELOPE), "STRA", 2).alias("problem"))


@query("cas06_row_codec", "SELECT path, size_bytes, object_id FROM entries_a")
def _(d):
    row = "struct<path: string, size_bytes: bigint, object_id: string>"
    encoded = d.entries_a.select(F.to_json(F.struct("path", "size_bytes", "object_id")).alias("j"))
    return encoded.select(F.from_json("j", row).alias("r")).select("r.*")


@query("api01_init_projects", "SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 5 = 0 THEN '/new/' ELSE '/old/' END || s_name AS root FROM supplier")
def _(d):
    registry = d.supplier.where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("project_id"), F.concat(F.lit("/old/"), "s_name").alias("root"))
    new = d.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("project_id"), F.concat(F.lit("/new/"), "s_name").alias("root"))
    return history.upserted(registry, new, ["project_id"])


@query("api02_load_project", "SELECT s_suppkey AS project_id, s_name AS name, count(o_orderkey) AS checkpoint_count FROM supplier LEFT JOIN orders ON o_custkey = s_suppkey GROUP BY 1, 2")
def _(d):
    counts = d.snapshots.groupBy("project_id").agg(total().alias("n"))
    joined = d.supplier.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("name")).join(counts, "project_id", "left")
    return joined.select("project_id", "name", F.coalesce("n", F.lit(0)).alias("checkpoint_count"))


@query("api06_rename", "SELECT snapshot_id, CASE WHEN snapshot_id = 4 THEN 'renamed' WHEN snapshot_id % 7 = 0 THEN coalesce((SELECT any_value(o.name) FROM overrides o WHERE o.snapshot_id = s.snapshot_id), name) ELSE name END AS name FROM snapshots s")
def _(d):
    return history.with_names(d.snapshots, history.set_name(d.overrides, 4, "renamed")).select("snapshot_id", "name")


@query("api07_delete_checkpoint", "SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS references FROM (SELECT object_id, count(*) AS n FROM sized_entries WHERE snapshot_id <> 33 GROUP BY 1)")
def _(d):
    left = refs.remove_refs(refs.object_refs(d.sized_entries).drop("conflicting"), d.sized_entries.where("snapshot_id = 33"))
    return left.agg(total().alias("objects"), total(None, "reference_count").alias("references"))


@query("api08_diff", f"SELECT 'full' AS mode, {KINDS} FROM ({CONTENT}) UNION ALL SELECT 'metadata', {KINDS} FROM ({DIFF.format(v='size_bytes', missing='deleted')})")
def _(d):
    full = diff.diff_summary(diff.content_diff(d.entries_a, d.working_b)).withColumn("mode", F.lit("full"))
    return full.unionByName(diff.diff_summary(diff.metadata_diff(d.entries_a, d.working_b)).withColumn("mode", F.lit("metadata")))


@query("api10_discard_preview", f"SELECT *, staged_bytes + backup_bytes AS total_bytes FROM ({PLAN_SUMMARY} FROM (SELECT * FROM ({PLAN}) WHERE path IN (SELECT path FROM selection)))")
def _(d):
    closed = plan.selection_closure(d.selection, d.entries_a, d.working_b)
    return plan.plan_summary(plan.discard_plan(d.entries_a, d.working_b, closed))


@query("api14_temp_files", f"SELECT CASE WHEN contains(p, 'strata') THEN 'engine' ELSE 'object' END AS kind, count(*) AS n FROM (SELECT {TEMP} AS p, id FROM candidate_ids) WHERE regexp_full_match(list_last(string_split(p, '/')), '(\\.strata-(r-[0-9a-f]{{16}}-)?|object-)[0-9a-f]{{32}}\\.tmp') GROUP BY 1")
def _(d):
    named = d.candidate_ids.select(F.expr(TEMP).alias("p"))
    kind = F.when(is_owned_temp(F.col("p")), "engine").when(is_object_temp(F.col("p")), "object")
    return named.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(total().alias("n"))


@query("api16_pending", "SELECT transaction_id, state FROM journals WHERE state NOT IN ('committed', 'recovered')")
def _(d):
    return recovery.pending(d.journals).select("transaction_id", "state")


@query("api17_conflict_analysis", "SELECT o.operation_type, count(*) AS n, CAST(sum(w.size_bytes) AS BIGINT) AS bytes FROM operations o JOIN working_b w ON o.path = w.path WHERE o.operation_type = 'restore' AND (o.after_hash IS DISTINCT FROM w.object_id OR o.after_size_bytes IS DISTINCT FROM w.size_bytes) GROUP BY 1")
def _(d):
    found = recovery.conflicts(d.operations.where("operation_type = 'restore'"), d.working_b)
    return found.groupBy("operation_type").agg(total().alias("n"), total(None, "size_bytes").alias("bytes"))


@query("api18_quarantine", "SELECT transaction_id AS quarantine_id, 'orphan payload' AS reason FROM journals WHERE state <> 'staged' UNION ALL SELECT transaction_id, 'unresolved' FROM journals WHERE state = 'staged'")
def _(d):
    key = F.col("transaction_id").alias("quarantine_id")
    records = d.journals.where("state = 'staged'").select(key, F.lit("t").alias("quarantined_at_utc"), F.lit(True).alias("readable"), F.lit(False).alias("verified_before"), F.lit("d").alias("digest"))
    return recovery.unresolved_quarantine(records, records.limit(0).select("quarantine_id", "digest"), d.journals.select(key)).select("quarantine_id", "reason")


@query("api19_storage_root", "SELECT s_suppkey AS project_id, CASE WHEN s_suppkey = 3 THEN '/mnt/store' ELSE s_name END AS storage_root FROM supplier")
def _(d):
    roots = d.supplier.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("storage_root"))
    return history.upserted(roots, roots.where("project_id = 3").withColumn("storage_root", F.lit("/mnt/store")), ["project_id"])


@query("cmp03_export_set", "SELECT count(DISTINCT l_partkey) AS objects, count(*) AS entries, count(DISTINCT l_orderkey) AS snapshots FROM lineitem WHERE l_orderkey % 3 = 0 AND l_partkey IN (SELECT object_id FROM objects)")
def _(d):
    entries = d.snapshot_entries.where("snapshot_id % 3 = 0").join(d.objects.select("object_id"), "object_id", "left_semi")
    return entries.agg(F.count_distinct("object_id").alias("objects"), total().alias("entries"), F.count_distinct("snapshot_id").alias("snapshots"))

