"""Queries over graphs and trees, over content addressing, and of writes as functions of tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from stratakit.operators import gc, history, inventory, manifest, plan, recovery, refs, tree
from stratakit.operators.common import total
from stratakit.plans.aggregates import MEMBERS
from stratakit.plans.joins import PLAN
from stratakit.plans.registry import query
from stratakit.sinks import store
from stratakit.streaming import progress


def _levels(d):
    """region -> nation -> customer -> orders as one graph of (parent_id, child_id)."""
    edge = lambda df, p, pk, c, ck: df.select(F.concat(F.lit(p), pk).alias("parent_id"), F.concat(F.lit(c), ck).alias("child_id"))
    return edge(d.nation, "r", "n_regionkey", "n", "n_nationkey").union(edge(d.customer, "n", "c_nationkey", "c", "c_custkey")).union(edge(d.orders, "c", "o_custkey", "o", "o_orderkey"))


EDGES = "SELECT 'r' || CAST(n_regionkey AS STRING) AS parent_id, 'n' || CAST(n_nationkey AS STRING) AS child_id FROM nation UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING) FROM customer UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING) FROM orders"


@query("cas12_reachable", f"WITH RECURSIVE edges AS ({EDGES}), seen AS (SELECT 'r' || CAST(r_regionkey AS STRING) AS node FROM region WHERE r_regionkey < 2 UNION SELECT child_id FROM seen JOIN edges ON node = parent_id) SELECT node FROM seen")
def _(d):
    roots = d.region.where("r_regionkey < 2").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return gc.reachable(roots, _levels(d))


@query("cas13_chain", "WITH RECURSIVE chain AS (SELECT state_id, generation, parent_id, CAST(0 AS BIGINT) AS step FROM states WHERE state_id NOT IN (SELECT parent_id FROM states WHERE parent_id IS NOT NULL) UNION ALL SELECT s.state_id, s.generation, s.parent_id, c.step + 1 FROM chain c JOIN states s ON s.state_id = c.parent_id) SELECT state_id, generation, step FROM chain")
def _(d):
    heads = d.states.select("state_id").join(d.states.select(F.col("parent_id").alias("state_id")), "state_id", "left_anti")
    return inventory.parent_chain(d.states, heads).drop("head")


TOPOLOGY = """SELECT DISTINCT array_to_string(x[1:i], '/') AS folder FROM (SELECT string_split(path, '/') AS x FROM {t}), unnest(range(1, len(x))) AS u(i)"""


OUTSIDE = "SELECT '{a}' AS action, count(*) AS n FROM ({x}) WHERE folder NOT IN ({y}) HAVING count(*) > 0"


@query("cas16_topology", f"{OUTSIDE.format(a='create', x=TOPOLOGY.format(t='entries_a'), y=TOPOLOGY.format(t='assets'))} UNION ALL {OUTSIDE.format(a='remove', x=TOPOLOGY.format(t='assets'), y=TOPOLOGY.format(t='entries_a'))}")
def _(d):
    other = d.assets.distinct().select("path", F.sha2("path", 256).alias("object_id"), "size_bytes", F.lit("t").alias("modified_at_utc"))
    return plan.directories(plan.restore_plan(d.entries_a, other), other).groupBy("action").agg(total().alias("n"))


@query("cas17_closure", r"""
WITH known AS (SELECT path FROM assets), start AS (SELECT path FROM asset_selection)
SELECT path FROM start UNION SELECT other FROM (SELECT CASE WHEN path LIKE 'Assets/%' THEN CASE WHEN path LIKE '%.meta' THEN left(path, length(path) - 5) ELSE path || '.meta' END END AS other FROM start) WHERE other IN (SELECT path FROM known)""")
def _(d):
    return plan.selection_closure(d.asset_selection, d.assets.where("length(path) % 2 = 0"), d.assets)


COMPRESS = f"""
WITH RECURSIVE folders AS ({TOPOLOGY.format(t='changes')}), parts AS (SELECT folder, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS up FROM folders),
  lone AS (SELECT up AS folder, min(folder) AS next FROM parts GROUP BY up HAVING count(*) = 1 AND up NOT IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM changes)),
  walk AS (SELECT folder, folder AS spot FROM folders UNION ALL SELECT w.folder, l.next FROM walk w JOIN lone l ON l.folder = w.spot),
  shown AS (SELECT folder, max(spot) AS shown_as FROM (SELECT w.folder, w.spot FROM walk w LEFT JOIN lone l ON l.folder = w.spot WHERE l.folder IS NULL) GROUP BY 1)"""


@query("cas18_compress", f"{COMPRESS} SELECT folder, shown_as FROM shown")
def _(d):
    return tree.compressed_folders(d.changes)


ROWS = f"""{COMPRESS}, visible AS (SELECT s.folder, s.shown_as, p.up FROM shown s JOIN parts p USING (folder) WHERE p.up = '' OR p.up IN (SELECT shown_as FROM shown)),
  items AS (SELECT 'folder' AS kind, shown_as AS path, up AS parent, list_last(string_split(folder, '/')) AS name, CAST(NULL AS STRING) AS change_type FROM visible
    UNION ALL SELECT 'file', path, regexp_replace(path, '/[^/]*$', ''), list_last(string_split(path, '/')), change_type FROM changes),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY kind = 'file', CASE WHEN kind = 'file' THEN CASE change_type WHEN 'added' THEN 0 WHEN 'modified' THEN 1 ELSE 2 END END, name, path) AS pos_in_set, count(*) OVER (PARTITION BY parent) AS set_size FROM items)"""


@query("win03_positions", f"{ROWS} SELECT kind, path, parent, name, change_type, pos_in_set, set_size FROM numbered")
def _(d):
    return tree.tree_rows(d.changes).drop("depth")


@query("cas19_flatten", f"""{ROWS}, opened AS (SELECT path FROM numbered WHERE kind = 'folder' AND length(path) % 3 <> 0)
SELECT n.kind, n.path FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM numbered f WHERE f.kind = 'folder' AND starts_with(n.path, f.path || '/') AND f.path NOT IN (SELECT path FROM opened))""")
def _(d):
    rows = tree.tree_rows(d.changes)
    return tree.flattened(rows, rows.where("kind = 'folder' and length(path) % 3 <> 0").select("path")).select("kind", "path")


@query("cas20_below", "SELECT path FROM changes WHERE starts_with(path, 'Packages/en/')")
def _(d):
    return tree.below(d.changes, "Packages/en").select("path")


@query("cas09_manifest")
def _(d):
    leaves, nodes = manifest.build(d.entries_a, leaf_bytes=4096)
    return manifest.leaf_ids(leaves)


@query("cas09_manifest_nodes")
def _(d):
    _, nodes = manifest.build(d.entries_a, leaf_bytes=4096)
    return nodes.select("prefix", "entry_count", "logical_size_bytes", "path_bytes")


@query("cas07_root_counts", "SELECT count(*) AS entry_count, CAST(sum(size_bytes) AS BIGINT) AS logical_size_bytes, CAST(sum(strlen(path)) AS BIGINT) AS path_bytes FROM entries_a")
def _(d):
    leaves, _ = manifest.build(d.entries_a, leaf_bytes=4096)
    return manifest.leaf_ids(leaves).agg(*[total(None, c).alias(c) for c in ("entry_count", "logical_size_bytes", "path_bytes")])


@query("cas10_manifest_problems", """
SELECT parent_id, CASE WHEN n < 2 THEN 'fewer than two children' WHEN falling THEN 'edges do not rise' WHEN e IS DISTINCT FROM entry_count THEN 'sums differ' END AS problem FROM (
  SELECT parent_id, count(*) AS n, coalesce(bool_or(before >= edge), FALSE) AS falling, sum(entry_count) AS e FROM (SELECT *, lag(edge) OVER (PARTITION BY parent_id ORDER BY position) AS before FROM (
    SELECT CAST(l_orderkey AS BIGINT) AS parent_id, l_linenumber AS position, l_linenumber + CASE WHEN l_orderkey % 41 = 0 THEN -2 * l_linenumber ELSE 0 END AS edge, 1 AS entry_count FROM lineitem)) GROUP BY 1)
JOIN (SELECT CAST(l_orderkey AS BIGINT) AS parent_id, count(*) + CASE WHEN l_orderkey % 37 = 0 THEN 1 ELSE 0 END AS entry_count FROM lineitem GROUP BY l_orderkey) USING (parent_id)
WHERE n < 2 OR falling OR e IS DISTINCT FROM entry_count""")
def _(d):
    key, at = F.col("l_orderkey").cast("bigint"), F.col("l_linenumber")
    edges = d.lineitem.select(key.cast("string").alias("parent_id"), at.alias("position"), (at + F.when(key % 41 == 0, -2 * at).otherwise(0)).alias("edge"), F.lit("leaf").alias("child_id"))
    leaf = d.spark.createDataFrame([("leaf", 1, 0)], "id string, entry_count long, logical_size_bytes long")
    counted = d.lineitem.groupBy(key.alias("k")).agg(total().alias("n"))
    own = counted.select(F.col("k").cast("string").alias("id"), (F.col("n") + F.when(F.col("k") % 37 == 0, 1).otherwise(0)).alias("entry_count"), F.lit(0).cast("bigint").alias("logical_size_bytes"))
    found = manifest.node_problems(edges, own.union(leaf))
    return found.select(F.col("parent_id").cast("bigint").alias("parent_id"), "problem")


@query("cas11_radix_lookup", "SELECT path, size_bytes, object_id FROM entries_a WHERE path = 'Assets/src7/en/7.txt'")
def _(d):
    return manifest.lookup(manifest.manifest_rows(d.entries_a), "Assets/src7/en/7.txt").select("path", "size_bytes", "object_id")


@query("cas04_plan_mac")
def _(d):
    """The plan's id under a keyed digest; the key never leaves the driver."""
    identity = plan.plan_id(plan.restore_plan(d.entries_a, d.working_b)).first()[0]
    return d.spark.createDataFrame([(identity, plan.mac(identity, hashlib.sha256(b"key").digest()))], "plan_id string, mac string")


@query("cas14_set_update", f"SELECT substr(snapshot_id, 2, 1) AS shard, count(*) AS members FROM (({MEMBERS}) EXCEPT SELECT project_id, snapshot_id FROM states WHERE project_id = 3) GROUP BY 1")
def _(d):
    members = inventory.membership(d.states)
    left = members.join(d.states.where("project_id = 3").select("project_id", "snapshot_id").distinct(), ["project_id", "snapshot_id"], "left_anti")
    return left.groupBy(F.substring("snapshot_id", 2, 1).alias("shard")).agg(total().alias("members"))


@query("cas15_head_transition", "SELECT project_id, CAST(max(generation) + CASE WHEN project_id = 5 THEN 1 ELSE 0 END AS BIGINT) AS head FROM states GROUP BY project_id")
def _(d):
    states = d.states.withColumn("operation_id", F.col("state_id"))
    last = states.where("project_id = 5").orderBy(F.desc("generation")).limit(1).collect()
    grown = states
    for head in last:
        new = head.asDict() | {"state_id": "new", "generation": head["generation"] + 1, "parent_id": head["state_id"], "operation_id": "new"}
        grown = inventory.append_state(states, new, head["state_id"])
        grown = inventory.append_state(grown, new, head["state_id"])  # repeated: nothing changes
    return grown.groupBy("project_id").agg(F.max("generation").alias("head"))


@query("snk01_put_actions", """
SELECT f.object_id, f.path, f.size_bytes, CASE WHEN o.object_id IS NULL THEN 'write' WHEN o.valid THEN 'skip' ELSE 'repair' END AS action
FROM (SELECT object_id, min((path, size_bytes))[1] AS path, min((path, size_bytes))[2] AS size_bytes FROM working_b GROUP BY 1) f LEFT JOIN (SELECT object_id, max(doc_id) % 6 <> 0 AS valid FROM entries_a GROUP BY 1) o ON f.object_id = o.object_id""")
def _(d):
    have = d.entries_a.groupBy("object_id").agg((F.max("doc_id") % 6 != 0).alias("valid"))
    return store.put_actions(d.working_b, have)


@query("snk02_representatives", "SELECT object_id, min((path, size_bytes))[1] AS path, min((path, size_bytes))[2] AS size_bytes FROM working_b GROUP BY 1")
def _(d):
    return store.representatives(d.working_b)


@query("snk03_known_durable", "SELECT DISTINCT a.object_id FROM entries_a a JOIN (SELECT DISTINCT object_id, size_bytes FROM fingerprint_cache) c ON a.object_id = c.object_id AND a.size_bytes = c.size_bytes")
def _(d):
    return store.known_durable(d.entries_a, d.fingerprint_cache).distinct()


@query("snk04_new_chunks", "SELECT object_id, 'objects/loose/' || substr(object_id, 1, 2) || '/' || object_id AS location, substr(object_id, 1, 2) AS shard FROM (SELECT DISTINCT object_id FROM working_b WHERE object_id NOT IN (SELECT object_id FROM entries_a))")
def _(d):
    have = d.entries_a.select("object_id", F.lit(True).alias("valid")).distinct()
    return store.new_objects(store.put_actions(d.working_b, have)).select("object_id", "location", "shard")


@query("snk06_index_upsert", "SELECT snapshot_id, count(*) AS file_count FROM snapshot_entries GROUP BY 1")
def _(d):
    counts = lambda cond: d.snapshot_entries.where(cond).groupBy("snapshot_id").agg(total().alias("file_count"))
    return store.index_upsert(counts("snapshot_id % 2 = 1"), counts("snapshot_id % 2 = 0 or snapshot_id % 20 = 1"))


REFS = "SELECT object_id, count(*) AS reference_count, min(size_bytes) AS size_bytes FROM sized_entries WHERE {c} GROUP BY 1"


@query("snk07_add_refs", REFS.format(c="TRUE"))
def _(d):
    base = refs.object_refs(d.sized_entries.where("snapshot_id % 5 <> 1")).drop("conflicting")
    return refs.add_refs(base, d.sized_entries.where("snapshot_id % 5 = 1"))


@query("snk08_remove_refs", REFS.format(c="snapshot_id % 50 <> 2"))
def _(d):
    base = refs.object_refs(d.sized_entries).drop("conflicting")
    return refs.remove_refs(base, d.sized_entries.where("snapshot_id % 50 = 2"))


@query("snk09_cache_refresh", "SELECT path, fingerprint FROM working_b WHERE doc_id % 2 = 0 UNION ALL SELECT c.path, c.fingerprint FROM fingerprint_cache c JOIN working_b w ON c.path = w.path WHERE w.doc_id % 2 = 1")
def _(d):
    updates = d.working_b.where("doc_id % 2 = 0").select("path", "fingerprint")
    return history.refreshed_fingerprints(d.fingerprint_cache.select("path", "fingerprint"), updates, d.working_b, ["path"])


@query("snk10_cache_invalidation", "SELECT path, object_id FROM fingerprint_cache WHERE path NOT IN (SELECT path FROM selection)")
def _(d):
    return gc.unreferenced(d.fingerprint_cache.select("path", "object_id"), d.selection, ["path"])


@query("snk11_integrity_upsert", "SELECT object_id, CASE WHEN object_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE size_bytes END AS size_bytes FROM objects")
def _(d):
    return history.upserted(d.objects, d.objects.where("object_id % 3 = 0").withColumn("size_bytes", F.lit(-1).cast("bigint")), ["object_id"])


@query("snk12_index_rebuild", "SELECT object_id, count(*) AS reference_count, min(size_bytes) AS size_bytes FROM sized_entries GROUP BY 1")
def _(d):
    return refs.object_refs(d.sized_entries).where("not conflicting").drop("conflicting")


@query("snk13_overrides", "SELECT snapshot_id, CASE WHEN snapshot_id = 14 THEN 'chosen' ELSE name END AS name FROM overrides WHERE snapshot_id <> 21")
def _(d):
    return history.set_name(history.set_name(d.overrides, 14, "chosen"), 21, None)


@query("snk14_delete", f"SELECT project_id, count(*) AS members FROM (({MEMBERS}) EXCEPT SELECT project_id, snapshot_id FROM states WHERE generation % 17 = 0) GROUP BY 1")
def _(d):
    gone = d.states.where("generation % 17 = 0").select("project_id", "snapshot_id").distinct()
    grave = gone.select("project_id", F.lit(1 << 40).alias("generation"), F.lit("remove").alias("operation"), "snapshot_id")
    log = d.states.select("project_id", "generation", "operation", "snapshot_id").union(grave)
    return inventory.membership(log).groupBy("project_id").agg(total().alias("members"))


@query("snk15_gc_apply", "SELECT count(*) AS deleted, TRUE AS complete FROM objects WHERE object_id NOT IN (SELECT object_id FROM live_refs)")
def _(d):
    gone = gc.unreferenced(d.objects, d.live_refs, ["object_id"]).select(F.lit("x").alias("location"), F.col("object_id").alias("id"))
    done = gc.apply_gc(gone, "p", "p", False, delete=len)
    return d.spark.createDataFrame([(done["deleted"], done["complete"])], "deleted long, complete boolean")


@query("snk20_registry_upsert", "SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 4 = 0 THEN 'moved' ELSE s_name END AS root FROM supplier")
def _(d):
    registry = d.supplier.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("root"))
    return history.upserted(registry, registry.where("project_id % 4 = 0").withColumn("root", F.lit("moved")), ["project_id"])


@query("api03_project_status", "SELECT (SELECT count(*) FROM snapshots) AS checkpoint_count, (SELECT count(*) FROM journals WHERE state NOT IN ('committed', 'recovered')) AS pending_transactions, (SELECT max(created_at_utc) FROM snapshots) AS newest")
def _(d):
    newest = d.snapshots.agg(total().alias("checkpoint_count"), F.max("created_at_utc").alias("newest"))
    return newest.join(recovery.pending(d.journals).agg(total().alias("pending_transactions"))).select("checkpoint_count", "pending_transactions", "newest")


@query("api04_create_checkpoint", "SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS logical_size_bytes, (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT min(size_bytes) AS s FROM working_b WHERE object_id NOT IN (SELECT object_id FROM entries_a) GROUP BY object_id)) AS newly_stored_bytes FROM working_b")
def _(d):
    return d.working_b.agg(total().alias("file_count"), total(None, "size_bytes").alias("logical_size_bytes")).join(refs.newly_stored(d.working_b, d.entries_a).select("newly_stored_bytes"))


@query("api05_list_checkpoints", "SELECT s.project_id, s.snapshot_id, coalesce(o.name, s.name) AS name, row_number() OVER (PARTITION BY s.project_id ORDER BY s.created_at_utc DESC, s.snapshot_id DESC) AS position FROM snapshots s LEFT JOIN overrides o ON o.snapshot_id = s.snapshot_id")
def _(d):
    return history.with_names(history.ranked(d.snapshots), d.overrides).select("project_id", "snapshot_id", "name", "position")


@query("api09_restore_preview", f"SELECT operation_type, count(*) AS n, CAST(coalesce(sum(after_size_bytes), 0) AS BIGINT) AS after_bytes FROM ({PLAN}) GROUP BY 1")
def _(d):
    return plan.restore_plan(d.entries_a, d.working_b).groupBy("operation_type").agg(total().alias("n"), total(None, "after_size_bytes").alias("after_bytes"))


@query("api11_verify", "SELECT 'object with two sizes' AS check, count(*) AS n FROM (SELECT object_id FROM snapshot_entries GROUP BY 1 HAVING min(size_bytes) <> max(size_bytes)) UNION ALL SELECT 'duplicate path', count(*) FROM (SELECT snapshot_id, path FROM snapshot_entries GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0")
def _(d):
    from stratakit.operators import verify

    return verify.verify(d.snapshot_entries.withColumn("portable_key", F.lower("path"))).groupBy("check").agg(total().alias("n"))


@query("api12_rebuild_index", "SELECT (SELECT count(*) FROM snapshots) AS snapshot_count, count(*) AS object_count, count(*) FILTER (WHERE r.size_bytes IS DISTINCT FROM o.size_bytes) AS unavailable_count FROM (SELECT object_id, min(size_bytes) AS size_bytes FROM sized_entries GROUP BY 1) r LEFT JOIN objects o ON r.object_id = o.object_id")
def _(d):
    return refs.rebuild_result(d.snapshots, refs.object_refs(d.sized_entries), d.objects)


@query("api13_gc_plan", "SELECT object_id, size_bytes, row_number() OVER (ORDER BY object_id) <= 1000 AS shown FROM objects WHERE object_id NOT IN (SELECT object_id FROM live_refs)")
def _(d):
    gone = gc.unreferenced(d.objects, d.live_refs, ["object_id"]).withColumn("family", F.lit("object"))
    shown = gc.truncated(gone, ["family"], [F.col("object_id")], 1000).select("object_id", F.lit(True).alias("shown"))
    return gone.join(shown, "object_id", "left").select("object_id", "size_bytes", F.coalesce("shown", F.lit(False)).alias("shown"))


@query("api15_journal_cleanup", "SELECT transaction_id, location, count(*) AS file_count, CAST(sum(length(text)) AS BIGINT) AS total_bytes FROM journals JOIN journal_steps USING (transaction_id) WHERE state IN ('committed', 'recovered') GROUP BY 1, 2")
def _(d):
    return recovery.cleanup_plan(d.journals, d.journal_steps.select("transaction_id", F.length("text").cast("bigint").alias("size_bytes")))


@query("cmp01_listing_with_storage", "SELECT s.snapshot_id, coalesce(o.name, s.name) AS name, (SELECT count(*) FROM objects) AS stored_objects FROM snapshots s LEFT JOIN overrides o ON o.snapshot_id = s.snapshot_id")
def _(d):
    return history.with_names(d.snapshots, d.overrides).select("snapshot_id", "name").join(d.objects.agg(total().alias("stored_objects")))


STEPS = "SELECT event_id, user_id, epoch_ms(ts) AS t, CASE WHEN event_id % 19 = 0 THEN 'complete' ELSE event_type END AS phase, CAST(user_id % 4 AS BIGINT) AS total, CAST(event_id % 6 AS BIGINT) AS completed FROM events"


@query("stm01_throttled_progress", f"""
WITH RECURSIVE steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, phase, event_id) AS k FROM ({STEPS})),
  shown AS (SELECT user_id, k, event_id, TRUE AS seen, t AS last_t, phase AS last_phase, total AS last_total FROM steps WHERE k = 1
    UNION ALL SELECT user_id, k, event_id, seen, CASE WHEN seen THEN t ELSE last_t END, CASE WHEN seen THEN phase ELSE last_phase END, CASE WHEN seen THEN total ELSE last_total END
    FROM (SELECT s.user_id, s.k, s.event_id, s.t, s.phase, s.total, p.last_t, p.last_phase, p.last_total,
                 s.phase <> p.last_phase OR s.total <> p.last_total OR s.phase = 'complete' OR (s.total > 0 AND s.completed >= s.total) OR s.t - p.last_t >= 86400000 AS seen
          FROM shown p JOIN steps s ON s.user_id = p.user_id AND s.k = p.k + 1))
SELECT event_id FROM shown WHERE seen""")
def _(d):
    rows = d.events.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.expr("if(event_id % 19 = 0, 'complete', event_type)").alias("phase"), (F.col("user_id") % 4).cast("bigint").alias("total"), (F.col("event_id") % 6).alias("completed"))
    return progress.throttled(rows, "user_id", "t", "phase", "total", "completed", ["event_id"], 86_400_000).select("event_id")
