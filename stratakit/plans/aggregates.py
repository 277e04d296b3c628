"""Queries that aggregate, order, number or limit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratakit.operators import diff, gc, history, inventory, manifest, plan, recovery, refs, tree, verify
from stratakit.operators.common import numbered_all, settled, total
from stratakit.plans.joins import CONTENT, PLAN
from stratakit.plans.registry import query
from stratakit.sinks import store
from stratakit.sources import records, scan

ENTRIES = "SELECT * FROM snapshot_entries"


@query("agg01_storage_summary", "SELECT (SELECT count(*) FROM snapshots) AS checkpoint_count, (SELECT CAST(coalesce(sum(logical_size_bytes), 0) AS BIGINT) FROM snapshots) AS logical_size_bytes, (SELECT count(*) FROM live_refs) AS object_count")
def _(d):
    return refs.storage_summary(d.snapshots, d.live_refs)


@query("agg02_exact_summary", "SELECT (SELECT count(*) FROM snapshots) AS checkpoint_count, (SELECT CAST(coalesce(sum(logical_size_bytes), 0) AS BIGINT) FROM snapshots) AS logical_size_bytes, (SELECT count(*) FROM live_refs) AS object_count, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM objects) AS stored_size_bytes")
def _(d):
    return refs.storage_summary(d.snapshots, d.live_refs, d.objects)


@query("agg03_object_refs", "SELECT object_id, count(*) AS reference_count, min(size_bytes) AS size_bytes, min(size_bytes) <> max(size_bytes) AS conflicting FROM snapshot_entries GROUP BY object_id")
def _(d):
    return refs.object_refs(d.snapshot_entries)


@query("agg04_multiplicity", """
SELECT CAST(l_partkey AS BIGINT) AS object_id, CAST(sum(1 + o_orderkey % 3) AS BIGINT) AS reference_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(d):
    roots = d.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (1 + F.col("o_orderkey") % 3).alias("multiplicity"))
    edges = settled(refs.edge_counts(d.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.concat(F.lit("p"), "l_partkey").alias("child_id"))))  # read for every level
    nodes = refs.multiplicity(roots, edges)
    leaves = d.part.select(F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), F.col("p_partkey").cast("bigint").alias("object_id"), F.lit(1).alias("n"))
    return refs.graph_refs(nodes, leaves)


@query("agg05_edge_counts", "SELECT l_orderkey AS parent_id, l_suppkey AS child_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(d):
    return refs.edge_counts(d.lineitem.select(F.col("l_orderkey").alias("parent_id"), F.col("l_suppkey").alias("child_id")))


@query("agg06_leaf_counts", "SELECT l_suppkey AS chunk_id, l_partkey AS object_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(d):
    return refs.leaf_counts(d.lineitem.select(F.col("l_suppkey").alias("chunk_id"), F.col("l_partkey").alias("object_id")))


@query("agg07_rebuild_result", """
SELECT (SELECT count(*) FROM snapshots) AS snapshot_count, count(*) AS object_count, count(*) FILTER (WHERE r.size_bytes IS DISTINCT FROM o.size_bytes) AS unavailable_count FROM live_refs r LEFT JOIN objects o ON r.object_id = o.object_id""")
def _(d):
    return refs.rebuild_result(d.snapshots, d.live_refs, d.objects)


@query("agg08_chunk_summary", "SELECT snapshot_id AS chunk_id, count(*) AS entry_count, CAST(sum(size_bytes) AS BIGINT) AS logical_size_bytes, CAST(sum(strlen(path)) AS BIGINT) AS path_bytes FROM snapshot_entries GROUP BY 1")
def _(d):
    return manifest.chunk_summary(d.snapshot_entries.withColumnRenamed("snapshot_id", "chunk_id"))


@query("agg10_gc_summary", """
SELECT family, CAST(n AS BIGINT) AS candidate_count, CAST(b AS BIGINT) AS candidate_bytes FROM (
  SELECT 'object' AS family, count(*) AS n, coalesce(sum(size_bytes), 0) AS b FROM objects WHERE object_id NOT IN (SELECT object_id FROM live_refs)
  UNION ALL SELECT 'chunk', count(*), coalesce(sum(s_nationkey), 0) FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT 'inventory', 0, 0)""")
def _(d):
    objects = gc.unreferenced(d.objects, d.live_refs, ["object_id"]).select(F.lit("object").alias("family"), F.col("object_id").alias("id"), "size_bytes")
    chunks = d.supplier.where("s_suppkey % 9 = 0").select(F.lit("chunk"), F.col("s_suppkey"), F.col("s_nationkey").cast("bigint"))
    return gc.gc_summary(objects.union(chunks))


@query("agg12_folder_rollup", """
SELECT array_to_string(x[1:i], '/') AS folder, count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'modified') AS modified, count(*) FILTER (WHERE change_type = 'deleted') AS deleted, i AS depth
FROM (SELECT string_split(path, '/') AS x, change_type FROM changes), unnest(range(1, len(x))) AS t(i) GROUP BY 1, i""")
def _(d):
    return tree.folder_rollup(d.changes)


@query("agg13_cleanup_totals", "SELECT count(*) AS directory_count, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(b) AS BIGINT) AS total_bytes FROM (SELECT transaction_id, count(*) AS n, sum(length(text)) AS b FROM journal_steps GROUP BY 1) JOIN journals USING (transaction_id) WHERE state IN ('committed', 'recovered')")
def _(d):
    files = d.journal_steps.select("transaction_id", F.length("text").cast("bigint").alias("size_bytes"))
    return recovery.cleanup_totals(recovery.cleanup_plan(d.journals, files))


@query("agg14_temp_totals", "SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM (SELECT size_bytes FROM stored_files UNION ALL SELECT size_bytes FROM working_b)")
def _(d):
    return gc.temp_totals(d.stored_files, d.working_b.withColumnRenamed("path", "location"))


@query("agg15_first_ref", "SELECT object_id, s[1] AS snapshot_id, s[2] AS path FROM (SELECT object_id, min((snapshot_id, path)) AS s FROM snapshot_entries GROUP BY object_id)")
def _(d):
    return refs.first_references(d.snapshot_entries)


@query("agg16_capped_errors", "(SELECT error FROM (SELECT DISTINCT p_type || ' ' || p_brand AS error FROM part) ORDER BY error LIMIT 50) UNION ALL SELECT '... and ' || CAST(count(DISTINCT p_type || ' ' || p_brand) - 50 AS STRING) || ' more' FROM part")
def _(d):
    return verify.capped_errors(d.part.select(F.concat_ws(" ", "p_type", "p_brand").alias("error")), 50)


@query("agg17_warnings", "SELECT DISTINCT trim(split_part(text, '.', 1)) AS warning FROM conversations WHERE trim(split_part(text, '.', 1)) <> ''")
def _(d):
    return history.distinct_warnings(d.conversations.select(F.split_part("text", F.lit("."), F.lit(1)).alias("warning")))


BANNER = "SELECT trim(p_brand) AS warning, min(p_partkey) AS first_seen FROM part GROUP BY 1"


@query("agg17_warning_banner", f"SELECT warning, first_seen, (SELECT greatest(0, count(*) - 5) FROM ({BANNER})) AS omitted FROM ({BANNER}) ORDER BY first_seen LIMIT 5")
def _(d):
    return history.warning_banner(d.part.select(F.concat(F.lit(" "), "p_brand").alias("warning"), F.col("p_partkey").alias("position")))


@query("agg19_io_metrics", "SELECT run, t AS total_micros, p AS phase_micros, greatest(0, t - p) AS other_micros FROM (SELECT user_id AS run, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_id % 4 = 0), 0) AS BIGINT) AS t, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_id % 4 <> 0), 0) AS BIGINT) AS p FROM events GROUP BY 1)")
def _(d):
    rows = d.events.select(F.col("user_id").alias("run"), F.when(F.col("event_id") % 4 == 0, "total").otherwise("scan").alias("phase"), F.floor("value").alias("micros"))
    return store.io_metrics(rows)


MEMBERS = "SELECT project_id, snapshot_id FROM (SELECT project_id, snapshot_id, arg_max(operation, generation) AS op FROM states GROUP BY 1, 2) WHERE op = 'add'"


@query("agg20_membership", MEMBERS)
def _(d):
    return inventory.membership(d.states)


@query("agg21_tree_digest", """
SELECT source, sha256(string_agg(x, '|' ORDER BY doc_id)) AS digest FROM (SELECT source, doc_id, CAST(length(CAST(doc_id AS STRING)) AS STRING) || ':' || CAST(doc_id AS STRING) || CAST(length(lang) AS STRING) || ':' || lang || CAST(length(CAST(n_chars AS STRING)) AS STRING) || ':' || CAST(n_chars AS STRING) AS x FROM documents) GROUP BY source""")
def _(d):
    return plan.digest(d.documents, ["doc_id"], ["doc_id", "lang", "n_chars"], ["source"])


def _item(*columns: str) -> str:
    text = [f"coalesce(CAST({c} AS STRING), '')" for c in columns]
    return " || ".join(f"CAST(length({t}) AS STRING) || ':' || {t}" for t in text)


@query("agg22_plan_id", f"""
SELECT sha256(string_agg({_item('folder', 'd')}, '|' ORDER BY folder)) AS plan_id FROM (
  SELECT folder, sha256(string_agg({_item(*plan.COLUMNS)}, '|' ORDER BY path)) AS d FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM ({PLAN})) GROUP BY folder)""")
def _(d):
    return plan.plan_id(plan.restore_plan(d.entries_a, d.working_b))


@query("agg23_newly_stored", "SELECT count(*) AS object_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS newly_stored_bytes FROM (SELECT object_id, min(size_bytes) AS size_bytes FROM sized_entries WHERE object_id NOT IN (SELECT object_id FROM objects) GROUP BY 1)")
def _(d):
    return refs.newly_stored(d.sized_entries, d.objects)


@query("agg24_chunk_churn", "SELECT count(*) FILTER (WHERE p_partkey % 3 <> 0) AS new_chunks, CAST(sum(p_size) FILTER (WHERE p_partkey % 3 <> 0) AS BIGINT) AS new_bytes, count(*) FILTER (WHERE p_partkey % 3 = 0) AS shared_chunks FROM part")
def _(d):
    new = d.part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").cast("bigint").alias("stored_bytes"))
    return gc.chunk_churn(new.where("chunk_id % 3 = 0"), new)


@query("agg25_completeness", "SELECT conv_id, count(*) AS n, CASE WHEN count(DISTINCT turn) <> count(*) OR min(turn) <> 0 OR max(turn) + 1 <> count(*) THEN 'numbers' ELSE 'ids' END AS problem FROM conversations WHERE turn % 5 <> 3 GROUP BY conv_id HAVING count(DISTINCT turn) <> count(*) OR min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT role || CAST(turn // 2 AS STRING)) <> count(*)")
def _(d):
    rows = d.conversations.where("turn % 5 <> 3").select("conv_id", (F.col("turn") + 1).alias("number"), F.concat("role", F.floor(F.col("turn") / 2).cast("string")).alias("ident"))
    return verify.completeness(rows, ["conv_id"], "number", "ident")


@query("agg26_ref_counts", "SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS references, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT object_id, count(*) AS n FROM snapshot_entries GROUP BY 1)")
def _(d):
    counted = refs.object_refs(d.snapshot_entries)
    return counted.agg(total().alias("objects"), total(None, "reference_count").alias("references"), total(F.col("reference_count") == 1).alias("singletons"))


@query("agg28_rescue", "SELECT count(*) AS rescue_count, CAST(sum(size_bytes) AS BIGINT) AS rescue_bytes FROM (SELECT object_id, min(size_bytes) AS size_bytes FROM working_b WHERE object_id NOT IN (SELECT object_id FROM entries_a) GROUP BY 1)")
def _(d):
    return refs.rescue_bytes(d.working_b, d.entries_a)


@query("agg29_merged_options", "SELECT transaction_id, bool_or(role = 'user') AS refresh_project, bool_or(generation > 3) AS allow_busy, bool_and(role <> 'system') AS metadata_only, bool_and(generation < 5) AS silent FROM journal_steps GROUP BY 1")
def _(d):
    options = d.journal_steps.select("transaction_id", (F.col("role") == "user").alias("refresh_project"), (F.col("generation") > 3).alias("allow_busy"), (F.col("role") != "system").alias("metadata_only"), (F.col("generation") < 5).alias("silent"))
    return history.merged_options(options, "transaction_id")


@query("agg30_recovery_result", "SELECT count(*) FILTER (WHERE state <> 'staged') AS recovered_count, count(*) FILTER (WHERE state = 'staged') AS failed_count, string_agg(CAST(transaction_id AS STRING), ',' ORDER BY CAST(transaction_id AS STRING)) FILTER (WHERE state <> 'staged') AS recovered_ids, string_agg(CAST(transaction_id AS STRING), ',' ORDER BY CAST(transaction_id AS STRING)) FILTER (WHERE state = 'staged') AS failed_ids FROM journals")
def _(d):
    return recovery.recovery_result(d.journals.select("transaction_id", F.when(F.col("state") == "staged", "x").alias("error")))


@query("agg31_diff_assertion", f"SELECT count(*) FILTER (WHERE change_type = 'added') = (SELECT count(*) FROM working_b WHERE path NOT IN (SELECT path FROM entries_a)) AS as_expected, count(*) FILTER (WHERE change_type = 'added') AS added FROM ({CONTENT})")
def _(d):
    """The diff's count against one taken another way."""
    s = diff.diff_summary(diff.content_diff(d.entries_a, d.working_b))
    expected = gc.unreferenced(d.working_b, d.entries_a, ["path"]).agg(total().alias("n"))
    return s.join(expected).select((F.col("added_count") == F.col("n")).alias("as_expected"), F.col("added_count").alias("added"))


@query("prj03_snapshot_summary", "SELECT snapshot_id, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS logical_size_bytes, CAST(0 AS BIGINT) AS newly_stored_bytes FROM snapshot_entries GROUP BY 1")
def _(d):
    return refs.snapshot_summary(d.snapshot_entries)


HISTORY = "SELECT project_id, snapshot_id, created_at_utc, name, row_number() OVER (PARTITION BY project_id ORDER BY created_at_utc DESC, snapshot_id DESC) AS position FROM snapshots"


@query("srt01_history", HISTORY)
def _(d):
    return history.ranked(d.snapshots).select("project_id", "snapshot_id", "created_at_utc", "name", "position")


@query("srt02_path_order", "SELECT path, row_number() OVER (PARTITION BY source ORDER BY path) AS position FROM (SELECT path, split_part(path, '/', 2) AS source FROM working_b)")
def _(d):
    return d.working_b.select("path", F.row_number().over(Window.partitionBy(F.split_part("path", F.lit("/"), F.lit(2))).orderBy("path")).cast("bigint").alias("position"))


@query("srt03_directories", """
WITH a AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS f FROM entries_a, unnest(range(1, len(string_split(path, '/')))) AS t(i)),
     b AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS f FROM few, unnest(range(1, len(string_split(path, '/')))) AS t(i)), few AS (SELECT path FROM working_b WHERE path LIKE 'Assets/src1/%' OR path LIKE 'Assets/src2/fr/%')
SELECT 'create' AS action, f AS path, CAST(len(string_split(f, '/')) AS INTEGER) AS depth, row_number() OVER (ORDER BY f) AS position FROM a WHERE f NOT IN (SELECT f FROM b)
UNION ALL SELECT 'remove', f, CAST(len(string_split(f, '/')) AS INTEGER), row_number() OVER (ORDER BY len(string_split(f, '/')) DESC, f) FROM b WHERE f NOT IN (SELECT f FROM a)""".replace("WITH a AS", "WITH few AS (SELECT path FROM working_b WHERE path LIKE 'Assets/src1/%' OR path LIKE 'Assets/src2/fr/%'), a AS").replace(", few AS (SELECT path FROM working_b WHERE path LIKE 'Assets/src1/%' OR path LIKE 'Assets/src2/fr/%')\nSELECT", "\nSELECT"))
def _(d):
    few = d.working_b.where("path like 'Assets/src1/%' or path like 'Assets/src2/fr/%'")
    return plan.directories(plan.restore_plan(d.entries_a, few), few)


@query("srt04_type_rank", "SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY CASE change_type WHEN 'added' THEN 0 WHEN 'modified' THEN 1 ELSE 2 END, path) AS position FROM changes")
def _(d):
    rank = F.when(F.col("change_type") == "added", 0).when(F.col("change_type") == "modified", 1).otherwise(2)
    return d.changes.select("path", F.row_number().over(Window.partitionBy(F.split_part("path", F.lit("/"), F.lit(2))).orderBy(rank, "path")).cast("bigint").alias("position"))


@query("srt05_candidates", "SELECT location, transaction_id, row_number() OVER (PARTITION BY state ORDER BY location, transaction_id) AS position FROM journals")
def _(d):
    return d.journals.select("location", "transaction_id", F.row_number().over(Window.partitionBy("state").orderBy("location", "transaction_id")).cast("bigint").alias("position"))


@query("srt06_keyset_page", "SELECT object_id, size_bytes FROM objects WHERE object_id > 500 ORDER BY object_id LIMIT 256")
def _(d):
    return history.page(d.objects, "object_id", 500, 256)


@query("srt07_ready_batch", "SELECT snapshot_id FROM snapshots WHERE project_id % 2 = 0 ORDER BY snapshot_id LIMIT 256")
def _(d):
    return d.snapshots.where("project_id % 2 = 0").select("snapshot_id").orderBy("snapshot_id").limit(256)


@query("lim01_truncated", """
SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position, count(*) OVER (PARTITION BY label) AS group_count, count(*) OVER (PARTITION BY label) > 40 AS details_truncated FROM embeddings) WHERE position <= 40""")
def _(d):
    return gc.truncated(d.embeddings.select("label", "vec_id"), ["label"], [F.col("vec_id")], 40)


@query("lim02_mismatch_sample", """
SELECT * FROM (SELECT path, side, row_number() OVER (PARTITION BY side ORDER BY path) AS position FROM (
  SELECT path, 'left' AS side FROM (SELECT path FROM entries_a EXCEPT SELECT path FROM working_b) UNION ALL SELECT path, 'right' FROM (SELECT path FROM working_b EXCEPT SELECT path FROM entries_a))) WHERE position <= 8""")
def _(d):
    return inventory.sample_differences(d.entries_a.select("path"), d.working_b.select("path"))


@query("lim03_recent_projects", "SELECT o_custkey AS path, max(o_orderdate) AS opened_at FROM orders GROUP BY 1 ORDER BY opened_at DESC, path LIMIT 12")
def _(d):
    return history.recent_projects(d.orders.select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("opened_at")))


@query("lim04_window_slice", "SELECT path, position FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM working_b) WHERE position BETWEEN 92 AND 134")
def _(d):
    rows = numbered_all(d.working_b.select("path"), ["path"])
    return tree.window_slice(rows, 900, top=2000.0, height=600.0, row_height=20.0, overscan=8).where("position <= 134")


@query("win01_prefix_sums", "SELECT project_id, snapshot_id, CAST(sum(logical_size_bytes) OVER (PARTITION BY project_id ORDER BY created_at_utc, snapshot_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix_sum FROM snapshots")
def _(d):
    return history.running(d.snapshots, ["project_id"], [F.col("created_at_utc"), F.col("snapshot_id")], "logical_size_bytes").select("project_id", "snapshot_id", "prefix_sum")


@query("win02_adjacent", "SELECT project_id, position, snapshot_id, previous FROM (SELECT project_id, position, snapshot_id, lag(snapshot_id) OVER (PARTITION BY project_id ORDER BY position) AS previous FROM (SELECT project_id, generation AS position, snapshot_id FROM states)) WHERE previous >= snapshot_id")
def _(d):
    return verify.adjacent(d.states.select("project_id", F.col("generation").alias("position"), "snapshot_id"), ["project_id"], "snapshot_id")


LATEST = f"""
WITH members AS ({MEMBERS}), removed AS (SELECT project_id, arg_max(snapshot_id, generation) AS snapshot_id, CASE WHEN project_id % 3 = 0 THEN arg_min(snapshot_id, generation) ELSE arg_max(snapshot_id, generation) END AS current_latest, CASE WHEN project_id % 2 = 0 THEN min(snapshot_id) END AS parent
  FROM states JOIN members USING (project_id, snapshot_id) WHERE operation = 'add' GROUP BY 1),
  alive AS (SELECT project_id, snapshot_id FROM members EXCEPT SELECT project_id, snapshot_id FROM removed),
  newest AS (SELECT project_id, arg_max(snapshot_id, generation) AS newest FROM states JOIN alive USING (project_id, snapshot_id) WHERE operation = 'add' GROUP BY 1)
SELECT r.project_id, CASE WHEN current_latest IS DISTINCT FROM r.snapshot_id THEN current_latest WHEN a.snapshot_id IS NOT NULL THEN parent ELSE newest END AS latest
FROM removed r LEFT JOIN alive a ON a.project_id = r.project_id AND a.snapshot_id = r.parent LEFT JOIN newest n ON n.project_id = r.project_id"""


@query("win04_latest", LATEST)
def _(d):
    live = d.states.join(inventory.membership(d.states), ["project_id", "snapshot_id"], "left_semi").where("operation = 'add'")
    last, first = F.max_by("snapshot_id", "generation"), F.min_by("snapshot_id", "generation")
    removed = live.groupBy("project_id").agg(last.alias("snapshot_id"), F.when(F.col("project_id") % 3 == 0, first).otherwise(last).alias("current_latest"), F.when(F.col("project_id") % 2 == 0, F.min("snapshot_id")).alias("parent"))
    return inventory.latest_after_delete(d.states, removed)


@query("win05_gaps", "SELECT conv_id, turn, previous FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE turn % 5 <> 3) WHERE turn - previous <> 1")
def _(d):
    return inventory.generation_gaps(d.conversations.where("turn % 5 <> 3"), "conv_id", "turn")


@query("win06_range", "SELECT path, position FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM working_b) WHERE position BETWEEN 20 AND 47")
def _(d):
    rows = numbered_all(d.working_b.select("path"), ["path"])
    a, b = (r["path"] for r in rows.where("position in (20, 47)").orderBy("position").collect())
    return tree.selected_range(rows, b, a)


@query("win07_series", "SELECT label, vec_id, vec_id - lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS delta FROM embeddings")
def _(d):
    return history.series(d.embeddings.select("label", "vec_id"), ["label"], "vec_id", "vec_id")


@query("set01_key_union", "SELECT path FROM entries_a UNION SELECT path FROM working_b")
def _(d):
    return d.entries_a.select("path").union(d.working_b.select("path")).distinct()


SETS = "SELECT count(*) FILTER (WHERE a.path IS NULL OR b.path IS NULL) = 0 AS equal, count(*) FILTER (WHERE b.path IS NULL) = 0 AS left_is_subset, count(*) FILTER (WHERE a.path IS NOT NULL AND b.path IS NOT NULL) AS common_count FROM {a} a FULL JOIN {b} b ON a.path = b.path"


@query("set03_equality", SETS.format(a="(SELECT DISTINCT path FROM selection)", b="(SELECT DISTINCT path FROM selection)"))
def _(d):
    return inventory.same_set(d.selection, d.selection.select("path").where("length(path) > 0"))


@query("set04_subset", SETS.format(a="(SELECT DISTINCT path FROM entries_a WHERE doc_id % 13 <> 0)", b="(SELECT path FROM working_b)"))
def _(d):
    return inventory.same_set(d.entries_a.where("doc_id % 13 <> 0").select("path"), d.working_b.select("path"))


@query("set05_distinct_sorted", "SELECT source, row_number() OVER (ORDER BY source) AS position FROM (SELECT DISTINCT source FROM documents)")
def _(d):
    return numbered_all(d.documents.select("source").distinct(), ["source"], start=1)


@query("set06_add_remove", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0")
def _(d):
    ids = d.supplier.select(F.col("s_suppkey").alias("id"))
    start = ids.where("id % 2 = 0")
    return inventory.removed_from(inventory.added_to(start, ids.where("id % 2 = 1")), ids.where("id % 3 = 0"))


@query("set07_intersect", "SELECT path FROM entries_a INTERSECT SELECT path FROM working_b")
def _(d):
    return d.entries_a.select("path").intersect(d.working_b.select("path"))


@query("src01_scan_listing", "SELECT count(*) FILTER (WHERE p IS NULL) AS file_count, count(*) FILTER (WHERE p IS NOT NULL) AS warning_count, bool_or(p IS NOT NULL) AS incomplete FROM (SELECT CASE WHEN path IN ('Assets/src1.prefab') THEN NULL ELSE 'x' END AS p FROM candidate_paths WHERE path IN ('Assets/src1.prefab', 'Assets', 'README.md'))")
def _(d):
    return scan.scan_state(scan.classified(d.candidate_paths.where("path in ('Assets/src1.prefab', 'Assets', 'README.md')").select("path")))


@query("src01_scan_files")
def _(d):
    """The files of the dataset itself, from their metadata."""
    files = scan.listing(d.spark, d.sf_dir)
    return files.select(F.element_at(F.split("location", "/"), -1).alias("name"), "size_bytes")


@query("src02_scan_hashed")
def _(d):
    """Every file of the dataset with the hash of its bytes; tests/test_operators.py reads the same files."""
    files = scan.listing(d.spark, d.sf_dir, hashed=True)
    return files.select(F.element_at(F.split("location", "/"), -1).alias("name"), "size_bytes", "object_id")


@query("src03_incremental_scan", "SELECT count(*) FILTER (WHERE r IS NULL) AS hashed_count, CAST(coalesce(sum(size_bytes) FILTER (WHERE r IS NULL), 0) AS BIGINT) AS hashed_bytes, count(r) AS reused_count, CAST(coalesce(sum(size_bytes) FILTER (WHERE r IS NOT NULL), 0) AS BIGINT) AS reused_bytes FROM (SELECT w.size_bytes, CASE WHEN w.fingerprint = c.fingerprint AND w.size_bytes = c.size_bytes AND w.size_bytes = a.size_bytes AND w.modified_at_utc = a.modified_at_utc AND c.object_id = a.object_id THEN c.object_id END AS r FROM working_b w LEFT JOIN fingerprint_cache c ON w.path = c.path LEFT JOIN entries_a a ON w.path = a.path)")
def _(d):
    return scan.scan_profile(scan.reusable(d.working_b, d.fingerprint_cache, d.entries_a))


@query("src04_metadata_scan", "SELECT path, size_bytes, modified_at_utc FROM working_b WHERE size_bytes > 1000")
def _(d):
    return d.working_b.where("size_bytes > 1000").select("path", "size_bytes", "modified_at_utc")


@query("src05_scan_profile", "SELECT split_part(path, '/', 2) AS source, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM working_b GROUP BY 1")
def _(d):
    return scan.tree_sizes(d.working_b, F.split_part("path", F.lit("/"), F.lit(2)).alias("source"))


@query("src07_snapshot_load", "SELECT path, size_bytes, object_id FROM snapshot_entries WHERE snapshot_id = 7")
def _(d):
    return records.snapshot_entries(d.snapshot_entries, 7).select("path", "size_bytes", "object_id")


@query("src08_headers", "SELECT snapshot_id, created_at_utc, name FROM snapshots")
def _(d):
    return records.headers(d.snapshots, ["snapshot_id", "created_at_utc", "name"])


@query("src09_snapshot_ids", "SELECT DISTINCT id AS snapshot_id FROM candidate_ids WHERE regexp_full_match(id, '[0-9a-f]{64}')")
def _(d):
    return records.snapshot_ids(d.candidate_ids.select(F.concat(F.lit("snapshots/aa/bb/"), "id").alias("location")))


@query("src10_key_order", "SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY lower(path)) AS position FROM entries_a")
def _(d):
    keyed = manifest.manifest_rows(d.entries_a)
    return keyed.select("path", F.row_number().over(Window.partitionBy(F.split_part("path", F.lit("/"), F.lit(2))).orderBy("key")).cast("bigint").alias("position"))


@query("src14_valid_fingerprints", "SELECT path, object_id FROM fingerprint_cache WHERE length(path) % 5 <> 0")
def _(d):
    path = F.when(F.length("path") % 5 == 0, F.concat("path", F.lit("."))).otherwise(F.col("path"))
    return records.valid_fingerprints(d.fingerprint_cache.withColumn("path", path)).select("path", "object_id")


@query("src15_index_read", "SELECT object_id, reference_count, size_bytes FROM live_refs")
def _(d):
    return records.index_if_current(d.live_refs, "current").select("object_id", "reference_count", "size_bytes")


@query("src16_json_events", "SELECT event_id, CAST(json_extract_string(props, '$.ref') AS STRING) AS ref FROM events")
def _(d):
    return d.events.select("event_id", F.get_json_object("props", "$.ref").alias("ref"))


JOURNAL = """CASE doc_id % 6 WHEN 0 THEN '{"schemaVersion": 3, "state": "staged"}' WHEN 1 THEN '{"schemaVersion": 2, "state": "staged"}' WHEN 2 THEN '{broken' WHEN 3 THEN '{"schemaVersion": 3, "state": "odd"}' WHEN 4 THEN '{"state": "staged"}' ELSE '{"schemaVersion": 3, "state": "committed"}' END"""


@query("src17_pending_journals", "SELECT doc_id AS transaction_id, ['staged', 'unsupportedSchema:2', 'unreadable', 'unknown', 'unreadable', 'committed'][1 + doc_id % 6] AS state FROM documents")
def _(d):
    return records.journal_states(d.documents.select(F.col("doc_id").alias("transaction_id"), F.expr(JOURNAL).alias("json")))


@query("src18_tree_sizes", "SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM working_b")
def _(d):
    return scan.tree_sizes(d.working_b)


@query("src19_materialize", "SELECT doc_id, length(text) AS chars FROM documents WHERE doc_id % 10 <> 3")
def _(d):
    stored = d.documents.withColumn("object_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return stored.where(F.sha2("text", 256) == F.col("object_id")).select("doc_id", F.length("text").cast("bigint").alias("chars"))


DISTINCT_TEXTS = "SELECT sha256(text) AS object_id, text, min(doc_id) AS doc_id, length(text) AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY text"


@query("src20_object_verification", f"SELECT object_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'size mismatch' ELSE 'hash mismatch' END AS problem FROM ({DISTINCT_TEXTS}) WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0")
def _(d):
    """All texts, each an object once; some are made to be missing, or of another size or content."""
    objects = d.documents.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    objects = objects.select(F.sha2("text", 256).alias("object_id"), F.length("text").cast("bigint").alias("size_bytes"), "doc_id", "text")
    size = F.when(F.col("doc_id") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    present = objects.where("doc_id % 7 <> 0").select("object_id", size.alias("size_bytes"), content.alias("content"))
    return verify.object_verification(objects.select("object_id", "size_bytes"), present, full=True)


@query("src21_path_state", "SELECT path, object_id, size_bytes, modified_at_utc FROM working_b WHERE path = 'Assets/src5/en/5.txt'")
def _(d):
    return scan.path_state(d.working_b, "Assets/src5/en/5.txt")
