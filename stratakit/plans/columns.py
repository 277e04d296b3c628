"""Queries that are predicates and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.functions import display, paths
from stratakit.operators import history, inventory, manifest, verify
from stratakit.operators.common import total
from stratakit.plans.registry import query
from stratakit.sources import records, scan

DEVICE = r"regexp_matches(upper(split_part({s}, '.', 1)), '^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(COM|LPT)[1-9¹²³])$')"
SEGMENT = rf"""CASE WHEN s = '' THEN 'a segment is empty' WHEN s IN ('.', '..') THEN 'a segment is . or ..'
  WHEN right(s, 1) IN (' ', '.') THEN 'a segment ends in a blank or dot' WHEN regexp_matches(s, '[<>"|?*]') THEN 'a segment holds a character that some file systems refuse'
  WHEN {DEVICE.format(s="s")} THEN 'a segment names a device' END"""
PROBLEM = f"""CASE WHEN path = '' THEN 'no path' WHEN contains(path, chr(92)) THEN 'holds a backslash' WHEN contains(path, ':') THEN 'holds a colon'
  WHEN starts_with(path, '/') THEN 'starts at the root' WHEN NOT contains(path, '/') THEN 'names a tracked root itself'
  WHEN split_part(path, '/', 1) NOT IN ('Assets', 'Packages', 'ProjectSettings') THEN 'lies in no tracked root'
  ELSE list_filter(list_transform(string_split(path, '/'), lambda s: {SEGMENT}), lambda p: p IS NOT NULL)[1] END"""


@query("flt01_path_valid", f"SELECT doc_id, path, {PROBLEM} AS problem FROM candidate_paths")
def _(d):
    return d.candidate_paths.select("doc_id", "path", paths.path_problem(F.col("path")).alias("problem"))


@query("flt02_reserved_names", f"SELECT doc_id, {DEVICE.format(s='list_last(string_split(path, chr(47)))')} AS reserved FROM candidate_paths")
def _(d):
    return d.candidate_paths.select("doc_id", paths.is_reserved_name(paths.base_name(F.col("path"))).alias("reserved"))


@query("flt03_ids", "SELECT doc_id, regexp_full_match(id, '[0-9a-f]{64}') AS object_id, regexp_full_match(id, '[0-9a-f]{32}') AS project_id FROM candidate_ids")
def _(d):
    return d.candidate_ids.select("doc_id", paths.is_object_id(F.col("id")).alias("object_id"), paths.is_project_id(F.col("id")).alias("project_id"))


TEMP = """CASE doc_id % 5 WHEN 0 THEN 'Assets/.strata-' || substr(id, 1, 32) || '.tmp' WHEN 1 THEN 'Assets/.strata-r-' || substr(id, 1, 16) || '-' || substr(id, 1, 32) || '.tmp'
  WHEN 2 THEN 'object-' || substr(id, 1, 32) || '.tmp' WHEN 3 THEN '.strata-' || substr(id, 1, 31) || '.tmp' ELSE '.strata-' || substr(id, 1, 32) || '.tmp.bak' END"""


@query("flt04_temp_names", rf"SELECT doc_id, regexp_full_match(list_last(string_split(p, '/')), '\.strata-(r-[0-9a-f]{{16}}-)?[0-9a-f]{{32}}\.tmp') AS owned, regexp_full_match(list_last(string_split(p, '/')), 'object-[0-9a-f]{{32}}\.tmp') AS object_temp FROM (SELECT doc_id, {TEMP} AS p FROM candidate_ids)")
def _(d):
    named = d.candidate_ids.select("doc_id", F.expr(TEMP).alias("p"))
    return named.select("doc_id", paths.is_owned_temp(F.col("p")).alias("owned"), paths.is_object_temp(F.col("p")).alias("object_temp"))


LOCATION = """CASE WHEN len(x) <> 4 OR x[1] <> 'objects' OR x[2] <> 'loose' THEN 'lies outside the object folder' WHEN length(x[3]) <> 2 THEN 'shard is not of two digits' WHEN length(x[4]) <> 64 THEN 'name is not of 64 digits'
  WHEN left(x[4], 2) <> x[3] THEN 'lies in the shard of other objects' WHEN NOT regexp_full_match(x[4], '[0-9a-f]{64}') THEN 'name is not in small hex digits' END"""


@query("flt05_location", f"SELECT doc_id, {LOCATION} AS problem FROM (SELECT doc_id, string_split(location, '/') AS x FROM stored_files)")
def _(d):
    return d.stored_files.select("doc_id", paths.location_problem(F.col("location")).alias("problem"))


@query("src11_object_listing", f"SELECT location, CASE WHEN problem IS NULL THEN x[4] END AS object_id, size_bytes, problem AS location_problem FROM (SELECT *, {LOCATION} AS problem FROM (SELECT *, string_split(location, '/') AS x FROM stored_files))")
def _(d):
    return records.object_listing(d.stored_files)


@query("src12_chunk_listing", f"SELECT problem IS NULL AS valid, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT *, {LOCATION} AS problem FROM (SELECT *, string_split(location, '/') AS x FROM stored_files WHERE doc_id % 2 = 0)) GROUP BY 1")
def _(d):
    listed = records.object_listing(d.stored_files.where("doc_id % 2 = 0"))
    return listed.groupBy(F.col("location_problem").isNull().alias("valid")).agg(total().alias("n"), total(None, "size_bytes").alias("bytes"))


@query("src13_inventory_listing", "SELECT substr(id, 1, 2) AS shard, count(*) AS n FROM candidate_ids WHERE regexp_full_match(id, '[0-9a-f]{64}') GROUP BY 1")
def _(d):
    return d.candidate_ids.where(paths.is_object_id(F.col("id"))).groupBy(F.substring("id", 1, 2).alias("shard")).agg(total().alias("n"))


@query("flt06_descendants", "SELECT path FROM working_b WHERE starts_with(path, 'Assets/src1/')")
def _(d):
    return d.working_b.where(paths.is_descendant(F.col("path"), F.lit("Assets/src1"))).select("path")


@query("flt07_ancestor_keys", "SELECT a.path, b.path AS below FROM (SELECT DISTINCT 'Assets/' || source AS path FROM documents) a JOIN entries_a b ON starts_with(b.path, a.path || '/')")
def _(d):
    tops = d.documents.select(F.concat(F.lit("Assets/"), "source").alias("path")).distinct()
    up = d.entries_a.select(F.col("path").alias("below"), F.explode(paths.ancestors(F.col("path"))).alias("path"))
    return up.join(tops, "path").select("path", "below")


@query("flt08_search", "SELECT project_id, snapshot_id, name FROM snapshots WHERE contains(lower(name || ' ' || CAST(snapshot_id AS STRING) || ' ' || created_at_utc), 'urgent 1')")
def _(d):
    return history.search(d.snapshots, "  URGENT 1 ").select("project_id", "snapshot_id", "name")


@query("flt10_project_scope", "SELECT snapshot_id, created_at_utc FROM snapshots WHERE project_id = 37")
def _(d):
    return d.snapshots.where("project_id = 37").select("snapshot_id", "created_at_utc")


@query("flt11_point_lookup", "SELECT object_id, size_bytes FROM objects WHERE object_id = 1234")
def _(d):
    return d.objects.where("object_id = 1234")


@query("flt17_state_shapes", """
SELECT generation FROM (SELECT *, 'op' || CAST(generation % 9 AS STRING) AS operation_id, CASE WHEN generation % 50 = 0 THEN 'initialize' ELSE operation END AS op, generation % 4 AS c FROM states)
WHERE NOT coalesce(CASE op WHEN 'initialize' THEN generation = 0 AND c = 0 AND parent_id IS NULL AND snapshot_id IS NULL AND FALSE
  WHEN 'add' THEN parent_id IS NOT NULL AND generation > 0 AND c > 0 ELSE parent_id IS NOT NULL AND generation > 0 END, FALSE)""")
def _(d):
    op = F.when(F.col("generation") % 50 == 0, "initialize").otherwise(F.col("operation"))
    rows = d.states.withColumn("operation_id", F.concat(F.lit("op"), (F.col("generation") % 9).cast("string"))).withColumn("operation", op).withColumn("count", F.col("generation") % 4)
    return inventory.shape_problems(rows).select("generation")


@query("flt18_terminal", "SELECT transaction_id, state IN ('committed', 'recovered') AS terminal FROM journals")
def _(d):
    from stratakit.operators.recovery import TERMINAL

    return d.journals.select("transaction_id", F.col("state").isin(*TERMINAL).alias("terminal"))


ROOTS = "CASE doc_id % 4 WHEN 0 THEN 'snapshots/' || substr(id, 1, 2) || '/' || substr(id, 3, 2) || '/' || id WHEN 1 THEN 'snapshots/00/zz/' || id WHEN 2 THEN 'x/' || id ELSE 'snapshots/' || substr(id, 1, 2) || '/' || substr(id, 3, 2) || '/' || id END"


@query("flt20_root_names", f"""
SELECT location, CASE WHEN len(x) < 3 THEN 'wrong depth' WHEN NOT regexp_full_match(x[-1], '[0-9a-f]{{64}}') THEN 'invalid snapshot file name' ELSE 'wrong shard' END AS warning
FROM (SELECT location, string_split(location, '/') AS x FROM (SELECT DISTINCT {ROOTS} AS location FROM candidate_ids))
WHERE len(x) < 3 OR NOT regexp_full_match(x[-1], '[0-9a-f]{{64}}') OR x[-3] || '/' || x[-2] <> substr(x[-1], 1, 2) || '/' || substr(x[-1], 3, 2)""")
def _(d):
    return verify.bad_root_names(d.candidate_ids.select(F.expr(ROOTS).alias("location")).distinct())


@query("flt21_shard_layout", f"SELECT count(*) AS roots, count(*) FILTER (WHERE len(x) = 4 AND regexp_full_match(x[4], '[0-9a-f]{{64}}') AND location = 'snapshots/' || substr(x[4], 1, 2) || '/' || substr(x[4], 3, 2) || '/' || x[4]) AS well_placed FROM (SELECT location, string_split(location, '/') AS x FROM (SELECT {ROOTS} AS location FROM candidate_ids))")
def _(d):
    name = paths.base_name(F.col("location"))
    good = paths.is_object_id(name) & (F.col("location") == paths.snapshot_location(name))
    return d.candidate_ids.select(F.expr(ROOTS).alias("location")).agg(total().alias("roots"), total(good).alias("well_placed"))


@query("flt24_plan_ids", "SELECT doc_id, regexp_full_match('gc-' || id, 'gc-[0-9a-f]{64}') AS valid FROM candidate_ids")
def _(d):
    return d.candidate_ids.select("doc_id", paths.is_plan_id(F.concat(F.lit("gc-"), "id"), "gc-").alias("valid"))


@query("prj01_manifest_rows", "SELECT path AS exact_path, size_bytes, CAST(epoch(CAST(substr(modified_at_utc, 1, 19) AS TIMESTAMP)) AS BIGINT) AS unix_seconds, CAST(substr(modified_at_utc, 21, 9) AS INTEGER) AS nanos, object_id FROM entries_a")
def _(d):
    at = F.col("modified_at_utc")
    seconds = F.unix_timestamp(F.to_timestamp(F.substring(at, 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
    return d.entries_a.select(F.col("path").alias("exact_path"), "size_bytes", seconds.alias("unix_seconds"), F.substring(at, 21, 9).cast("int").alias("nanos"), "object_id")


@query("prj02_metadata_rows", "SELECT path, size_bytes, modified_at_utc FROM working_b")
def _(d):
    return d.working_b.select("path", "size_bytes", "modified_at_utc")


@query("prj04_names", "SELECT s.snapshot_id, coalesce(o.name, s.name) AS name FROM snapshots s LEFT JOIN overrides o USING (snapshot_id)")
def _(d):
    return history.with_names(d.snapshots, d.overrides).select("snapshot_id", "name")


@query("prj05_companions", f"""
SELECT doc_id, path, CASE WHEN starts_with(path, 'Assets/') AND problem IS NULL THEN other END AS companion FROM (SELECT doc_id, first_path AS path, path AS other, {PROBLEM} AS problem
  FROM (SELECT doc_id, path AS first_path, CASE WHEN ends_with(path, '.meta') THEN left(path, length(path) - 5) ELSE path || '.meta' END AS path FROM candidate_paths))""")
def _(d):
    return d.candidate_paths.select("doc_id", "path", paths.companion(F.col("path")).alias("companion"))


@query("prj06_warnings", f"SELECT doc_id, path || ': ' || problem AS warning FROM (SELECT doc_id, path, {PROBLEM} AS problem FROM candidate_paths) WHERE problem IS NOT NULL")
def _(d):
    found = d.candidate_paths.withColumn("problem", paths.path_problem(F.col("path"))).where("problem is not null")
    return found.select("doc_id", display.warning_text(F.col("path"), F.col("problem")).alias("warning"))


@query("prj07_locations", "SELECT doc_id, 'objects/loose/' || substr(id, 1, 2) || '/' || id AS object_location, 'snapshots/' || substr(id, 1, 2) || '/' || substr(id, 3, 2) || '/' || id AS snapshot_location FROM candidate_ids WHERE length(id) = 64")
def _(d):
    return d.candidate_ids.where("length(id) = 64").select("doc_id", paths.object_location(F.col("id")).alias("object_location"), paths.snapshot_location(F.col("id")).alias("snapshot_location"))


@query("prj08_relative", "SELECT page_id, CASE WHEN starts_with(url, 'https://site1') THEN NULL WHEN starts_with(url, 'https:/') THEN substr(url, 8) END AS relative FROM (SELECT page_id, replace(url, chr(92), '/') AS url FROM pages)")
def _(d):
    rel = paths.relative_to(F.col("url"), "https:/")
    return d.pages.select("page_id", F.when(~F.startswith("url", F.lit("https://site1")), rel).alias("relative"))


@query("prj09_compact", """
SELECT doc_id, CASE WHEN length(t) <= 72 THEN t WHEN len(x) >= 3 AND length(x[1] || '/.../' || x[-2] || '/' || x[-1]) <= 72 THEN x[1] || '/.../' || x[-2] || '/' || x[-1] ELSE left(t, 34) || '...' || right(t, 35) END AS shown
FROM (SELECT doc_id, t, string_split(t, '/') AS x FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(left(text, 40 + doc_id % 90), ' ', '/') WHEN doc_id % 3 = 1 THEN left(text, 120) ELSE lang END AS t FROM documents))""")
def _(d):
    t = F.when(F.col("doc_id") % 3 == 0, F.replace(F.expr("left(text, 40 + doc_id % 90)"), F.lit(" "), F.lit("/"))).when(F.col("doc_id") % 3 == 1, F.expr("left(text, 120)")).otherwise(F.col("lang"))
    return d.documents.select("doc_id", t.alias("t")).select("doc_id", display.compact_text(F.col("t")).alias("shown"))


@query("prj10_bytes", """
SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS STRING) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS shown
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars % 1024 WHEN 1 THEN n_chars * 128 WHEN 2 THEN n_chars * 131072 ELSE n_chars * 134217728 END AS b FROM documents)""")
def _(d):
    b = F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") % 1024).when(F.col("doc_id") % 4 == 1, F.col("n_chars") * 128).when(F.col("doc_id") % 4 == 2, F.col("n_chars") * 131072).otherwise(F.col("n_chars") * 134217728)
    return d.documents.select("doc_id", display.byte_text(b).alias("shown"))


@query("prj11_progress", """
SELECT doc_id, CAST(CASE WHEN phase = 'uiComplete' THEN 100 WHEN phase = 'complete' THEN 99
  WHEN phase = 'scan' THEN least(99, floor(25 * r)) WHEN phase = 'storeCheckpoint' THEN least(99, floor(25 + 45 * r)) WHEN phase = 'syncCheckpoint' THEN least(99, floor(75 + 10 * r))
  WHEN total > 0 THEN least(99, floor(100 * greatest(0, least(1, completed / total)))) END AS INTEGER) AS percent
FROM (SELECT *, CASE WHEN total > 0 THEN greatest(0, least(1, completed / total)) ELSE 1 END AS r FROM (SELECT doc_id, ['scan', 'storeCheckpoint', 'syncCheckpoint', 'applying', 'complete', 'uiComplete'][1 + doc_id % 6] AS phase, doc_id % 50 AS completed, doc_id % 7 * 8 AS total FROM documents))""")
def _(d):
    phase = F.element_at(F.array(*map(F.lit, ("scan", "storeCheckpoint", "syncCheckpoint", "applying", "complete", "uiComplete"))), (1 + F.col("doc_id") % 6).cast("int"))
    return d.documents.select("doc_id", display.progress_percent(phase, F.col("doc_id") % 50, F.col("doc_id") % 7 * 8, F.lit(True)).alias("percent"))


@query("prj12_location_status", """
SELECT s.s_suppkey AS project_id, CASE WHEN s.s_nationkey = n.n_nationkey THEN 'current' WHEN s.s_suppkey % 3 = 0 THEN 'copiedSuspected' ELSE 'moved' END AS status
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_suppkey % 25""")
def _(d):
    registry = d.supplier.select(F.col("s_suppkey").alias("project_id"), F.concat(F.lit("/root"), "s_nationkey").alias("last_root_path"))
    seen = d.supplier.select(F.col("s_suppkey").alias("project_id"), F.concat(F.lit("/root"), (F.col("s_suppkey") % 25).cast("string")).alias("root_path"), F.when(F.col("s_suppkey") % 3 == 0, "same").otherwise("missing").alias("marker"))
    joined = seen.join(registry, "project_id")
    status = F.when(F.col("root_path") == F.col("last_root_path"), "current").when(F.col("marker") != "missing", "copiedSuspected").otherwise("moved")
    return joined.select("project_id", status.alias("status"))


@query("prj13_index_status", """
SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 11 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'corrupt' WHEN s_suppkey % 5 = 0 THEN 'incompatible' WHEN s_nationkey % 3 = 0 THEN 'stale' ELSE 'current' END AS state FROM supplier""")
def _(d):
    k = F.col("s_suppkey")
    facts = d.supplier.select(k.alias("project_id"), (k % 11 != 0).alias("exists"), (k % 7 != 0).alias("readable"), (k % 5 != 0).alias("compatible"), (F.col("s_nationkey") % 3 != 0).alias("same_head"))
    state = F.when(~F.col("exists"), "missing").when(~F.col("readable"), "corrupt").when(~F.col("compatible"), "incompatible").when(~F.col("same_head"), "stale").otherwise("current")
    return facts.select("project_id", state.alias("state"))


@query("prj14_gc_presentation", "SELECT label, n AS total_count, least(n, 40) AS displayed_count, greatest(0, n - 40) AS omitted_count FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def _(d):
    n = d.embeddings.groupBy("label").agg(total().alias("total_count"))
    shown = F.least("total_count", F.lit(40).cast("bigint"))
    return n.select("label", "total_count", shown.alias("displayed_count"), display.omitted(F.col("total_count"), shown).alias("omitted_count"))


@query("prj15_latest_count", "SELECT transaction_id, CASE WHEN n % 3 <> 0 AND n % 4 <> 1 AND (n % 2 = 0 OR n - 4 > 0) THEN n - 4 END AS change_count FROM (SELECT transaction_id, count(*) AS n FROM journal_steps GROUP BY transaction_id)")
def _(d):
    rows = d.journal_steps.groupBy("transaction_id").agg(total().alias("n"))
    n = F.col("n")
    return rows.select("transaction_id", display.latest_change_count(n - 4, n % 3 != 0, F.when(n % 4 == 1, 1).otherwise(0), n % 2 == 0).alias("change_count"))


@query("prj16_typed_paths", r"""
SELECT page_id, CASE WHEN regexp_replace(t, '[\\/]+$', '') = '' THEN t ELSE regexp_replace(t, '[\\/]+$', '') END AS shown
FROM (SELECT page_id, trim(CASE page_id % 4 WHEN 0 THEN 'UNC_' || url || '//' WHEN 1 THEN '  ' || url || '/' WHEN 2 THEN '///' ELSE chr(92) || chr(92) || substr(url, 9) END) AS t FROM pages)""")
def _(d):
    k, url = F.col("page_id") % 4, F.col("url")
    t = F.when(k == 0, F.concat(F.lit("\\\\?\\UNC_"), url, F.lit("//"))).when(k == 1, F.concat(F.lit("  "), url, F.lit("/"))).when(k == 2, F.lit("///")).otherwise(F.concat(F.lit("\\\\?\\UNC\\"), F.substring(url, 9, 1 << 20)))
    return d.pages.select("page_id", display.typed_path(t).alias("shown"))


@query("prj17_retained_size", "SELECT label, coalesce(CASE WHEN label % 2 = 0 THEN n END, n + 1) AS stored_size_bytes FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def _(d):
    n = d.embeddings.groupBy("label").agg(total().alias("n"))
    now = n.select("label", F.when(F.col("label") % 2 == 0, F.col("n")).alias("stored_size_bytes"))
    return history.retained_size(now, n.select("label", (F.col("n") + 1).alias("stored_size_bytes")), "label")


@query("prj18_index_view", "SELECT s_suppkey AS project_id, state IS NULL OR state = 'current' AS available, coalesce(state, 'current') <> 'current' AND s_suppkey % 2 = 0 AS rebuildable FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'current' END AS state FROM supplier)")
def _(d):
    k = F.col("s_suppkey")
    view = display.index_view(F.when(k % 3 == 0, "stale").when(k % 3 == 1, "current"), k % 2 == 0)
    return d.supplier.select(k.alias("project_id"), *[c.alias(n) for n, c in view.items()])


@query("prj19_editor_version", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2022.' || CAST(doc_id AS STRING) ELSE '' END AS version FROM documents")
def _(d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("first\nm_EditorVersion:  2022."), "doc_id", F.lit(" \r\nm_EditorVersion: x"))).otherwise(F.col("text"))
    return d.documents.select("doc_id", display.editor_version(text).alias("version"))


@query("prj20_project_view", "SELECT page_id AS project_id, list_last(string_split(url, '/')) AS name FROM pages")
def _(d):
    return d.pages.select(F.col("page_id").alias("project_id"), paths.base_name(F.col("url")).alias("name"))


@query("prj21_guidance", "SELECT transaction_id, n % 3 = 0 AS retryable, n % 3 > 0 AS can_select_files, n % 3 = 0 AS can_quarantine FROM (SELECT transaction_id, count(*) AS n FROM journal_steps GROUP BY transaction_id)")
def _(d):
    n = d.journal_steps.groupBy("transaction_id").agg(total().alias("n"))
    return n.select("transaction_id", *[c.alias(k) for k, c in display.recovery_guidance(F.col("n") % 3).items()])


@query("cas01_object_ids", "SELECT doc_id, sha256(text) AS object_id FROM documents")
def _(d):
    return d.documents.select("doc_id", F.sha2("text", 256).alias("object_id"))


@query("cas02_domain_hash", "SELECT doc_id, sha256('leaf' || chr(10) || CAST(length(text) AS STRING) || ':' || text) AS leaf_id, sha256('node' || chr(10) || CAST(length(text) AS STRING) || ':' || text) AS node_id FROM documents")
def _(d):
    return d.documents.select("doc_id", manifest.domain_hash("leaf", F.col("text")).alias("leaf_id"), manifest.domain_hash("node", F.col("text")).alias("node_id"))


@query("cas03_inventory_hash", "SELECT state_id, sha256('inventory' || chr(10) || CAST(length(operation) AS STRING) || ':' || operation || CAST(length(snapshot_id) AS STRING) || ':' || snapshot_id) AS digest FROM states")
def _(d):
    return d.states.select("state_id", manifest.domain_hash("inventory", F.col("operation"), F.col("snapshot_id")).alias("digest"))


@query("cas08_portable_key", "SELECT doc_id, nfc_normalize(lower(nfc_normalize('Assets/' || text))) AS portable_key FROM documents")
def _(d):
    return d.documents.select("doc_id", paths.portable_key(F.concat(F.lit("Assets/"), "text")).alias("portable_key"))


@query("cas21_fingerprint", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 3 AS STRING) || ':' || CAST(doc_id AS STRING) || ':' || CAST(n_chars AS STRING) END AS fingerprint FROM documents")
def _(d):
    c = F.col("doc_id")
    return d.documents.select("doc_id", paths.fingerprint(c % 3, F.when(c % 5 != 0, c), F.col("n_chars")).alias("fingerprint"))


@query("cas22_ancestors", "SELECT path, array_to_string(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')), '|') AS ancestors FROM changes")
def _(d):
    return d.changes.select("path", F.array_join(paths.ancestors(F.col("path")), "|").alias("ancestors"))


@query("src06_rejects", f"SELECT path AS relative_path, problem AS reason, TRUE AS makes_incomplete, path || ': ' || problem AS warning FROM (SELECT path, {PROBLEM} AS problem FROM candidate_paths) WHERE problem IS NOT NULL")
def _(d):
    return scan.warnings(scan.classified(d.candidate_paths.select("path")))
