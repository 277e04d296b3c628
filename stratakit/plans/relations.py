"""How the engine's relations are bound to the driver's tables."""

from __future__ import annotations

from stratakit.plans.registry import relation

# two versions of one tree of files
relation("entries_a", """
  SELECT 'v1' AS snapshot_id, 'Assets/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, n_chars AS size_bytes,
         '2024-01-01T00:00:' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || '.000000000Z' AS modified_at_utc, sha256(text) AS object_id, doc_id
  FROM documents WHERE doc_id % 11 <> 0""")
relation("working_b", """
  SELECT 'Assets/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path,
         CASE WHEN doc_id % 7 = 0 THEN n_chars + doc_id % 2 ELSE n_chars END AS size_bytes,
         '2024-01-01T00:00:' || lpad(CAST(CASE WHEN doc_id % 5 = 0 THEN (doc_id + 1) % 60 ELSE doc_id % 60 END AS STRING), 2, '0') || '.000000000Z' AS modified_at_utc,
         CASE WHEN doc_id % 7 = 0 THEN sha256(text || '*') ELSE sha256(text) END AS object_id,
         'dev:' || CAST(doc_id * 3 % 1000 AS STRING) AS fingerprint, doc_id
  FROM documents WHERE doc_id % 13 <> 0""")
relation("fingerprint_cache", """
  SELECT 'Assets/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, n_chars AS size_bytes,
         CASE WHEN doc_id % 9 = 0 THEN 'old:' ELSE 'dev:' END || CAST(doc_id * 3 % 1000 AS STRING) AS fingerprint, sha256(text) AS object_id
  FROM documents WHERE doc_id % 4 <> 0""")
relation("selection", "SELECT 'Assets/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path FROM documents WHERE doc_id % 3 = 0")
relation("selected_folders", "SELECT DISTINCT 'Assets/' || source || '/de' AS path FROM documents WHERE source IN ('src1', 'src5', 'src12')")
# files with companions: every third has one, some stand alone
relation("assets", """
  SELECT CASE WHEN doc_id % 4 = 3 THEN 'Packages/' ELSE 'Assets/' END || source || '/' || CAST(doc_id - doc_id % 2 AS STRING) || '.mat' || CASE WHEN doc_id % 2 = 1 THEN '.meta' ELSE '' END AS path,
         n_chars - 300 AS size_bytes FROM documents WHERE doc_id % 5 <> 0""")
relation("asset_selection", "SELECT path FROM assets WHERE length(path) % 3 = 0")
# snapshots, their entries and the store
relation("snapshots", """
  SELECT CAST(o_custkey AS BIGINT) AS project_id, CAST(o_orderkey AS BIGINT) AS snapshot_id, CAST(o_orderdate AS STRING) AS created_at_utc, o_orderpriority AS name, CAST(floor(o_totalprice) AS BIGINT) AS logical_size_bytes FROM orders""")
relation("snapshot_entries", """
  SELECT CAST(l_orderkey AS BIGINT) AS snapshot_id, 'Assets/' || CAST(l_linenumber AS STRING) || '/' || CAST(l_suppkey AS STRING) AS path, CAST(l_partkey AS BIGINT) AS object_id, CAST(l_quantity AS BIGINT) AS size_bytes FROM lineitem""")
relation("sized_entries", """
  SELECT CAST(l_orderkey AS BIGINT) AS snapshot_id, 'Assets/' || CAST(l_linenumber AS STRING) || '/' || CAST(l_suppkey AS STRING) AS path, CAST(l_partkey AS BIGINT) AS object_id, CAST(l_partkey % 50 AS BIGINT) AS size_bytes FROM lineitem""")
# the store lacks some objects, has some of another size, and holds others that nothing refers to
relation("objects", """
  SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(p_partkey % 50 + CASE WHEN p_partkey % 31 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT CAST(1000000000000 + doc_id AS BIGINT) AS object_id, CAST(n_chars AS BIGINT) AS size_bytes FROM documents""")
relation("live_refs", "SELECT object_id, size_bytes, count(*) AS reference_count FROM sized_entries GROUP BY object_id, size_bytes")
relation("overrides", "SELECT CAST(o_orderkey AS BIGINT) AS snapshot_id, 'kept by ' || o_orderstatus AS name FROM orders WHERE o_orderkey % 7 = 0")
# the inventory log: one member in twenty values, operations from event types
relation("states", """
  SELECT user_id AS project_id, event_id AS generation, CASE WHEN event_id % 3 = 1 THEN 'remove' ELSE 'add' END AS operation,
         'h' || CAST(event_id AS STRING) AS state_id, CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS STRING) ELSE 'h' || CAST(event_id - 1 AS STRING) END AS parent_id,
         's' || CAST(event_id % 23 AS STRING) AS snapshot_id FROM events""")
relation("journal_steps", "SELECT conv_id AS transaction_id, turn AS generation, role, text FROM conversations")
relation("journals", """
  SELECT conv_id AS transaction_id, CASE WHEN count(*) % 5 = 0 THEN 'applying' WHEN count(*) % 5 = 1 THEN 'committed' WHEN count(*) % 5 = 2 THEN 'staged' WHEN count(*) % 5 = 3 THEN 'recovered' ELSE 'created' END AS state,
         'transactions/' || CAST(conv_id AS STRING) AS location FROM conversations GROUP BY conv_id""")
# changes for the tree
relation("changes", """
  SELECT CASE WHEN doc_id % 4 = 0 THEN 'Assets/' || source || '/deep/er/' || lang || '/' ELSE 'Packages/' || lang || '/' || source || '/' END || CAST(doc_id AS STRING) || '.asset' AS path,
         CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'modified' ELSE 'deleted' END AS change_type, doc_id FROM documents WHERE doc_id % 2 = 0""")
# paths and ids of every kind of fault
relation("candidate_paths", """
  SELECT doc_id, CASE doc_id % 24
    WHEN 0 THEN '' WHEN 1 THEN 'Assets' WHEN 2 THEN 'Assets/' || source || '.prefab' WHEN 3 THEN 'assets/Foo.prefab' WHEN 4 THEN 'Assets//Foo.prefab'
    WHEN 5 THEN 'Assets/../README.md' WHEN 6 THEN 'C:/foo' WHEN 7 THEN '/Assets/Foo' WHEN 8 THEN 'Assets/Foo.prefab.' WHEN 9 THEN 'Assets/CON.txt'
    WHEN 10 THEN 'Assets/com3' WHEN 11 THEN 'Packages/' || source || '/manifest.json' WHEN 12 THEN 'Assets/a*b' WHEN 13 THEN 'Assets/Foo /bar'
    WHEN 14 THEN 'Assets/lpt9.x.y/z' WHEN 15 THEN 'README.md' WHEN 16 THEN 'ProjectSettings/' || lang || '.asset' WHEN 17 THEN 'Assets/console.txt'
    WHEN 18 THEN 'Assets/./x' WHEN 19 THEN 'Assets/conin$' WHEN 20 THEN 'Assets/ ' || source || '/x.meta' WHEN 21 THEN 'Assets/a?b/CON'
    WHEN 22 THEN 'Assets/' || source || '.meta' ELSE 'Assets/b<c' END AS path FROM documents""")
relation("candidate_ids", """
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substr(sha256(text), 1, 32) WHEN 3 THEN sha256(text) || '0' WHEN 4 THEN '' ELSE 'xyz' END AS id FROM documents""")
relation("stored_files", """
  SELECT doc_id, n_chars AS size_bytes, CASE doc_id % 7
    WHEN 0 THEN 'objects/loose/' || substr(sha256(text), 1, 2) || '/' || sha256(text) WHEN 1 THEN 'objects/loose/zz/' || sha256(text) WHEN 2 THEN 'objects/' || sha256(text)
    WHEN 3 THEN 'objects/loose/' || substr(sha256(text), 1, 3) || '/' || sha256(text) WHEN 4 THEN 'objects/loose/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 1, 40)
    WHEN 5 THEN 'objects/loose/' || upper(substr(sha256(text), 1, 2)) || '/' || upper(sha256(text)) ELSE 'objects/loose/' || substr(sha256(text), 1, 2) || '/' || sha256(text) END AS location FROM documents""")
# operations with every kind of fault, and the state of the files they name
relation("operations", """
  SELECT 'Assets/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, doc_id % 10 AS transaction_id,
         CASE doc_id % 4 WHEN 0 THEN 'restore' WHEN 1 THEN 'replace' WHEN 2 THEN 'delete' ELSE 'setMetadata' END AS operation_type,
         CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN CAST(NULL AS STRING) WHEN doc_id % 7 = 0 THEN sha256(text || '*') ELSE sha256(text) END AS before_hash,
         CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN CAST(NULL AS BIGINT) WHEN doc_id % 7 = 0 THEN n_chars + doc_id % 2 ELSE n_chars END AS before_size_bytes,
         CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN CAST(NULL AS STRING) ELSE '2024-01-01T00:00:' || lpad(CAST(doc_id % 59 AS STRING), 2, '0') || '.000000000Z' END AS before_modified_at_utc,
         CASE WHEN doc_id % 4 = 2 AND doc_id % 9 <> 0 THEN CAST(NULL AS STRING) WHEN doc_id % 8 = 1 THEN sha256(text || '!') ELSE sha256(text) END AS after_hash,
         CASE WHEN doc_id % 4 = 2 AND doc_id % 9 <> 0 THEN CAST(NULL AS BIGINT) ELSE n_chars END AS after_size_bytes,
         CASE WHEN doc_id % 4 = 2 AND doc_id % 9 <> 0 THEN CAST(NULL AS STRING) ELSE '2024-01-01T00:00:' || lpad(CAST(doc_id % 60 AS STRING), 2, '0') || '.000000000Z' END AS after_modified_at_utc
  FROM documents""")
