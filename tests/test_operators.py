"""Small cases by hand, and laws that hold for any input."""

import pytest
from pyspark.sql import functions as F

from stratakit.functions import display, paths
from stratakit.operators import diff, gc, history, inventory, manifest, plan, recovery, refs, tree, verify
from stratakit.operators.common import numbered_all
from stratakit.schema import DDL, mismatches, schema, validate_schema
from stratakit.sinks import store
from stratakit.sources import records, scan
from stratakit.streaming import progress

# The inputs of the cases below and what must come of them.
FILES = "path string, object_id string, size_bytes bigint, modified_at_utc string"
SNAPSHOT = [("Assets/Foo.prefab", "one", 3, "t1"), ("Assets/Delete.me", "x", 6, "t1"), ("Assets/Same.txt", "s", 1, "t1")]
WORKING = [("Assets/Foo.prefab", "three", 5, "t2"), ("Assets/Extra.prefab", "extra", 5, "t2"), ("Assets/Same.txt", "s", 1, "t1")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(SNAPSHOT, FILES), spark.createDataFrame(WORKING, FILES)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


VALID = ["Assets/Foo.prefab", "Assets/ Avatar/Foo.prefab", "Assets/Foo.prefab.meta", "Packages/manifest.json", "ProjectSettings/ProjectSettings.asset"]
INVALID = ["", "README.md", "Assets", "Assets/", "Assets/../README.md", "C:\\foo", "Assets//Foo.prefab", "Assets/Foo.prefab.", "Assets/CON.txt", ".strata/project.json", "Assets/CON", "Assets/con.txt", "Assets/COM¹.prefab", "Assets/CONIN$", "/Assets/x", "Assets/a\x01b", "Assets/x ", "Assets/a|b", "assets/x", "Assets/./x"]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in VALID + INVALID + [None]], "path string")
    got = {r["path"]: r["ok"] for r in df.select("path", paths.is_tracked_path(F.col("path")).alias("ok")).collect()}
    assert got == {p: True for p in VALID} | {p: False for p in [*INVALID, None]}


def test_temp_names(spark):
    h = "0123456789abcdef" * 2
    good = [f"Assets/.strata-{h}.tmp", f".strata-r-{h[:16]}-{h}.tmp"]
    bad = [f"strata-{h}.tmp", f".strata-{h}.tmp.x", f".strata-{h[:-1]}.tmp", f".strata-{h.upper()}.tmp", f".strata-r-{h}-{h}.tmp", f".strata-r-{h[:16]}.tmp", f"x.strata-{h}.tmp", f".strata-{h}/x"]
    df = spark.createDataFrame([(p,) for p in good + bad], "path string")
    assert sorted(r[0] for r in df.where(paths.is_owned_temp(F.col("path"))).collect()) == sorted(good)


def test_portable_key(spark):
    df = spark.createDataFrame([("Assets/\u0130/Cafe\u0301.asset",), ("ASSETS/A",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.portable_key(F.col("p"))).collect()] == ["assets/i\u0307/caf\u00e9.asset", "assets/a", None]


def test_companions(spark):
    df = spark.createDataFrame([(p,) for p in ("Assets/a.mat", "Assets/a.mat.meta", "Packages/a", "Assets/.meta")], "p string")
    assert [r[0] for r in df.select(paths.companion(F.col("p"))).collect()] == ["Assets/a.mat.meta", "Assets/a.mat", None, None]


def test_diff(tables):
    a, b = tables
    assert rows(diff.content_diff(a, b), "path", "change_type") == [("Assets/Delete.me", "deleted"), ("Assets/Extra.prefab", "added"), ("Assets/Foo.prefab", "modified"), ("Assets/Same.txt", "unchanged")]
    assert diff.diff_summary(diff.content_diff(a, b, complete=False)).first().asDict() == {"added_count": 1, "modified_count": 1, "deleted_count": 0, "unchanged_count": 1, "unknown_count": 1}
    assert rows(diff.content_diff(a, a).select("change_type").distinct(), "change_type") == [("unchanged",)]
    swap = {"added": "deleted", "deleted": "added"}
    assert sorted((p, swap.get(k, k)) for p, k in rows(diff.content_diff(a, b), "path", "change_type")) == rows(diff.content_diff(b, a), "path", "change_type")


def test_hidden_edit(spark):
    a = spark.createDataFrame([("Assets/x", "old", 1, "t")], FILES)
    b = spark.createDataFrame([("Assets/x", "new", 1, "t")], FILES)
    assert rows(diff.metadata_diff(a, b), "change_type") == [("unchanged",)] and rows(diff.content_diff(a, b), "change_type") == [("modified",)]


def test_restore_and_discard(spark, tables):
    a, b = tables
    todo = plan.restore_plan(a, b)
    assert plan.plan_summary(todo).first().asDict() == {"restore_count": 1, "replace_count": 1, "delete_count": 1, "metadata_count": 0, "staged_bytes": 9, "backup_bytes": 10, "total_bytes": 19}
    chosen = spark.createDataFrame([("Assets/Foo.prefab",), ("Assets/Extra.prefab",), ("Assets/None",)], "path string")
    s = plan.plan_summary(plan.discard_plan(a, b, chosen)).first()
    assert (s["replace_count"], s["delete_count"], s["staged_bytes"], s["backup_bytes"], s["total_bytes"]) == (1, 1, 3, 10, 13)
    columns = ["path", "object_id", "size_bytes", "modified_at_utc"]
    assert rows(plan.apply_plan(b, todo), *columns) == rows(a, *columns)
    assert rows(plan.apply_plan(plan.apply_plan(b, todo), plan.inverse(todo)), *columns) == rows(b, *columns)
    assert plan.is_redundant(a, plan.apply_plan(b, todo)) and not plan.is_redundant(a, b) and not plan.is_redundant(a, a, 1)
    assert plan.plan_id(todo).first() == plan.plan_id(todo.repartition(5)).first() != plan.plan_id(todo.limit(2)).first()
    assert plan.operation_violations(todo, a).count() == 0 and plan.before_mismatches(todo, b).count() == 0
    assert plan.mac_matches("p", b"k", plan.mac("p", b"k")) and not plan.mac_matches("q", b"k", plan.mac("p", b"k"))


def test_mtime_only(spark):
    a = spark.createDataFrame([("Assets/x", "c", 4, "t1")], FILES)
    b = spark.createDataFrame([("Assets/x", "c", 4, "t2")], FILES)
    s = plan.plan_summary(plan.restore_plan(a, b)).first()
    assert (s["metadata_count"], s["replace_count"], s["staged_bytes"], s["backup_bytes"]) == (1, 0, 0, 0)


def test_closure_takes_companions_and_blockers(spark):
    files = lambda *p: spark.createDataFrame([(x, x, 1, "t") for x in p], FILES)
    chosen = spark.createDataFrame([("Assets/Added.asset",)], "path string")
    working = files("Assets/Added.asset", "Assets/Added.asset.meta", "Assets/Other")
    assert rows(plan.selection_closure(chosen, files("Assets/Z"), working), "path") == [("Assets/Added.asset",), ("Assets/Added.asset.meta",)]
    chosen = spark.createDataFrame([("Assets/a/b",)], "path string")
    assert rows(plan.selection_closure(chosen, files("Assets/a/b"), files("Assets/a", "Assets/a/b/c")), "path") == [("Assets/a",), ("Assets/a/b",), ("Assets/a/b/c",)]


def test_refs(spark):
    entries = [(v, f"Assets/{k}", f"o{v}-{k}", 1) for v in range(4) for k in range(16)] + [(v, "Assets/shared", "shared", 2) for v in range(4)]
    df = spark.createDataFrame(entries, "snapshot_id int, path string, object_id string, size_bytes bigint")
    full = refs.object_refs(df)
    assert full.agg(F.count("*"), F.sum("reference_count"), F.count_if(F.col("reference_count") == 1)).first() == (65, 68, 64)
    step = refs.object_refs(df.where("snapshot_id = 0")).drop("conflicting")
    for v in (1, 2, 3):
        step = refs.add_refs(step, df.where(F.col("snapshot_id") == v))
    assert rows(step, "object_id", "reference_count") == rows(full, "object_id", "reference_count")
    less = refs.remove_refs(step, df.where("snapshot_id = 3"))
    assert rows(less, "object_id", "reference_count") == rows(refs.object_refs(df.where("snapshot_id < 3")), "object_id", "reference_count")
    clash = spark.createDataFrame([(9, "Assets/s", "shared", 3)], df.schema)
    with pytest.raises(Exception, match="two sizes"):
        refs.add_refs(step, clash).collect()
    with pytest.raises(Exception, match="fewer references"):
        refs.remove_refs(step.where("object_id <> 'shared'"), df.where("snapshot_id = 3")).collect()


def test_multiplicity_counts_ways(spark):
    roots = spark.createDataFrame([("r", 2)], "node string, multiplicity bigint")
    edges = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "d", 3), ("r", "d", 1)], "parent_id string, child_id string, n bigint")
    assert dict(rows(refs.multiplicity(roots, edges), "node", "multiplicity")) == {"r": 2, "a": 2, "b": 4, "c": 6, "d": 20}
    loop = edges.union(spark.createDataFrame([("d", "a", 1)], edges.schema))
    with pytest.raises(RuntimeError, match="cycle"):
        refs.multiplicity(roots, loop, most_depth=8)
    assert rows(gc.reachable(roots.select("node"), loop), "node") == [("a",), ("b",), ("c",), ("d",), ("r",)]


def test_gc(spark):
    objects = spark.createDataFrame([(f"{k:04d}", 1) for k in range(1005)], "id string, size_bytes bigint").withColumn("family", F.lit("object"))
    shown = gc.truncated(objects, ["family"], [F.col("id")], 1000)
    assert shown.count() == 1000 and shown.select("group_count", "details_truncated").distinct().collect() == [(1005, True)]
    gone = objects.select(F.lit("l").alias("location"), "id")
    assert gc.apply_gc(gone, "p", "p", False, len, lot=100)["deleted"] == 1005
    for args in (("p", "q", False), ("p", "p", True)):
        with pytest.raises(ValueError):
            gc.apply_gc(gone, *args, len)

    def fail(_):
        raise OSError("disk")

    assert gc.apply_gc(gone, "p", "p", False, fail) == {"deleted": 0, "complete": False, "error": "disk"}
    assert rows(gc.gc_summary(objects.limit(0)), "family", "candidate_count") == [("chunk", 0), ("inventory", 0), ("object", 0)]


def test_verify(spark):
    e = [("s", p, p.lower(), 1, f"o{k}") for k, p in enumerate(["Assets/Foo.asset", "Assets/foo.asset", "Assets/a", "Assets/a!b", "Assets/a/b", "Assets/CON"])] + [("s", "Assets/z", "assets/z", -2, "o0")]
    found = rows(verify.verify(spark.createDataFrame(e, "snapshot_id string, path string, portable_key string, size_bytes bigint, object_id string")), "check", "subject")
    assert found == [("ancestor is a file", "s/Assets/a/b"), ("invalid path", "Assets/CON"), ("negative size", "Assets/z"), ("object with two sizes", "o0"), ("portable key collision", "s/Assets/Foo.asset")]


def test_inventory(spark):
    log = spark.createDataFrame([("p", 1, "add", "A"), ("p", 2, "add", "B"), ("p", 3, "add", "C"), ("p", 4, "remove", "B")], "project_id string, generation bigint, operation string, snapshot_id string")
    assert rows(inventory.membership(log), "snapshot_id") == [("A",), ("C",)]
    gone = lambda *r: spark.createDataFrame([r], "project_id string, snapshot_id string, current_latest string, parent string")
    assert [r["latest"] for r in inventory.latest_after_delete(log, gone("p", "C", "C", "B")).collect()] == ["A"]
    assert [r["latest"] for r in inventory.latest_after_delete(log, gone("p", "A", "C", None)).collect()] == ["C"]
    members = inventory.membership(log).select("snapshot_id")
    with pytest.raises(Exception, match="already"):
        inventory.added_to(members, members.limit(1)).collect()
    with pytest.raises(Exception, match="no such"):
        inventory.removed_from(members, spark.createDataFrame([("Z",)], "snapshot_id string")).collect()
    chain = spark.createDataFrame([(f"s{k}", k, f"s{k - 1}" if k else None) for k in range(13)], "state_id string, generation bigint, parent_id string")
    got = inventory.parent_chain(chain, spark.createDataFrame([("s12",)], "state_id string"))
    assert rows(got, "generation", "step") == sorted(((k, 12 - k) for k in range(13)), key=str)
    with pytest.raises(ValueError, match="cycle"):
        inventory.parent_chain(chain.withColumn("parent_id", F.coalesce("parent_id", F.lit("s5"))), spark.createDataFrame([("s12",)], "state_id string"))


def test_tree(spark):
    many = spark.createDataFrame([(f"Assets/f{i:02d}/a{j:02d}.txt", "added") for i in range(20) for j in range(20)], "path string, change_type string")
    table = tree.tree_rows(many)
    closed = tree.flattened(table, spark.createDataFrame([], "path string"))
    assert closed.count() == 1
    everything = tree.positions(tree.flattened(table, table.where("kind = 'folder'").select("path")))
    shown = [r["path"] for r in everything.orderBy("position").collect()]
    assert len(shown) == 1 + 20 + 400 and shown == sorted(shown)
    two = tree.tree_rows(spark.createDataFrame([("Assets/A.asset", "added"), ("Packages/B.json", "modified")], "path string, change_type string"))
    assert rows(two.where("kind = 'folder'"), "path", "pos_in_set", "set_size", "depth") == [("Assets", 1, 2, 0), ("Packages", 2, 2, 0)]
    deep = tree.tree_rows(spark.createDataFrame([("Assets/x/y/A", "added"), ("Assets/x/y/z/B", "deleted")], "path string, change_type string"))
    assert rows(deep, "kind", "path", "parent", "depth") == [("file", "Assets/x/y/A", "Assets/x/y", 1), ("file", "Assets/x/y/z/B", "Assets/x/y/z", 2), ("folder", "Assets/x/y", "", 0), ("folder", "Assets/x/y/z", "Assets/x/y", 1)]
    listed = numbered_all(spark.range(3).select(F.col("id").cast("string").alias("path")), ["path"])
    assert tree.window_slice(listed, 3, 100000, 50, 20, 8).count() == 3
    assert rows(tree.selected_range(listed, "gone", "1"), "path") == [("1",)]


def test_conflicts(spark):
    found = spark.createDataFrame([("A/Body.psd.meta", 100), ("A/Body.psd", 900), ("A/Only.mat.meta", 50)], "path string, size_bytes bigint")
    assert rows(recovery.grouped_conflicts(found), "id", "size_bytes") == [("A/Body.psd", 1000), ("A/Only.mat", 50)]


def test_manifest_is_order_independent(spark):
    entries = spark.createDataFrame([(f"Assets/g{k % 7}/f{k}.asset", k, "t", f"o{k}") for k in range(150)], "path string, size_bytes bigint, modified_at_utc string, object_id string")
    roots, sizes = set(), set()
    for seed in (1, 2):
        leaves, nodes = manifest.build(entries.orderBy(F.rand(seed)), leaf_bytes=1024)
        roots.add(manifest.root_digest(leaves).first()[0])
        sizes.add((leaves.count(), nodes.count()))
        assert leaves.groupBy("prefix").agg(F.sum(F.octet_length("path") + 64).alias("b"), F.count("*").alias("n")).where("b > 1024 and n > 1").count() == 0
    changed, _ = manifest.build(entries.withColumn("size_bytes", F.when(F.col("path").endswith("f3.asset"), 9).otherwise(F.col("size_bytes"))), leaf_bytes=1024)
    assert len(roots) == 1 == len(sizes) and manifest.root_digest(changed).first()[0] not in roots
    assert sizes.pop()[0] == 150


def test_scan(spark, tmp_path):
    for name in ("Assets/a.txt", "Assets/sub/b.txt", "Other/c.txt", "Assets/.strata-" + "0" * 32 + ".tmp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "Assets/link").symlink_to(tmp_path / "Assets/a.txt")
    got = scan.scan_tree(spark, str(tmp_path), hashed=True)
    assert rows(scan.accepted(got), "path", "size_bytes") == [("Assets/a.txt", 12), ("Assets/sub/b.txt", 16)]
    assert scan.scan_state(got).first().asDict() == {"file_count": 2, "warning_count": 3, "incomplete": True}
    assert scan.scan_state(got.where("path not like 'Other%' and path <> 'Assets/link'")).first()["incomplete"] is False


def test_incremental_scan(spark):
    make = lambda c, s: spark.createDataFrame(c, s)
    files = make([("a", "f1", 1, "t"), ("b", "f2", 2, "t"), ("c", "f3", 3, "t")], "path string, fingerprint string, size_bytes bigint, modified_at_utc string")
    cache = make([("a", "f1", 1, "oa"), ("b", "stale", 2, "ob"), ("c", "f3", 3, "oc")], "path string, fingerprint string, size_bytes bigint, object_id string")
    base = make([("a", 1, "t", "oa"), ("b", 2, "t", "ob"), ("c", 3, "t", "other")], "path string, size_bytes bigint, modified_at_utc string, object_id string")
    s = scan.scan_profile(scan.reusable(files, cache, base)).first()
    assert (s["hashed_count"], s["reused_count"], s["hashed_bytes"], s["reused_bytes"]) == (2, 1, 5, 1)


def test_versions_commit_last(spark, tmp_path):
    entries = spark.createDataFrame([("Assets/a", 1)], "path string, size_bytes bigint")
    header = lambda k: spark.createDataFrame([(k, 1)], "snapshot_id string, file_count bigint")
    store.publish_version(spark, entries, header("v1"), str(tmp_path), "v1")
    entries.write.parquet(f"{tmp_path}/entries/snapshot_id=v2")  # interrupted before its header
    heads, kept = store.published(spark, str(tmp_path))
    assert rows(heads, "snapshot_id") == [("v1",)] and rows(kept, "snapshot_id") == [("v1",)]
    with pytest.raises(ValueError):
        store.replace_index(entries, str(tmp_path), "i1", "h1", "h2")
    assert store.portable_export({"snapshots": heads, "index": heads}, str(tmp_path / "x")) == ["snapshots"]
    store.append_events(heads, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    conflicts = entries.select("path")
    store.export_conflicts(conflicts, conflicts, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        store.export_conflicts(conflicts, spark.createDataFrame([("other",)], "path string"), str(tmp_path / "d"))


def test_index_upsert_refuses_another_summary(spark):
    index = spark.createDataFrame([("s", 1)], "snapshot_id string, n bigint")
    assert store.index_upsert(index, index).count() == 1
    with pytest.raises(Exception, match="another summary"):
        store.index_upsert(index, index.withColumn("n", F.lit(2).cast("bigint"))).collect()


def test_strict_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"snapshot_id": "s", "name": "n"}\n')
    assert records.strict_json(spark, str(tmp_path / "a.json"), "name_overrides").collect() == [("s", "n")]
    (tmp_path / "b.json").write_text('{"snapshot_id": \n')
    with pytest.raises(Exception):
        records.strict_json(spark, str(tmp_path / "b.json"), "name_overrides").collect()
    with pytest.raises(ValueError):
        records.index_if_current(spark.range(1), "stale")


def test_schemas(spark):
    for name in DDL:
        empty = spark.createDataFrame([], schema(name))
        assert mismatches(empty, name) == []
    with pytest.raises(ValueError, match="objects"):
        validate_schema(spark.range(1), "objects")


def test_display(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert show(display.byte_text(F.lit(1023))) == "1023 B" and show(display.byte_text(F.lit(1536))) == "1.5 KB"
    assert show(display.compact_text(F.lit("Assets/" + "x" * 80 + "/y/z"))) == "Assets/.../y/z" and show(display.compact_text(F.lit("q" * 90))) == "q" * 34 + "..." + "q" * 35
    assert show(display.progress_percent(F.lit("scan"), F.lit(1), F.lit(2), F.lit(True))) == 12
    assert show(display.typed_path(F.lit("\\\\?\\UNC\\host\\x\\"))) == "\\\\host\\x" and show(display.typed_path(F.lit("///"))) == "///"
    assert show(display.editor_version(F.lit("m_EditorVersion: 2022.3.0f1\n"))) == "2022.3.0f1"


def test_banner_and_options(spark):
    w = spark.createDataFrame([(" a ", 1), ("b", 2), ("a", 3), ("", 4), ("c", 5)], "warning string, position int")
    assert rows(history.warning_banner(w, 2), "warning", "omitted") == [("a", 1), ("b", 1)]


def test_stream_throttle(spark, tmp_path):
    from pyspark.sql import types as T

    source = tmp_path / "in"
    events = [("a", "scan", 0), ("a", "scan", 10), ("a", "scan", 90), ("a", "store", 95), ("b", "scan", 5)]
    spark.createDataFrame(events, "source string, phase string, time_ms long").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(T._parse_datatype_string("source string, phase string, time_ms long")).parquet(str(source))
    q = progress.throttled_stream(stream).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert rows(spark.table("shown"), "source", "phase", "time_ms") == [("a", "scan", 0), ("a", "scan", 90), ("a", "store", 95), ("b", "scan", 5)]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_engine_stands_without_the_corpus_package():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['stratakit.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


# queries without SQL, against plain code


SF = "/root/testdata/sf0.001"


def plain_manifest(entries, leaf_bytes):
    """{prefix: entries} of leaves and {prefix: (entries, bytes, path bytes)} of nodes, by recursion over sorted keys."""
    import os.path
    import unicodedata

    key = lambda p: unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).lower()).encode().hex()
    leaves, nodes = {}, {}

    def cut(group):
        common = os.path.commonprefix([key(e["path"]) for e in group])
        common = common[:len(common) // 2 * 2]
        if len(group) == 1 or sum(len(e["path"].encode()) + 64 for e in group) <= leaf_bytes:
            leaves.setdefault(common, []).extend(group)
            return
        nodes[common] = (len(group), sum(e["size_bytes"] for e in group), sum(len(e["path"].encode()) for e in group))
        parts = {}
        for e in group:
            parts.setdefault(key(e["path"])[:len(common) + 2], []).append(e)
        for k in sorted(parts):
            cut(parts[k])

    cut(entries)
    return leaves, nodes, key


def test_manifest_equals_a_plain_build(spark):
    import hashlib

    from stratakit.plans.library import QUERIES
    from stratakit.plans.registry import Bound

    entries = [r.asDict() for r in Bound(spark, SF).entries_a.select("path", "size_bytes", "modified_at_utc", "object_id").collect()]
    leaves, nodes, key = plain_manifest(entries, 4096)
    want = set()
    for prefix, group in leaves.items():
        group.sort(key=lambda e: key(e["path"]))
        text = "\n".join("\t".join(str(e[c]) for c in ("path", "size_bytes", "modified_at_utc", "object_id")) for e in group)
        want.add((prefix, hashlib.sha256(f"leaf\n{len(text)}:{text}".encode()).hexdigest(), len(group), sum(e["size_bytes"] for e in group), sum(len(e["path"].encode()) for e in group)))
    got = QUERIES["cas09_manifest"](spark, SF).select("prefix", "chunk_id", "entry_count", "logical_size_bytes", "path_bytes").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    made = QUERIES["cas09_manifest_nodes"](spark, SF).collect()
    assert {(r["prefix"], r["entry_count"], r["logical_size_bytes"], r["path_bytes"]) for r in made} == {(p, *v) for p, v in nodes.items()} and len(made) == len(nodes)
    assert manifest.build(spark.createDataFrame([], "path string, size_bytes bigint, modified_at_utc string, object_id string"))[0].count() == 0


def test_hashed_scan_equals_the_bytes_of_all_files(spark):
    import hashlib
    from pathlib import Path

    from stratakit.plans.library import QUERIES

    want = {(f.name, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in Path(SF).iterdir()}
    assert {tuple(r) for r in QUERIES["src02_scan_hashed"](spark, SF).collect()} == want
    assert {tuple(r) for r in QUERIES["src01_scan_files"](spark, SF).collect()} == {(n, s) for n, s, _ in want}


def test_plan_mac_equals_a_plain_one(spark):
    import hashlib
    import hmac

    from stratakit.plans.library import QUERIES
    from stratakit.plans.registry import Bound

    d = Bound(spark, SF)
    todo = sorted((r.asDict() for r in plan.restore_plan(d.entries_a, d.working_b).collect()), key=lambda r: r["path"])
    item = lambda values: "".join(f"{len(v)}:{v}" for v in ("" if v is None else str(v) for v in values))
    folders = {}
    for r in todo:
        folders.setdefault(r["path"].rsplit("/", 1)[0], []).append(item(r[c] for c in plan.COLUMNS))
    parts = [item((f, hashlib.sha256("|".join(folders[f]).encode()).hexdigest())) for f in sorted(folders)]
    identity = hashlib.sha256("|".join(parts).encode()).hexdigest()
    row = QUERIES["cas04_plan_mac"](spark, SF).first()
    assert row["plan_id"] == identity and row["mac"] == hmac.new(hashlib.sha256(b"key").digest(), identity.encode(), hashlib.sha256).hexdigest()


def plain_throttle(events, least):
    """{(group, event)} that are shown, one event after the other."""
    shown, state = set(), {}
    for group, phase, t, whole, done, k in sorted(events, key=lambda e: (e[0], e[2], e[1], e[5])):
        last = state.get(group)
        if last is None or phase != last[0] or whole != last[1] or phase == "complete" or (whole > 0 and done >= whole) or t - last[2] >= least:
            shown.add((group, k))
            state[group] = (phase, whole, t)
    return shown


def test_throttle_measures_from_the_event_shown_last(spark):
    import random

    rng = random.Random(5)
    steady = [("a", "scan", 50 * k, 0, 0, k) for k in range(200)]
    mixed = [(f"g{rng.randrange(4)}", rng.choice(["scan", "scan", "scan", "store", "complete"]), rng.randrange(6000), rng.choice([0, 0, 5]), rng.randrange(7), 1000 + k) for k in range(400)]
    events = steady + mixed
    df = spark.createDataFrame(events, "source string, phase string, time_ms long, total long, completed long, k long")
    got = progress.throttled(df, "source", "time_ms", "phase", "total", "completed", ["k"])
    assert got.columns == df.columns
    assert {(r["source"], r["k"]) for r in got.collect()} == plain_throttle(events, 80)
    assert sorted(r["k"] for r in got.where("source = 'a'").collect()) == list(range(0, 200, 2))  # each second event, not the first alone
    assert progress.throttled(df.limit(0), "source", "time_ms", "phase").count() == 0


def test_stream_and_batch_throttle_agree(spark, tmp_path):
    events = [("a", "scan", 30 * k, 10, k % 11) for k in range(60)] + [("b", "scan", 5, 0, 0), ("b", "complete", 6, 0, 0), ("b", "complete", 7, 0, 0)]
    schema = "source string, phase string, time_ms long, total long, completed long"
    df = spark.createDataFrame(events, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.throttled_stream(stream).writeStream.format("memory").queryName("agreed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    batch = progress.throttled(df, "source", "time_ms", "phase", "total", "completed")
    assert rows(spark.table("agreed"), "source", "phase", "time_ms") == rows(batch, "source", "phase", "time_ms")


def test_chains_of_several_heads_may_meet(spark):
    states = spark.createDataFrame([("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 2, "b")], "state_id string, generation bigint, parent_id string")
    got = inventory.parent_chain(states, states.where("state_id in ('c', 'd')").select("state_id"))
    assert rows(got, "head", "state_id", "step") == [(h, s, k) for h in "cd" for s, k in (("a", 2), ("b", 1), (h, 0))]


def test_a_large_folder_is_numbered_in_ranges(spark):
    from stratakit.operators.common import numbered_within

    many = spark.createDataFrame([("big", f"f{k:04d}") for k in range(900)] + [("x", "b"), ("x", "a"), (None, "n")], "parent string, name string")
    got = numbered_within(many, ["parent"], [F.col("name")], "pos", start=1, size="n")
    assert {(r["parent"], r["name"], r["pos"], r["n"]) for r in got.collect()} == {("big", f"f{k:04d}", k + 1, 900) for k in range(900)} | {("x", "a", 1, 2), ("x", "b", 2, 2), (None, "n", 1, 1)}
    local = tree.tree_rows(spark.createDataFrame([(f"Assets/{n}", "added") for n in ("b", "A", "a", "B")], "path string, change_type string"), locale=True)
    assert [r["name"].lower() for r in local.where("kind = 'file'").orderBy("pos_in_set").collect()] == ["a", "a", "b", "b"]


def test_deletion_goes_on_behind_a_failure_elsewhere(spark):
    gone = spark.createDataFrame([("l", f"{k:03d}") for k in range(200)], "location string, id string")

    def delete(part):
        if any(r.id == "100" for r in part):
            raise OSError("stuck")
        return len(part)

    got = gc.apply_gc(gone, "p", "p", False, delete, lot=5)
    assert not got["complete"] and got["error"] == "stuck" and 100 <= got["deleted"] <= 195


def test_ascii_paths_do_not_reach_python(spark):
    found = spark.createDataFrame([("Assets/A",), ("Assets/Ä",)], "p string").select(paths.portable_key(F.col("p")).alias("k"))
    python = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "EvalPython" in x]
    assert len(python) == 1 and "_portable(CASE WHEN NOT RLIKE(p" in python[0]
