"""A stored tree from the first checkpoint to the last collection, by its class and by the command line."""

import os

import pytest

from stratakit.__main__ import main
from stratakit.operators import plan
from stratakit.sinks import store
from stratakit.sinks.log import Log, Moved
from stratakit.sinks.repository import Repository


def write(root, path, text, ns=1_700_000_000_123_456_789):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)
    os.utime(at, ns=(ns, ns))


def tree(root):
    found = {}
    for at in sorted(root.rglob("*")):
        if at.is_file():
            found[str(at.relative_to(root))] = (at.read_text(), at.stat().st_mtime_ns)
    return found


@pytest.fixture
def made(spark, tmp_path):
    root = tmp_path / "tree"
    for path, text in (("Assets/a.txt", "one"), ("Assets/sub/b.txt", "two"), ("Assets/sub/b.txt.meta", "m"), ("Packages/x/copy.txt", "one"), ("ProjectSettings/empty", "")):
        write(root, path, text)
    repository = Repository(spark, str(tmp_path / "store"), str(root))
    repository.init()
    return repository, root


def test_restore_brings_back_every_byte_and_time(made):
    repository, root = made
    first = repository.create("first")
    before = tree(root)
    assert repository.objects().count() == 4  # equal contents are one object
    write(root, "Assets/a.txt", "changed")
    write(root, "Assets/sub/b.txt", "two", ns=5_000_000_123)
    write(root, "Assets/new/deep/c.txt", "three")
    os.remove(root / "Packages/x/copy.txt")
    changes = repository.diff(first).groupBy("change_type").count().collect()
    assert dict(map(tuple, changes)) == {"modified": 2, "added": 1, "deleted": 1, "unchanged": 2}
    shown = repository.preview(first)
    assert dict(map(tuple, shown.groupBy("operation_type").count().collect())) == {"replace": 1, "setMetadata": 1, "delete": 1, "restore": 1}
    identity = plan.plan_id(shown).first()[0]
    write(root, "Assets/late.txt", "late")
    with pytest.raises(ValueError, match="changed since"):
        repository.apply(first, identity)
    os.remove(root / "Assets/late.txt")
    assert repository.apply(first, identity).count() == 0
    assert tree(root) == before and not (root / "Assets/new").exists()
    assert repository.preview(first).isEmpty()


def test_discard_touches_the_closure_only(made):
    repository, root = made
    first = repository.create("first")
    write(root, "Assets/a.txt", "changed")
    write(root, "Assets/sub/b.txt", "x")
    write(root, "Assets/sub/b.txt.meta", "y")
    shown = repository.preview(first, ["Assets/sub/b.txt"])
    assert sorted(r["path"] for r in shown.collect()) == ["Assets/sub/b.txt", "Assets/sub/b.txt.meta"]
    repository.apply(first, plan.plan_id(shown).first()[0], ["Assets/sub/b.txt"])
    now = tree(root)
    assert now["Assets/sub/b.txt"][0] == "two" and now["Assets/sub/b.txt.meta"][0] == "m" and now["Assets/a.txt"][0] == "changed"


def test_lineage_names_and_deletion(made):
    repository, root = made
    first = repository.create("first")
    write(root, "Assets/a.txt", "second text")
    second = repository.create("second", operation_id="again")
    assert repository.create("second", operation_id="again") == second  # a repeated attempt
    repository.rename(second, "chosen")
    listed = {r["snapshot_id"]: r for r in repository.versions().collect()}
    assert listed[second]["parent_snapshot_id"] == first and listed[second]["name"] == "chosen" and listed[second]["position"] == 1
    repository.delete(first)
    assert [r["snapshot_id"] for r in repository.members().collect()] == [second]
    for call in (lambda: repository.rename(first, "x"), lambda: repository.entries(first), lambda: repository.delete("none")):
        with pytest.raises(ValueError, match="no checkpoint"):
            call()
    status = repository.status().first()
    assert status["checkpoint_count"] == 1 and status["latest"] == second and status["object_count"] == 5
    counted = {r["object_id"]: r["reference_count"] for r in repository.index().collect()}
    assert sorted(counted.values()) == [1, 1, 1, 1, 1]


def test_garbage_goes_only_by_the_plan_that_was_shown(made, tmp_path):
    repository, root = made
    first = repository.create("first")
    write(root, "Assets/a.txt", "other")
    write(root, "Packages/x/copy.txt", "other")
    repository.create("second")
    assert repository.garbage().isEmpty()
    repository.delete(first)
    stray = tmp_path / "store/objects/loose/zz" / ("0" * 64)
    stray.parent.mkdir()
    stray.write_text("stray")
    gone = repository.garbage()
    assert gone.count() == 2  # "one", and what lies at a wrong place
    with pytest.raises(ValueError, match="changed since"):
        repository.collect_garbage("another plan")
    assert repository.collect_garbage(repository.garbage_plan(gone)) == {"deleted": 2, "complete": True, "error": None}
    assert repository.garbage().isEmpty() and repository.verify().isEmpty() and not stray.exists()


def test_damage_is_found(made, tmp_path):
    repository, root = made
    first = repository.create("first")
    assert repository.verify(first).isEmpty()
    location = {r["object_id"]: r["location"] for r in repository.objects().where("size_bytes = 3").collect()}
    one, two = sorted(location)
    (tmp_path / "store" / location[one]).write_text("xyz")
    assert repository.verify(quick=True).isEmpty()
    assert [r["check"] for r in repository.verify().collect()] == ["object content differs from its hash"]
    os.remove(tmp_path / "store" / location[two])
    assert "object missing" in [r["check"] for r in repository.verify(quick=True).collect()]
    write(root, "Assets/a.txt", "changed")
    write(root, "Assets/sub/b.txt", "changed")
    with pytest.raises(ValueError, match="missing"):
        repository.apply(first, plan.plan_id(repository.preview(first)).first()[0])
    write(root, "README.md", "outside")
    with pytest.raises(ValueError, match="incomplete"):
        repository.create("refused")


def test_only_one_writer_gets_a_head(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.head() == -1 and log.states().isEmpty()
    assert log.append("initialize", None) == 0
    seen = log.head()
    assert log.append("add", "a", expected=seen, operation_id="op1") == 1
    assert log.append("add", "a", expected=seen, operation_id="op1") == 1  # the same attempt again
    with pytest.raises(Moved):
        log.append("add", "b", expected=seen, operation_id="op2")
    other = Log(spark, str(tmp_path))
    other.head = lambda: 0  # a writer that looked before the others wrote
    with pytest.raises(Moved):
        other.append("add", "c")
    assert [tuple(r) for r in log.states().orderBy("generation").select("generation", "operation", "snapshot_id").collect()] == [(0, "initialize", None), (1, "add", "a")]


def test_publishing_twice_and_behind_another_writer(spark, tmp_path):
    entries = spark.createDataFrame([("Assets/a", 1)], "path string, size_bytes bigint")
    header = spark.createDataFrame([(1,)], "file_count bigint")
    where = str(tmp_path)
    head = store.publish_version(spark, entries, header, where, "v1")
    assert store.publish_version(spark, entries, header, where, "v1") == head
    assert store.publish_version(spark, entries, header, where, "v2", expected_head=head) == head + 1
    with pytest.raises(Moved):
        store.publish_version(spark, entries, header, where, "v3", expected_head=head)
    headers, kept = store.published(spark, where)
    assert sorted(r["snapshot_id"] for r in headers.collect()) == ["v1", "v2"] and kept.count() == 2


def test_command_line(spark, made, tmp_path, capsys):
    _, root = made
    at = [str(tmp_path / "store"), str(root)]
    main(["init", *at])
    main(["create", *at, "--name", "first"])
    first = capsys.readouterr().out.split()[-1]
    write(root, "Assets/a.txt", "changed")
    main(["preview", *at, "--checkpoint", first])
    identity = next(x for x in capsys.readouterr().out.split("\n") if len(x) == 64 and set(x) <= set("0123456789abcdef"))
    main(["apply", *at, "--checkpoint", first, "--plan", identity])
    assert (root / "Assets/a.txt").read_text() == "one"
    for verb in (["status"], ["list"], ["verify", "--quick"], ["index"], ["garbage"]):
        main([verb[0], *at, *verb[1:]])
    main(["rename", *at, "--checkpoint", first, "--name", "renamed"])
    main(["changes", *at, "--checkpoint", first, "--metadata"])
    main(["delete", *at, "--checkpoint", first])
    main(["list", *at, "--out", str(tmp_path / "listed")])
    assert spark.read.parquet(str(tmp_path / "listed")).count() == 0
