"""A stored tree: content-addressed objects, versions and their log, and what a user does with them.

The tree and the store must be mounted on all executors, which read, hash and copy the files; the driver sees
counts and the few states of one version.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.functions.paths import object_location, portable_key
from stratakit.operators import diff, gc, history, inventory, plan, refs, verify
from stratakit.operators.common import settled, total
from stratakit.sinks import store
from stratakit.sinks.log import Log
from stratakit.sources import scan

ENTRIES = "path string, size_bytes bigint, modified_at_utc string, object_id string, snapshot_id string"
HEADERS = "created_at_utc string, name string, parent_snapshot_id string, file_count bigint, logical_size_bytes bigint, snapshot_id string"


def _copied(source: str, target: str) -> None:
    """Written beside the target and moved there, so that no reader sees half a file."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{os.path.dirname(target)}/.strata-{uuid.uuid4().hex}.tmp"
    shutil.copyfile(source, part)
    os.replace(part, target)


def on_executors(rows: DataFrame, work) -> DataFrame:
    """``work`` on each row; (path, error) of the rows on which it failed. Run once, whatever is asked of the result."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            failed = []
            for row in batch.itertuples(index=False):
                try:
                    work(row)
                except OSError as e:
                    failed.append((row.path, str(e)))
            yield pd.DataFrame(failed, columns=["path", "error"])

    return settled(rows.mapInPandas(run, "path string, error string"))


class Repository:
    def __init__(self, spark: SparkSession, directory: str, root: str):
        self.spark, self.directory, self.root = spark, directory.rstrip("/"), root.rstrip("/")
        self.log = Log(spark, self.directory)

    def init(self) -> None:
        """An empty log; a store that has one already stays as it is."""
        if self.log.head() < 0:
            self.log.append("initialize", None)

    # what is stored

    def members(self) -> DataFrame:
        """(snapshot_id): versions that the log's last word on them keeps."""
        states = self.log.states().where("operation in ('add', 'remove')").withColumn("project_id", F.lit("this"))
        return inventory.membership(states).select("snapshot_id")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.directory}/{name}"
        fs, at = self.log._fs, self.log._path(path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """Headers of the members, the newest first by ``position``, under the names that renames gave them."""
        named = self.log.states().where("operation = 'rename'").groupBy("snapshot_id").agg(F.max_by("name", "generation").alias("name"))
        headers = self._table("headers", HEADERS).join(self.members(), "snapshot_id", "left_semi").withColumn("project_id", F.lit("this"))
        return history.with_names(history.ranked(headers), named).drop("project_id")

    def entries(self, snapshot_id: str | None = None) -> DataFrame:
        """Entries of all members, or of one; a version whose header disagrees with its entries is an error."""
        every = self._table("entries", ENTRIES)
        if snapshot_id is None:
            return every.join(self.members(), "snapshot_id", "left_semi")
        header = self.versions().where(F.col("snapshot_id") == snapshot_id)
        mine = every.where(F.col("snapshot_id") == snapshot_id)
        if header.isEmpty():
            raise ValueError(f"no checkpoint {snapshot_id}")
        if not verify.header_mismatches(header, mine).isEmpty():
            raise ValueError(f"checkpoint {snapshot_id} is damaged: its header differs from its entries")
        return mine

    def objects(self) -> DataFrame:
        """(object_id, size_bytes, location, valid): stored objects; those that lie at a wrong place are not valid."""
        at = f"{self.directory}/objects"
        if not os.path.isdir(at):
            return self.spark.createDataFrame([], "object_id string, size_bytes bigint, location string, valid boolean")
        self.spark.dataSource.register(scan.TreeSource)
        files = self.spark.read.format(scan.TreeSource.name()).load(at).where("problem is null")
        location = F.concat(F.lit("objects/"), F.col("path"))
        named = files.select(F.element_at(F.split("path", "/"), -1).alias("object_id"), "size_bytes", location.alias("location"))
        return named.withColumn("valid", F.col("location") == object_location(F.col("object_id")))

    # working tree

    def working(self, hashed: bool = True) -> DataFrame:
        found = scan.scan_tree(self.spark, self.root, hashed)
        if scan.scan_state(found).first()["incomplete"]:
            raise ValueError("the scan is incomplete: " + "; ".join(r["warning"] for r in scan.warnings(found).orderBy("relative_path").limit(5).collect()))
        return scan.accepted(found)

    def status(self) -> DataFrame:
        """One row: checkpoints, their logical bytes, objects and their bytes, the newest checkpoint."""
        versions = self.versions()
        one = refs.storage_summary(versions, refs.object_refs(self.entries()), self.objects())
        return one.join(versions.agg(F.max_by("snapshot_id", "created_at_utc").alias("latest")))

    def create(self, name: str, operation_id: str | None = None) -> str:
        """A checkpoint of the tree: new objects, then entries and header, then the state that makes it a member."""
        head = self.log.head()
        if operation_id is not None:
            done = self.log.states().where(F.col("operation_id") == operation_id).select("snapshot_id").first()
            if done:
                return done[0]
        files = settled(self.working().select("path", "size_bytes", "modified_at_utc", "object_id"))
        if not verify.key_collisions(files.withColumn("snapshot_id", F.lit("new")).withColumn("portable_key", portable_key(F.col("path")))).isEmpty():
            raise ValueError("paths collide on file systems that ignore case")
        root, directory = self.root, self.directory
        new = store.new_objects(store.put_actions(files, self.objects().select("object_id", "valid")))
        failed = on_executors(new, lambda r: _copied(f"{root}/{r.path}", f"{directory}/{r.location}")).first()
        if failed:
            raise OSError(f"{failed['path']}: {failed['error']}")
        parent = self.versions().agg(F.max_by("snapshot_id", "created_at_utc")).first()[0]
        snapshot_id = uuid.uuid4().hex * 2
        created = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f000Z")
        header = files.agg(total().alias("file_count"), total(None, "size_bytes").alias("logical_size_bytes"))
        header = header.select(F.lit(created).alias("created_at_utc"), F.lit(name).alias("name"), F.lit(parent).cast("string").alias("parent_snapshot_id"), "file_count", "logical_size_bytes")
        files.write.parquet(f"{self.directory}/entries/snapshot_id={snapshot_id}")
        header.write.parquet(f"{self.directory}/headers/snapshot_id={snapshot_id}")
        self.log.append("add", snapshot_id, expected=head, operation_id=operation_id)
        return snapshot_id

    def rename(self, snapshot_id: str, name: str) -> None:
        self._known(snapshot_id)
        self.log.append("rename", snapshot_id, name=name)

    def delete(self, snapshot_id: str) -> None:
        """The checkpoint is no member any more; its objects stay until they are collected."""
        self._known(snapshot_id)
        self.log.append("remove", snapshot_id)

    def _known(self, snapshot_id: str) -> None:
        if self.members().where(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise ValueError(f"no checkpoint {snapshot_id}")

    def diff(self, snapshot_id: str, metadata: bool = False) -> DataFrame:
        compare = diff.metadata_diff if metadata else diff.content_diff
        return compare(self.entries(snapshot_id), self.working(hashed=not metadata))

    def preview(self, snapshot_id: str, paths: list[str] | None = None) -> DataFrame:
        """The plan that restores the checkpoint; with ``paths``, of their closure only."""
        entries, working = self.entries(snapshot_id), self.working()
        if paths is None:
            return settled(plan.restore_plan(entries, working))
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return settled(plan.discard_plan(entries, working, plan.selection_closure(asked, entries, working)))

    def apply(self, snapshot_id: str, expected_plan: str, paths: list[str] | None = None) -> DataFrame:
        """Carry out the plan whose id was shown; a tree that changed since has another, which is refused.

        Files go first, then folders left empty, deepest first, then files come or change: each written beside its
        place and moved there. -> (path, error) of what failed; repeating the call goes on from there.
        """
        todo = self.preview(snapshot_id, paths)
        if plan.plan_id(todo).first()[0] != expected_plan:
            raise ValueError("the tree changed since the plan was made")
        lacking = gc.reference_problems(todo.where("operation_type in ('restore', 'replace')").select(F.col("after_hash").alias("object_id"), F.col("after_size_bytes").alias("size_bytes")), self.objects().where("valid"))
        if not lacking.isEmpty():
            raise ValueError("objects of the checkpoint are missing")
        root, directory = self.root, self.directory
        folders = settled(plan.directories(todo, self.working(hashed=False).withColumn("object_id", F.lit(""))).where("action = 'remove'"))
        failed = on_executors(todo.where("operation_type = 'delete'").select("path"), lambda r: os.remove(f"{root}/{r.path}"))
        for (depth,) in sorted(folders.select("depth").distinct().collect(), reverse=True):
            failed = failed.union(on_executors(folders.where(F.col("depth") == depth).select("path"), lambda r: os.rmdir(f"{root}/{r.path}")))

        def put(r) -> None:
            target = f"{root}/{r.path}"
            if r.operation_type != "setMetadata":
                _copied(f"{directory}/{r.location}", target)
            at = datetime.fromisoformat(r.after_modified_at_utc[:19] + "+00:00")
            ns = int(at.timestamp()) * 1_000_000_000 + int(r.after_modified_at_utc[20:29])
            os.utime(target, ns=(ns, ns))

        writes = todo.where("operation_type <> 'delete'").select("path", "operation_type", "after_modified_at_utc", object_location(F.col("after_hash")).alias("location"))
        return failed.union(on_executors(writes, put))

    # care

    def verify(self, snapshot_id: str | None = None, quick: bool = False) -> DataFrame:
        """(check, subject, detail) over entries and headers, and over objects: their size, and their hash unless ``quick``."""
        headers = self.versions()
        entries = self.entries().withColumn("portable_key", portable_key(F.col("path")))
        if snapshot_id is not None:
            self._known(snapshot_id)
            headers, entries = headers.where(F.col("snapshot_id") == snapshot_id), entries.where(F.col("snapshot_id") == snapshot_id)
        problems = gc.reference_problems(refs.object_refs(entries), self.objects().where("valid"))
        found = verify.verify(entries, headers).union(problems.select(F.concat(F.lit("object "), "problem").alias("check"), F.col("object_id").alias("subject"), F.lit(None).cast("string").alias("detail")))
        if quick:
            return found
        wanted = self.objects().where("valid").join(entries.select("object_id").distinct(), "object_id", "left_semi")
        self.spark.dataSource.register(scan.TreeSource)
        hashed = self.spark.read.format(scan.TreeSource.name()).option("hashed", "true").load(f"{self.directory}/objects").select(F.concat(F.lit("objects/"), "path").alias("location"), F.col("object_id").alias("hash"))
        damaged = wanted.join(hashed, "location").where("hash <> object_id")
        return found.union(damaged.select(F.lit("object content differs from its hash"), "object_id", F.lit(None).cast("string")))

    def index(self) -> DataFrame:
        """Reference counts of all members, for a rebuilt index; refused if the log moved while they were taken."""
        head = self.log.head()
        counted = settled(refs.object_refs(self.entries()))
        store.replace_index(counted, f"{self.directory}/index", f"v{head}", str(head), str(self.log.head()))
        return counted

    def garbage(self) -> DataFrame:
        """(location, id, size_bytes): objects that no member refers to, or that lie at a wrong place."""
        live = self.entries().select("object_id").distinct().withColumn("valid", F.lit(True))
        return settled(gc.unreferenced(self.objects(), live, ["object_id", "valid"]).select("location", F.col("object_id").alias("id"), "size_bytes"))

    def garbage_plan(self, garbage: DataFrame) -> str:
        by_shard = plan.digest(garbage.withColumn("shard", F.substring("id", 1, 3)), ["location"], ["location", "size_bytes"], ["shard"], "d")
        return plan.digest(by_shard, ["shard"], ["shard", "d"], out="plan_id").agg(F.max("plan_id")).first()[0] or ""

    def collect_garbage(self, expected_plan: str) -> dict:
        gone, directory = self.garbage(), self.directory

        def delete(rows: list) -> int:
            for r in rows:
                if os.path.exists(f"{directory}/{r.location}"):
                    os.remove(f"{directory}/{r.location}")
            return len(rows)

        return gc.apply_gc(gone, expected_plan, self.garbage_plan(gone), not gc.reference_problems(refs.object_refs(self.entries()), self.objects().where("valid")).isEmpty(), delete)
