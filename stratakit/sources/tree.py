"""A data source for working trees on a mounted file system: every file, hidden ones too, with times to the nanosecond."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    """A folder, with all below it or with its own files alone."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


def _time(ns: int) -> str:
    at = datetime.fromtimestamp(ns // 1_000_000_000, UTC)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{ns % 1_000_000_000:09d}Z"


class TreeReader(DataSourceReader):
    def __init__(self, root: str, hashed: bool):
        self.root, self.hashed = root, hashed

    def partitions(self) -> list[Folder]:
        """The folders two levels down, each with all below it, and what lies above them."""
        parts, level = [Folder(self.root, False)], [self.root]
        for last in (False, True):
            below = [e.path for d in level for e in sorted(os.scandir(d), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
            parts += [Folder(p, last) for p in below]
            level = below
        return parts

    def _files(self, folder: str, deep: bool) -> Iterator[os.DirEntry]:
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            if e.is_dir(follow_symlinks=False):
                if deep:
                    yield from self._files(e.path, True)
            else:
                yield e

    def read(self, partition: Folder) -> Iterator[tuple]:
        for e in self._files(partition.path, partition.deep):
            path = os.path.relpath(e.path, self.root).replace(os.sep, "/")
            if not e.is_file(follow_symlinks=False):
                yield path, None, None, None, None, "not a regular file"
                continue
            s, digest = e.stat(follow_symlinks=False), None
            if self.hashed:
                with open(e.path, "rb") as f:
                    digest = hashlib.file_digest(f, "sha256").hexdigest()
            mark = ":".join(map(str, (s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns)))
            yield path, s.st_size, _time(s.st_mtime_ns), digest, mark, None


class TreeSource(DataSource):
    """``spark.read.format("strata_tree").option("hashed", "true").load(root)``; the root must be mounted on all executors."""

    @classmethod
    def name(cls) -> str:
        return "strata_tree"

    def schema(self) -> str:
        return "path string, size_bytes bigint, modified_at_utc string, object_id string, fingerprint string, problem string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"].rstrip("/"), self.options.get("hashed", "false") == "true")
