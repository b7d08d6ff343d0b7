"""Directories of files as manifests and deltas.

``scan`` uses Spark's own ``binaryFile`` source, which sees plain files in any store. What only the
file system of a machine knows (modes, links, device files, hidden names) comes from the ``filetree``
data source, whose folder all executors must see."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import DIR, FILE, OPAQUE, WHITEOUT
from ..ship import ship

# File names that mark deletions in a delta directory of plain files.
WHITEOUT_PREFIX, OPAQUE_NAME = ".wh.", ".wh..wh..opq"
_PIECE = 1 << 20


def scan(spark: SparkSession, root: str, glob: str = "*", content: bool = False) -> DataFrame:
    """(path, size, mod_time_ns, sha256[, content]) of the plain files below ``root``, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    start = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    path = F.substr(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/"), F.lit(len(start) + 1))
    own = [path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mod_time_ns"), F.sha2("content", 256).alias("sha256")]
    return files.select(*own, *(["content"] if content else []))


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    """A partition for each folder below the root, down to ``levels``; the deepest read all below."""

    def __init__(self, root: str, levels: int):
        self.root, self.levels = root, levels

    def partitions(self) -> list[InputPartition]:
        out, level = [], [self.root]
        for depth in range(self.levels + 1):
            out += [_Folder(p, depth == self.levels) for p in level]
            level = [e.path for p in level for e in os.scandir(p) if e.is_dir(follow_symlinks=False)] if depth < self.levels else []
        return out

    def _row(self, path: str) -> tuple:
        info, name = os.lstat(path), os.path.basename(path)
        rel = os.path.relpath(path, self.root)
        up = os.path.dirname(rel)
        kind, size, digest = DIR, 0, None
        if stat.S_ISCHR(info.st_mode) and info.st_rdev == 0:
            kind = WHITEOUT
        elif name == OPAQUE_NAME:
            kind, rel = OPAQUE, up
        elif name.startswith(WHITEOUT_PREFIX):
            kind, rel = WHITEOUT, os.path.join(up, name[len(WHITEOUT_PREFIX) :])
        elif stat.S_ISLNK(info.st_mode):  # a link's content is its target
            target = os.fsencode(os.readlink(path))
            kind, size, digest = FILE, len(target), hashlib.sha256(target).hexdigest()
        elif stat.S_ISREG(info.st_mode):
            kind, size, h = FILE, info.st_size, hashlib.sha256()
            with open(path, "rb") as f:
                while piece := f.read(_PIECE):
                    h.update(piece)
            digest = h.hexdigest()
        return rel, kind, info.st_mode, size, info.st_mtime_ns, digest

    def read(self, partition: _Folder) -> Iterator[tuple]:
        pending = [partition.path]
        while pending:
            for entry in sorted(os.scandir(pending.pop()), key=lambda e: e.name):
                if entry.is_dir(follow_symlinks=False) and partition.deep:
                    pending.append(entry.path)
                yield self._row(entry.path)


class FileTree(DataSource):
    """``spark.read.format("filetree").option("levels", 1).load(folder)``: one row per entry of a
    tree with path, kind (file, dir, whiteout, opaque), st_mode, size, mod_time_ns and sha256."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, kind string, mode bigint, size bigint, mod_time_ns bigint, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        root = self.options["path"].removeprefix("file://")
        return _Reader(os.path.normpath(root), int(self.options.get("levels", "1")))


def delta(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """All entries below ``root`` as a delta. Deletions are device files of number 0 or marker files."""
    ship(spark)
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("levels", levels).load(root)
