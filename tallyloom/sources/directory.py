"""A data source of directory entries: spark.read.format("directory").load(path).

One row an entry below the path: root, path (relative), name, depth (1 for the path's own entries), is_dir, is_link and size. Directories without files are rows like others. Directories whose names are ignored are neither shown nor opened; links to directories are shown as directories and links, and not followed. The driver opens directories level by level only until there are enough of them to share out; each task then walks its own. Filters on depth are pushed into the walk, which opens no directory below the greatest depth asked for, so that a listing of one level is `where("depth = 1")`. Directories that can't be opened have no entries; entries that go meanwhile are left out.

Options: path; ignoreDirs, a JSON list of names; ignoreFiles, a JSON list of shell patterns; tasks, how many shares the walk is dealt into (64). Paths are those of a file system that all machines have mounted.
"""

from __future__ import annotations

import fnmatch
import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "root string, path string, name string, depth int, is_dir boolean, is_link boolean, size bigint"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Share(InputPartition):
    """Directories (relative path, depth) to be listed, and whether all below them is to be walked."""

    places: list[tuple[str, int]]
    walked: bool


class DirectoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        names = lambda key: [x for x in json.loads(options.get(key) or "[]") if isinstance(x, str)]
        self.ignored, self.patterns = set(names("ignoredirs") or names("ignoreDirs")), names("ignorefiles") or names("ignoreFiles")
        self.tasks, self.deepest = int(options.get("tasks", 64)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            limit = None
            if isinstance(f, EqualTo | LessThanOrEqual) and f.attribute == ("depth",):
                limit = f.value
            elif isinstance(f, LessThan) and f.attribute == ("depth",):
                limit = f.value - 1
            if limit is not None:
                self.deepest = limit if self.deepest is None else min(self.deepest, limit)
            if limit is None or isinstance(f, EqualTo):
                yield f  # Spark checks it again

    def _within(self, depth: int) -> bool:
        return self.deepest is None or depth <= self.deepest

    def _entries(self, place: str, depth: int) -> list[tuple]:
        """The entries of one directory that aren't ignored, sorted."""
        if not self._within(depth + 1):
            return []
        out = []
        try:
            found = list(os.scandir(os.path.join(self.root, place)))
        except OSError:
            return []
        for e in found:
            try:
                is_dir, is_link = e.is_dir(), e.is_symlink()
                size = 0 if is_dir else e.stat(follow_symlinks=False).st_size
            except OSError:
                continue
            if e.name in self.ignored if is_dir else any(fnmatch.fnmatchcase(e.name, p) for p in self.patterns):
                continue
            out.append((self.root, os.path.join(place, e.name), e.name, depth + 1, is_dir, is_link, size))
        return sorted(out)

    def partitions(self) -> list[Share]:
        open_, listed = [("", 0)], []
        while open_ and len(open_) < self.tasks:
            listed += open_
            below = [(path, depth) for place, level in open_ for _, path, _, depth, is_dir, is_link, _ in self._entries(place, level) if is_dir and not is_link and self._within(depth + 1)]
            if len(below) <= len(open_):  # no broader: what is left is a few deep ones
                open_ = below
                break
            open_ = below
        deal = lambda places, walked: [Share(places[k :: self.tasks], walked) for k in range(min(self.tasks, len(places)))]
        return deal(listed, False) + deal(open_, True)

    def read(self, share: Share) -> Iterator[tuple]:
        left = list(share.places)
        while left:
            place, level = left.pop()
            for entry in self._entries(place, level):
                yield entry
                if share.walked and entry[4] and not entry[5]:
                    left.append((entry[1], entry[3]))


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DirectoryReader:
        path = self.options.get("path")
        if not path or not stat.S_ISDIR(os.stat(path).st_mode):
            raise ValueError(f"not a directory: {path}")
        return DirectoryReader(dict(self.options))


def read_directory(spark: SparkSession, path: str, ignore_dirs: list[str] | None = None, ignore_files: list[str] | None = None, tasks: int = 64) -> DataFrame:
    """The entries below a path. Settings that aren't lists of names ignore nothing."""
    names = lambda x: json.dumps([n for n in x if isinstance(n, str)] if isinstance(x, list) else [])
    spark.dataSource.register(DirectorySource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("directory").option("ignoreDirs", names(ignore_dirs)).option("ignoreFiles", names(ignore_files)).option("tasks", str(tasks)).load(path)
