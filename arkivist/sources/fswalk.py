"""A file-system walk as a Spark data source: spark.read.format("fswalk").option("root", ...).

Partitions are groups of directories a few levels below the root, and the own files of those above.
Skipped directories are never entered; links are never followed.  The rows say what was
skipped and what could not be read, so that a scan can count both.  Names that are not UTF-8 come
escaped (see name_text), so that no two of them are one row.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arkivist.functions.paths import name_text

# Names that are never entered or recorded.
SKIPPED_DIRS = frozenset((".git", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", "$RECYCLE.BIN", "System Volume Information", ".DocumentRevisions-V100"))
SKIPPED_FILES = frozenset((".DS_Store", "Thumbs.db", "desktop.ini", ".localized"))

#: Levels that are opened to share out a walk.
MOST_LEVELS = 6

SCHEMA = "path string, size long, mtime long, status string"


class Part(InputPartition):
    """Directories to walk wholly, and directories of which only the own entries are read."""

    def __init__(self, deep: list[bytes], shallow: list[bytes]):
        super().__init__((deep, shallow))
        self.deep, self.shallow = deep, shallow


def subdirs(path: bytes) -> list[bytes]:
    """Directories below a path that a walk enters; none if it cannot be read (the walk will say so)."""
    try:
        return sorted(e.path for e in os.scandir(path) if e.is_dir(follow_symlinks=False) and os.fsdecode(e.name) not in SKIPPED_DIRS)
    except OSError:
        return []


def entries(root: bytes, start: bytes, deep: bool) -> Iterator[tuple]:
    """Rows of a directory below the root: of all its tree, or of its own entries."""
    todo = [start]
    while todo:
        here = todo.pop()
        try:
            found = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            yield _row(root, here, None, "error")
            continue
        below = []
        for e in found:
            name = os.fsdecode(e.name)
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                yield _row(root, e.path, None, "error")
                continue
            if stat.S_ISDIR(info.st_mode):
                if name in SKIPPED_DIRS:
                    yield _row(root, e.path, info, "skipped")
                elif deep:
                    below.append(e.path)
            elif not stat.S_ISREG(info.st_mode) or name in SKIPPED_FILES or info.st_size == 0:
                yield _row(root, e.path, info, "skipped")  # links are never followed
            else:
                yield _row(root, e.path, info, "file")
        todo.extend(reversed(below))


def _row(root: bytes, path: bytes, info, status: str) -> tuple:
    return (name_text(os.path.relpath(path, root)), info.st_size if info else None, int(info.st_mtime) if info else None, status)


class WalkReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.fsencode(options["root"])
        self.parts = max(1, int(options.get("partitions", "32")))

    def partitions(self):
        """The tree is opened level by level until there is enough to share out."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such directory: {os.fsdecode(self.root)}")
        shallow, deep = [self.root], subdirs(self.root)
        for _ in range(MOST_LEVELS):
            if not deep or len(deep) >= 4 * self.parts:
                break
            shallow, deep = shallow + deep, [x for d in deep for x in subdirs(d)]
        return [p for i in range(self.parts) if (p := Part(deep[i :: self.parts], shallow[i :: self.parts])).deep or p.shallow]

    def read(self, partition: Part):
        for path in partition.shallow:
            yield from entries(self.root, path, False)
        for path in partition.deep:
            yield from entries(self.root, path, True)


class WalkSource(DataSource):
    @classmethod
    def name(cls):
        return "fswalk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WalkReader(self.options)
