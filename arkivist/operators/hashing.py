"""Content digests: of columns by Spark itself, of files by a reader that holds one chunk."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.functions.paths import name_bytes
from arkivist.ship import ship

CHUNK = 1 << 20


def content_digest(column, bits: int = 512):
    """Lower-case hex SHA-2 of a text or binary column."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, bits)


def place(mount: str, path: str) -> bytes:
    """Where a catalogued file is, as the system names it."""
    return os.path.join(os.fsencode(mount), name_bytes(path))


def file_digest(path: str | bytes, bits: int = 512, chunk: int = CHUNK) -> str | None:
    """Hex digest of a file; None if it cannot be read."""
    h = hashlib.new(f"sha{bits}")
    try:
        with open(path, "rb") as f:
            while block := f.read(chunk):
                h.update(block)
    except OSError:
        return None
    return h.hexdigest()


def hash_files(rows: DataFrame, bits: int = 512, root: str | None = None) -> DataFrame:
    """Adds sha512 and hash_status ('hashed', 'unreachable', 'error') to rows with path and mount_point.

    The files are read where the tasks run: rows should be those of this host.  root, if
    given, stands for the mount point.
    """
    ship(rows.sparkSession)
    columns = [c for c in rows.columns if c not in ("sha512", "hash_status")]
    here = rows.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in here.schema) + ", sha512 string, hash_status string"

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            mounts = b.column(columns.index("mount_point")).to_pylist() if root is None else [root] * b.num_rows
            sha, status = [], []
            for mount, path in zip(mounts, b.column(columns.index("path")).to_pylist(), strict=True):
                full = place(mount, path) if mount else b""
                if not mount or not os.path.isdir(mount) or not os.path.isfile(full):
                    digest, what = None, "unreachable"
                else:
                    digest = file_digest(full, bits)
                    what = "hashed" if digest else "error"
                sha.append(digest)
                status.append(what)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string()), pa.array(status, pa.string())], [*columns, "sha512", "hash_status"])

    return here.mapInArrow(read, schema)
