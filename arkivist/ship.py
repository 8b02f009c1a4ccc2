"""Brings the package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless the workers find it by their own path."""
    context = spark.sparkContext
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if ROOT in on_path or getattr(context, "_arkivist_shipped", False):
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="arkivist_code_")), "arkivist.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "arkivist")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(target)
    context._arkivist_shipped = True
