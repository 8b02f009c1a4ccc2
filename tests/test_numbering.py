import os
import subprocess
import sys

from arkivist.operators import numbering


def test_large_groups_are_numbered_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(f"g{i % 7 if i % 3 else 0}", (i * 37) % 1000, i) for i in range(1000)], "g string, o long, x long")
    a = numbering.numbered(rows, ["g"], ["o", "x"], "n", 10)
    monkeypatch.setattr(numbering, "MOST_ROWS", 5)
    b = numbering.numbered(rows, ["g"], ["o", "x"], "n", 10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.columns == b.columns


def test_workers_get_the_package(tmp_path):
    """From any folder, without a Python path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()
from arkivist.operators.hashing import hash_files
open({str(tmp_path / 'f')!r}, 'w').write('x')
rows = spark.createDataFrame([('f', {str(tmp_path)!r})], 'path string, mount_point string')
print('STATUS', hash_files(rows).first().hash_status)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "STATUS hashed" in out.stdout, out.stderr[-2000:]
