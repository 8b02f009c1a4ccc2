import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arkivist import functions
from arkivist.functions import formats, paths
from pyspark.sql import functions as F

# The published vectors: path, system, normal form.
VECTORS = [
    ("a//b///c", "linux", "a/b/c"), (r"a\b\c", "linux", "a/b/c"), ("./a/b", "linux", "a/b"), ("a/b/", "linux", "a/b"), ("/", "linux", "/"),
    ("Photos/2024", "darwin", "photos/2024"), ("Photos/2024", "linux", "Photos/2024"), (r"Photos\2024", "MSWin32", "photos/2024"),
    (r"C:\Users\Bob", "MSWin32", "c:/users/bob"), ("É/a", "darwin", "é/a"), ("", "linux", ""), ("A", None, "A"), ("A", "WIN32", "a"),
]


def test_normalize_path(spark):
    rows = spark.createDataFrame([(i, p, o) for i, (p, o, _) in enumerate(VECTORS)], "i int, p string, o string")
    got = {r.i: r.n for r in rows.select("i", paths.normalize_path("p", "o").alias("n")).collect()}
    assert [got[i] for i in range(len(VECTORS))] == [v[2] for v in VECTORS]


def test_all_leading_dots(spark):
    one = spark.createDataFrame([(r"././/a//B/c\d/", "darwin")], "p string, o string")
    assert one.select(paths.normalize_path("p", "o", strip_all_dot_slash=True)).first()[0] == "a/b/c/d"


def test_sql_functions(spark):
    functions.register(spark)
    rows = spark.createDataFrame([(i, p, o) for i, (p, o, _) in enumerate(VECTORS)], "i int, p string, o string")
    rows.createOrReplaceTempView("vectors")
    got = {r.i: r.n for r in spark.sql("SELECT i, normalize_path(p, o) AS n, path_depth(p), key_str('h', 'v', p) FROM vectors").collect()}
    assert [got[i] for i in range(len(VECTORS))] == [v[2] for v in VECTORS]


def test_parts_of_paths(spark):
    rows = spark.createDataFrame([("a/b/c",), ("x",), ("",)], "p string")
    got = rows.select("p", paths.depth("p"), paths.ancestors("p"), paths.basename("p"), paths.parent("p"), paths.key_str(F.lit("h"), F.lit("v"), "p")).collect()
    assert [tuple(r) for r in got] == [
        ("a/b/c", 3, ["a/b", "a", ""], "c", "a/b", "h:v:a/b/c"),
        ("x", 1, [""], "x", "", "h:v:x"),
        ("", 0, [], "", None, "h:v:<root>"),
    ]


def test_formats(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1024**2 - 1, 1024**2, 5 * 1024**3, 1024**5, 3 * 1024**6]
    rows = spark.createDataFrame([(s,) for s in sizes], "b long")
    assert [r[0] for r in rows.select(formats.fmt_bytes("b")).collect()] == [formats.bytes_text(s) for s in sizes]
    functions.register(spark)
    rows.createOrReplaceTempView("sizes")
    assert [r[0] for r in spark.sql("SELECT fmt_bytes(b) FROM sizes").collect()] == [formats.bytes_text(s) for s in sizes]
    assert formats.bytes_text(1536) == "1.50 KB" and formats.bytes_text(5) == "5 B"
    seconds = [0, 59, 60, 61, 3599, 3600, 3661, 90061]
    rows = spark.createDataFrame([(s,) for s in seconds], "s long")
    want = ["0s", "59s", "1m00s", "1m01s", "59m59s", "1h00m", "1h01m", "25h01m"]
    assert [r[0] for r in rows.select(formats.fmt_dur("s")).collect()] == want == [formats.duration_text(s) for s in seconds]
    assert formats.eta_text("hash", 50, 100, 0, now=100) == "hash: 50 / 100 done (50.0%, 0/s, 1m40s elapsed, ETA 1m40s)"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "a!", "ab", "b", "~"]), min_size=1, max_size=3), min_size=1, max_size=8))
def test_order_key_is_a_walk(spark, found):
    files = sorted({"/".join(p) for p in found})
    dirs = sorted({"/".join(f.split("/")[:i]) for f in files for i in range(len(f.split("/")))})

    def walk(top):
        here = [f for f in files if f.rpartition("/")[0] == top]
        below = sorted({d for d in dirs if d != top and d.rpartition("/")[0] == top and d})
        return [(f, "file") for f in sorted(here)] + [x for d in below for x in walk(d)] + [(top, "dir")]

    rows = spark.createDataFrame([(f, "file") for f in files] + [(d, "dir") for d in dirs], "p string, k string").coalesce(1)
    key = F.when(F.col("k") == "dir", paths.order_key("p", True)).otherwise(paths.order_key("p", False))
    got = [(r.p, r.k) for r in rows.select("p", "k", key.alias("o")).orderBy("o").collect()]
    assert got == walk("")


@pytest.mark.parametrize("system, folds", [("cygwin", True), ("msys", True), ("Darwin", True), ("linux", False), (None, False)])
def test_case_insensitive_systems(spark, system, folds):
    assert spark.createDataFrame([(system,)], "o string").select(paths.is_case_insensitive_os("o")).first()[0] is folds
