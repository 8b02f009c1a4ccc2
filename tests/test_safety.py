"""What must not happen: unique data deleted, a log folded in another order, a catalog lost, two names as one."""

import json
import os
import sqlite3
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from arkivist import sources
from arkivist.functions.paths import name_bytes, name_text
from arkivist.operators import merge
from arkivist.operators.common import shared_dir
from arkivist.plans import commands as c
from arkivist.plans import report
from arkivist.schema import CATALOG, LOG
from arkivist.sources.jsonl import append_log, read_jsonl, tombstones
from arkivist.sources.sqlite_catalog import SqliteCatalog
from arkivist.sources.store import CatalogStore
from arkivist.streaming.hashlog import replay
from tests.test_commands import digests, plan, rows, scan, tree

PRUNE = dict(keep_rule="first", interactive=False, hostname="here", apply=True, yes=True, quiet=True)


@pytest.mark.parametrize("file_level", [False, True])
@pytest.mark.parametrize("files", [{"a.txt": "same", "b.txt": "same"}, {"a/x": "one", "a/y": "three", "b/x": "one", "b/y": "three"}])
def test_a_plan_older_than_the_catalog_is_refused(spark, tmp_path, files, file_level):
    root = tree(tmp_path / "t", files)
    scan(spark, tmp_path / "c", root)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    last = sorted(files)[-1]
    tree(root, {last: "changed, and longer"})
    scan(spark, tmp_path / "c", root)
    done = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), file_level=file_level, **PRUNE)
    assert done.code == 2 and done.stale and done.deleted_files == 0
    assert all(os.path.exists(f"{root}/{f}") for f in files)


@pytest.mark.parametrize("changed, code, left", [("b.txt", 2, ["a.txt", "b.txt"]), ("a.txt", 2, ["a.txt", "b.txt", "c.txt"])])
def test_content_changed_at_equal_size_stays(spark, tmp_path, changed, code, left):
    """The catalog knows nothing of the change, or keeps the old digest: only reading shows it."""
    root = tree(tmp_path / "t", {f"{n}.txt": "same" for n in "abc"})
    scan(spark, tmp_path / "c", root)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    tree(root, {changed: "else"})
    scan(spark, tmp_path / "c", root)
    done = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), **PRUNE)
    assert done.code == code and sorted(os.listdir(root)) == left


def test_plans_are_read_by_line_and_in_one_piece(spark, tmp_path):
    root = tree(tmp_path / "t", {"a": "x", "b": "x", "c": "yy", "d": "yy"})
    scan(spark, tmp_path / "c", root)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    (tmp_path / "q.json").write_text(json.dumps(json.loads((tmp_path / "p.json").read_text())))
    read = [sorted((r.sig, r.member_idx, r.path, r.size_each) for r in report.read_plan(spark, str(tmp_path / n)).collect()) for n in ("p.json", "q.json")]
    assert read[0] == read[1] and len(read[0]) == 4
    order = [[r.sig for r in report.read_plan(spark, str(tmp_path / n)).filter("member_idx = 1").orderBy("group_idx").collect()] for n in ("p.json", "q.json")]
    assert order[0] == order[1]


def log_of(spark, appends, path, segments):
    for rows_ in appends:
        full = [("h", "/m", 1, "linux", p, p, t, sha, 1, "v") for p, t, sha in rows_]
        append_log(spark.createDataFrame(full, CATALOG), path, segments)


@pytest.mark.parametrize("segments", [False, True])
@pytest.mark.parametrize("arrivals, want", [([(1, "A"), (2, "C"), (3, None)], "C"), ([(10, None), (5, "A"), (7, "B")], "A"), ([(1, "A"), (1, "B"), (1, None), (1, "C")], "C")])
def test_logs_fold_in_the_order_of_writing(spark, tmp_path, arrivals, want, segments):
    log = f"file://{tmp_path}/log.jsonl"
    log_of(spark, [[("p", t, sha)] for t, sha in arrivals], log, segments)
    assert os.path.isdir(tmp_path / "log.jsonl") == segments
    batch = merge.merge_catalogs(merge.valid_rows(merge.union_inputs([read_jsonl(spark, log, LOG)]), 1), 1).collect()
    store = CatalogStore(spark, str(tmp_path / "s")).create(now=1)
    replay(spark, log, store, str(tmp_path / "cp"), 1, files_per_batch=1)
    stream = store.rows().collect()
    assert [(r.sha512, r.scanned_at) for r in batch] == [(r.sha512, r.scanned_at) for r in stream] == [(want, max(t for t, _ in arrivals))]


def test_a_malformed_line_stops_a_replay(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"hostname":"h","volume":"v","path":"a"}\nnot json\n')
    store = CatalogStore(spark, str(tmp_path / "s")).create(now=1)
    with pytest.raises(Exception, match="malformed"):
        replay(spark, str(tmp_path / "x.jsonl"), store, str(tmp_path / "cp"), 1)
    replay(spark, str(tmp_path / "x.jsonl"), store, str(tmp_path / "cp2"), 1, lenient=True)
    assert [r.path for r in store.rows().collect()] == ["a"]


def test_replay_does_not_bring_back_what_was_pruned(spark, tmp_path):
    root = tree(tmp_path / "t", {"a.txt": "same", "b.txt": "same"})
    scan(spark, tmp_path / "c", root)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    assert c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), **PRUNE).code == 0
    log = tmp_path / "c.hashlog.jsonl"
    assert log.is_file() and '"deleted":true' in log.read_text()
    c.merge_command(spark, str(tmp_path / "x.jsonl"), [str(log)], quiet=True)
    assert (tmp_path / "x.jsonl").is_file()
    for name, source in (("r", log), ("r2", tmp_path / "x.jsonl")):
        c.merge_command(spark, str(tmp_path / name), [str(source)], quiet=True)
        assert [r.path for r in rows(spark, tmp_path / name)] == ["a.txt"]
    again = spark.createDataFrame([("h", "/m", 1, "linux", "p", "p", 1, "s", 1, "v")], CATALOG)
    append_log(again, str(log))
    append_log(tombstones(again, 5), str(log))
    append_log(again, str(log))
    c.merge_command(spark, str(tmp_path / "r3"), [str(log)], quiet=True)
    assert [r.path for r in rows(spark, tmp_path / "r3")] == ["a.txt", "p"]


def test_names_that_are_not_utf8_are_told_apart(spark, tmp_path, catalog="c"):
    os.makedirs(tmp_path / "t" / "d")
    names = [b"x\xff", b"x\xfe", "x�".encode(), b"d/y\xff"]
    for n in names:
        with open(os.fsencode(str(tmp_path / "t")) + b"/" + n, "w") as f:
            f.write("same")
    assert [name_bytes(name_text(n)) for n in names] == names and len({name_text(n) for n in names}) == 4
    assert name_text("é x".encode()) == "é x"
    scan(spark, tmp_path / "c", tmp_path / "t")
    found = rows(spark, tmp_path / "c")
    assert len(found) == 4 and all(r.sha512 for r in found)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    done = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), **PRUNE)
    assert (done.code, done.deleted_files) == (0, 3) and len(os.listdir(os.fsencode(str(tmp_path / "t")))) == 1


def test_a_killed_writers_log_is_taken_in(spark, tmp_path):
    path = str(tmp_path / "c.sqlite")
    scan(spark, path, tree(tmp_path / "t", {"a": "x", "b": "x"}))
    kill = f"""
import sqlite3, os
con = sqlite3.connect({path!r}, isolation_level=None)
con.execute("PRAGMA journal_mode=WAL")
con.execute("UPDATE volumes SET mount_point = '/moved'")
os._exit(1)
"""
    subprocess.run([sys.executable, "-c", kill])
    assert os.path.exists(path + "-wal")
    store = SqliteCatalog(spark, path)
    own = store.rows().collect()
    store.commit(spark.createDataFrame(own, CATALOG))
    assert len(store.rows().collect()) == 2 and store.volumes()[0]["mount_point"] == "/moved"
    assert sqlite3.connect(path).execute("PRAGMA integrity_check").fetchone() == ("ok",)


def test_writers_do_not_undo_each_other(spark, tmp_path):
    path = str(tmp_path / "c.sqlite")
    store = SqliteCatalog(spark, path).create(now=1)
    con = sqlite3.connect(path, isolation_level=None)
    con.execute("BEGIN IMMEDIATE")
    with pytest.raises(BlockingIOError):
        store.open_or_create()
    con.execute("ROLLBACK")
    one = spark.createDataFrame([("h", "/m", 1, "linux", "p", "p", 1, "s", 1, "v")], CATALOG)
    CatalogStore(spark, str(tmp_path / "s")).create(now=1)
    a, b = CatalogStore(spark, str(tmp_path / "s")), CatalogStore(spark, str(tmp_path / "s"))
    a.rows(), b.rows()
    a.commit(one)
    with pytest.raises(BlockingIOError):
        b.commit(one.limit(0))
    a.commit(one)
    assert sources.open_catalog(spark, str(tmp_path / "s")).rows().count() == 1


def test_hashing_is_committed_in_slices(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "t", {f"f{i}": f"{i % 3}" for i in range(12)})
    commits = []
    real = CatalogStore.commit
    monkeypatch.setattr(CatalogStore, "commit", lambda self, r, *x: (commits.append(r.filter("sha512 is not null").count()), real(self, r, *x))[1])
    done = scan(spark, tmp_path / "c", root, commit_every=5, hash_threads=2)
    assert done.hashed == 12 and len(commits) == 4 and commits == sorted(commits) and commits[-1] == 12
    assert len({s for _, s in digests(spark, tmp_path / "c")}) == 3


def test_no_local_folder_on_a_cluster(spark):
    class Session:
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})
        conf = type("F", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_directories_of_many_directories_are_signed_in_a_stream(spark):
    from arkivist.operators import tree as t
    from tests.test_operators import catalog as make

    files = t.file_nodes(make(spark, [("h", "v", f"top/d{i}/f", 1, f"c{i}") for i in range(30)]))
    wide = t.widths(files.select(*t.VOLUME, "path", F.lit(3).alias("level")))
    assert {r.p: r.n for r in wide.filter("p in ('', 'top')").collect()} == {"": 1, "top": 30}
    assert {tuple(r) for r in t.dir_signatures(files).collect()} == {tuple(r) for r in t.dir_signatures(files, most_children=20).collect()}
