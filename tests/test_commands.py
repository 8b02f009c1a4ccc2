"""The published behaviours of the four commands, on small trees."""

import json
import os
import sqlite3

import pytest

from arkivist import sources
from arkivist.cli import main
from arkivist.plans import commands as c
from arkivist.sources.jsonl import read_jsonl, sniff, write_jsonl
from arkivist.sources.sqlite_catalog import SqliteCatalog
from arkivist.sources.store import CatalogStore
from arkivist.streaming.hashlog import replay


def tree(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return str(root)


def scan(spark, catalog, root, volume="vol", **more):
    return c.scan_command(spark, str(catalog), volume, str(root), hostname=more.pop("hostname", "here"), quiet=True, **more)


def rows(spark, catalog):
    return sources.open_catalog(spark, str(catalog)).rows().collect()


def plan(spark, catalog, out, **more):
    c.dedupe_command(spark, str(catalog), "json", str(out), **more)
    return json.loads(out.read_text())["duplicate_groups"]


@pytest.fixture(params=["catalog", "catalog.sqlite"])
def catalog(request, tmp_path):
    return tmp_path / request.param


def test_empty_tree(spark, tmp_path, catalog):
    (tmp_path / "t").mkdir()
    scan(spark, catalog, tmp_path / "t")
    store = sources.open_catalog(spark, str(catalog))
    assert rows(spark, catalog) == [] and len(store.volumes()) == 1 and store.facts()["schema_version"] == 1


def test_single_file(spark, tmp_path, catalog):
    scan(spark, catalog, tree(tmp_path / "t", {"only.txt": "x\n"}))
    (r,) = rows(spark, catalog)
    assert (r.path, r.sha512, r.size) == ("only.txt", None, 2)


def test_file_copies(spark, tmp_path, catalog):
    result = scan(spark, catalog, tree(tmp_path / "t", {"a.txt": "hello\n", "sub/a-copy.txt": "hello\n", "b.txt": "something longer\n"}))
    assert (result.files, result.hashed) == (3, 2)
    (g,) = plan(spark, catalog, tmp_path / "p.json")
    assert g["kind"] == "file" and [m["path"] for m in g["members"]] == ["a.txt", "sub/a-copy.txt"]


def test_directory_copies_roll_up(spark, tmp_path):
    files = {f"{top}photos/2024/{n}.jpg": n * k for top in ("", "backup/") for k, n in enumerate("xyz", 1)}
    scan(spark, tmp_path / "c", tree(tmp_path / "t", files))
    (g,) = plan(spark, tmp_path / "c", tmp_path / "p.json")
    assert g["kind"] == "dir" and g["file_count_each"] == 3 and len(g["members"]) == 2
    text = tmp_path / "report.txt"
    c.dedupe_command(spark, str(tmp_path / "c"), "human", str(text), clock=lambda: 0)
    assert "[1] DIR  6 B  (3 files each)  2 copies\n  KEEP-CANDIDATE: here:vol:backup/photos\n  DUPLICATE:      here:vol:photos\n" in text.read_text()


def test_links_and_empty_files_are_skipped(spark, tmp_path):
    root = tree(tmp_path / "t", {"real.txt": "x", "zero": ""})
    os.symlink("real.txt", f"{root}/link")
    os.symlink("nowhere", f"{root}/broken")
    result = scan(spark, tmp_path / "c", root)
    assert (result.files, result.skipped) == (1, 3)


def test_skip_lists(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / "t", {".git/objects/abc": "x", ".Trashes/junk": "x", ".DS_Store": "x", "Thumbs.db": "x", "real/real.txt": "x", "real/.git/y": "x", "real/.localized": "x"}))
    assert [r.path for r in rows(spark, tmp_path / "c")] == ["real/real.txt"]


def test_the_root_itself_is_never_skipped(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / ".git", {"x": "x"}))
    assert len(rows(spark, tmp_path / "c")) == 1


def test_rescan_changes_nothing(spark, tmp_path, catalog):
    root = tree(tmp_path / "t", {"one.txt": "same\n", "one-copy.txt": "same\n", "two.txt": "different\n"})
    scan(spark, catalog, root)
    first = sorted((r.path, r.sha512, r.size) for r in rows(spark, catalog))
    again = scan(spark, catalog, root)
    assert again.hashed == 0 and first == sorted((r.path, r.sha512, r.size) for r in rows(spark, catalog))


def test_prune(spark, tmp_path, catalog):
    root = tree(tmp_path / "t", {f"{n}.txt": "same" for n in ("aaa", "bbb", "ccc")})
    scan(spark, catalog, root)
    plan(spark, catalog, tmp_path / "p.json")
    args = dict(keep_rule="first", interactive=False, hostname="here", quiet=True)
    dry = c.prune_command(spark, str(catalog), str(tmp_path / "p.json"), **args)
    assert (dry.code, dry.planned_files) == (0, 2) and len(os.listdir(root)) == 3 and len(rows(spark, catalog)) == 3
    no = c.prune_command(spark, str(catalog), str(tmp_path / "p.json"), apply=True, confirm=lambda: False, **args)
    assert no.code == 1 and len(os.listdir(root)) == 3
    done = c.prune_command(spark, str(catalog), str(tmp_path / "p.json"), apply=True, yes=True, **args)
    assert (done.code, done.deleted_files, done.deleted_bytes) == (0, 2, 8)
    assert os.listdir(root) == ["aaa.txt"] and [r.path for r in rows(spark, catalog)] == ["aaa.txt"]


def test_prune_guards(spark, tmp_path):
    root = tree(tmp_path / "t", {f"{n}.txt": "same" for n in ("a", "b", "c")})
    scan(spark, tmp_path / "c", root)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    os.remove(f"{root}/b.txt")
    with open(f"{root}/c.txt", "w") as f:
        f.write("grown since")
    done = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), keep_rule="first", interactive=False, hostname="here", apply=True, yes=True, quiet=True)
    assert (done.code, done.deleted_files, done.errors) == (2, 0, 2)
    assert sorted(r.path for r in rows(spark, tmp_path / "c")) == ["a.txt", "c.txt"] and os.path.exists(f"{root}/c.txt")
    other = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), keep_rule="first", interactive=False, hostname="elsewhere", quiet=True)
    assert (other.no_local, other.planned_files) == (1, 0)


def test_prune_of_trees_and_answers(spark, tmp_path):
    root = tree(tmp_path / "t", {f"{top}/{n}": n * 3 for top in ("a/deep", "b/deep") for n in "xy"})
    scan(spark, tmp_path / "c", root)
    plan(spark, tmp_path / "c", tmp_path / "p.json")
    args = dict(hostname="here", quiet=True, apply=True, yes=True)
    skipped = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), chooser=lambda g: None, **args)
    assert skipped.skipped == 1 and skipped.deleted_files == 0
    quit_ = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), chooser=lambda g: "quit", **args)
    assert quit_.deleted_files == 0
    level = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), chooser=lambda g: 1, file_level=True, hostname="here", quiet=True)
    assert level.planned_files == 2
    done = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), chooser=lambda g: 2, **args)
    assert done.deleted_files == 2 and sorted(os.listdir(root)) == ["b"]


def test_prune_refuses_to_lose_the_last_copy(spark, tmp_path):
    root = tree(tmp_path / "t", {"a.txt": "same", "b.txt": "same"})
    scan(spark, tmp_path / "c", root)
    (g,) = plan(spark, tmp_path / "c", tmp_path / "p.json")
    second = dict(g, sig="other", members=g["members"][::-1])
    (tmp_path / "p.json").write_text(json.dumps({"tool": "dedupe", "version": 1, "duplicate_groups": [g, second]}))
    done = c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), keep_rule="first", interactive=False, hostname="here", apply=True, yes=True, quiet=True)
    assert done.code == 2 and done.lost and len(os.listdir(root)) == 2


def test_a_plan_must_be_a_plan(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / "t", {"a": "x"}))
    (tmp_path / "p.json").write_text("{}")
    with pytest.raises(ValueError):
        c.prune_command(spark, str(tmp_path / "c"), str(tmp_path / "p.json"), quiet=True)


def digests(spark, path):
    return sorted((r.path, r.sha512) for r in rows(spark, path))


@pytest.mark.parametrize("last", ["back", "back.sqlite"])
def test_json_lines_round_trip(spark, tmp_path, last):
    scan(spark, tmp_path / "c", tree(tmp_path / "t", {"a.txt": "same", "b.txt": "same", "c.txt": "other one"}))
    c.merge_command(spark, str(tmp_path / "x.jsonl"), [str(tmp_path / "c")], quiet=True)
    c.merge_command(spark, str(tmp_path / last), [str(tmp_path / "x.jsonl")], quiet=True)
    assert digests(spark, tmp_path / last) == digests(spark, tmp_path / "c")
    with pytest.raises(FileExistsError):
        c.merge_command(spark, str(tmp_path / last), [str(tmp_path / "x.jsonl")], quiet=True)
    again = c.merge_command(spark, str(tmp_path / last), [str(tmp_path / "x.jsonl")], mode="append", quiet=True)
    assert again["conflicts"] == 3 and digests(spark, tmp_path / last) == digests(spark, tmp_path / "c")


def test_hash_log_replay(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / "t", {"a.txt": "same", "b.txt": "same", "c.txt": "other one"}), now=100)
    log = f"{tmp_path}/c.hashlog.jsonl"
    assert read_jsonl(spark, log).count() >= 3
    c.merge_command(spark, str(tmp_path / "r"), [log], quiet=True)
    assert digests(spark, tmp_path / "r") == digests(spark, tmp_path / "c")
    store = CatalogStore(spark, str(tmp_path / "s")).create(now=1)
    replay(spark, log, store, str(tmp_path / "cp"), 1)
    assert digests(spark, tmp_path / "s") == digests(spark, tmp_path / "c")


def test_collisions_across_volumes(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / "a", {"x.txt": "abc"}), "volA")
    scan(spark, tmp_path / "c", tree(tmp_path / "b", {"y.txt": "xyz"}), "volB")
    assert all(r.sha512 for r in rows(spark, tmp_path / "c")) and plan(spark, tmp_path / "c", tmp_path / "p.json") == []


def test_other_hosts_files_are_not_read(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / "a", {"x.txt": "abc"}), "volA", hostname="far")
    scan(spark, tmp_path / "c", tree(tmp_path / "b", {"y.txt": "xyz"}), "volB")
    assert {r.path: bool(r.sha512) for r in rows(spark, tmp_path / "c")} == {"x.txt": False, "y.txt": True}


def test_bad_arguments(spark, tmp_path, capsys):
    for argv in (["scan"], ["scan", "--catalog", "x"], ["dedupe"], ["prune", "--catalog", "x"], ["merge", "--output", "x"], ["nonsense"], ["dedupe", "--catalog", str(tmp_path / "none")], ["dedupe", "stray", "--catalog", "x"]):
        assert main(argv, spark) == 2
    assert main([], spark) == 0 and main(["--help"], spark) == 0
    assert os.listdir(tmp_path) == []


def test_odd_names(spark, tmp_path, catalog):
    names = ["with space.txt", "é.txt", "-dash.txt", "quote'\"$x.txt"]
    scan(spark, catalog, tree(tmp_path / "t", {n: f"{i}" * (i + 1) for i, n in enumerate(names)}))
    assert sorted(r.path for r in rows(spark, catalog)) == sorted(names)


def test_foreign_catalog_file(spark, tmp_path):
    """A file another program wrote in the same layout."""
    con = sqlite3.connect(tmp_path / "other.sqlite")
    con.executescript("""
        CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT); INSERT INTO meta VALUES ('schema_version', '1');
        CREATE TABLE volumes (volume_id INTEGER PRIMARY KEY, hostname TEXT, volume TEXT, mount_point TEXT, os TEXT, scanned_at INTEGER);
        CREATE TABLE files (file_id INTEGER PRIMARY KEY, volume_id INTEGER, path TEXT, path_norm TEXT, size INTEGER, mtime INTEGER, sha512 TEXT, scanned_at INTEGER);
        INSERT INTO volumes VALUES (1, 'h', 'v', '/m', 'linux', 1);
        INSERT INTO files VALUES (1, 1, 'A', 'A', 3, 1, 'aa', 1), (2, 1, 'B', 'B', 3, 1, 'aa', 1), (3, 1, 'C', 'C', 3, 1, '', 1);
    """)
    con.commit()
    con.close()
    (g,) = plan(spark, tmp_path / "other.sqlite", tmp_path / "p.json")
    assert [m["path"] for m in g["members"]] == ["A", "B"]
    os.rename(tmp_path / "other.sqlite", tmp_path / "plainname")
    assert sniff(spark, str(tmp_path / "plainname")) == "sqlite"


def test_walks_are_shared_out(tmp_path):
    from arkivist.sources.fswalk import WalkReader

    names = {f"one/{a}/{b}/{c}": "x" for a in "abc" for b in "de" for c in "fgh"} | {"top": "x", "one/.git/y": "x", "one/a/.DS_Store": "x"}
    reader = WalkReader({"root": tree(tmp_path / "t", names), "partitions": "4"})
    parts = reader.partitions()
    rows_ = [r for p in parts for r in reader.read(p)]
    assert sorted(r[0] for r in rows_ if r[3] == "file") == sorted(n for n in names if ".git" not in n and ".DS" not in n)
    assert sorted(r[0] for r in rows_ if r[3] == "skipped") == ["one/.git", "one/a/.DS_Store"]
    assert len(parts) == 4 and max(sum(1 for _ in reader.read(p)) for p in parts) < 10


def test_meta(spark, tmp_path, catalog):
    store = sources.open_catalog(spark, str(catalog)).create("d", 5)
    store.meta_put("dataset_name", "e")
    assert store.meta_get("dataset_name") == "e" == store.facts()["dataset_name"] and store.meta_get("none") is None


def test_full_hash(spark, tmp_path):
    result = scan(spark, tmp_path / "c", tree(tmp_path / "t", {"a": "1", "b": "22", "c": "333"}), full_hash=True)
    assert result.hashed == 3 and all(r.sha512 for r in rows(spark, tmp_path / "c"))


def test_worklist_and_rehash(spark, tmp_path):
    scan(spark, tmp_path / "c", tree(tmp_path / "a", {"x.txt": "abc", "u.txt": "unique"}), "volA", hostname="far")
    scan(spark, tmp_path / "d", tree(tmp_path / "b", {"y.txt": "xyz"}), "volB")
    c.merge_command(spark, str(tmp_path / "m"), [str(tmp_path / "c"), str(tmp_path / "d")], rehash_list=str(tmp_path / "w.jsonl"), quiet=True)
    assert sorted((r.hostname, r.path) for r in read_jsonl(spark, str(tmp_path / "w.jsonl")).collect()) == [("far", "x.txt"), ("here", "y.txt")]
    listed = scan(spark, tmp_path / "c", tmp_path / "a", "volA", hostname="far", rehash_list=str(tmp_path / "w.jsonl"))
    assert listed.hashed == 1
    every = scan(spark, tmp_path / "c", tmp_path / "a", "volA", hostname="far", rehash=True)
    assert every.hashed == 1 and all(r.sha512 for r in rows(spark, tmp_path / "c"))
    with pytest.raises(c.UsageError):
        scan(spark, tmp_path / "c", tmp_path / "a", "none", rehash=True)


def test_changed_files_keep_or_lose_their_digest(spark, tmp_path):
    for mode in ("keep", "invalidate"):
        root = tree(tmp_path / mode, {"a.txt": "same", "b.txt": "same"})
        cat = tmp_path / f"c-{mode}"
        scan(spark, cat, root)
        tree(root, {"a.txt": "now longer"})
        scan(spark, cat, root, stale_hash=mode)
        assert bool({r.path: r.sha512 for r in rows(spark, cat)}["a.txt"]) == (mode == "keep")


def test_malformed_lines(spark, tmp_path):
    good = '{"hostname":"h","volume":"v","path":"A//b","os":"darwin"}'
    (tmp_path / "x.jsonl").write_text(f"{good}\n\nnot json\n")
    with pytest.raises(Exception, match="malformed"):
        c.merge_command(spark, str(tmp_path / "o"), [str(tmp_path / "x.jsonl")], quiet=True)
    c.merge_command(spark, str(tmp_path / "l"), [str(tmp_path / "x.jsonl")], lenient=True, quiet=True, now=7)
    (r,) = rows(spark, tmp_path / "l")
    assert (r.path_norm, r.size, r.mtime, r.scanned_at) == ("a/b", 0, 0, 7)


def test_versions_are_checked(spark, tmp_path):
    SqliteCatalog(spark, str(tmp_path / "a.sqlite")).create(now=1)
    con = sqlite3.connect(tmp_path / "a.sqlite")
    con.execute("UPDATE meta SET value = '9' WHERE key = 'schema_version'")
    con.commit()
    con.close()
    with pytest.raises(ValueError):
        SqliteCatalog(spark, str(tmp_path / "a.sqlite")).facts()
    with pytest.raises(FileNotFoundError):
        CatalogStore(spark, str(tmp_path / "none")).rows()


def test_store_keeps_nothing_half_done(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "s")).create("d", 5)
    rows_ = read_jsonl(spark, write(spark, tmp_path))
    store.commit(rows_)
    os.makedirs(tmp_path / "s" / "v=2")  # left by a commit that broke off
    assert store.rows().count() == 2
    store.commit(rows_.limit(1))
    assert store.rows().count() == 1 and store.facts()["dataset_name"] == "d"


def write(spark, tmp_path):
    frame = spark.createDataFrame([("h", "v", "a", "a", 1, 1, 1), ("h", "v", "b", "b", 1, 1, 1)], "hostname string, volume string, path string, path_norm string, size long, mtime long, scanned_at long")
    write_jsonl(frame, str(tmp_path / "rows"))
    return str(tmp_path / "rows")
