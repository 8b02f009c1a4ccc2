import hashlib
import random

import pytest

from arkivist.operators import collisions, merge, prune, scan, tree
from arkivist.operators.common import catalog_rows
from arkivist.schema import CATALOG, CATALOG_COLUMNS


def catalog(spark, rows):
    """(hostname, volume, path, size, content or None) as a catalog."""
    full = []
    for h, v, p, size, content in rows:
        r = {"hostname": h, "mount_point": f"/m/{v}", "mtime": 1, "os": "linux", "path": p, "path_norm": p, "scanned_at": 1, "sha512": content and hashlib.sha512(content.encode()).hexdigest(), "size": size, "volume": v}
        full.append(tuple(r[c] for c in CATALOG_COLUMNS))
    return spark.createDataFrame(full, CATALOG)


def fold(arrivals):
    """The merge rule, a row at a time."""
    state = {}
    counts = [0, 0, 0]
    for key, scanned, sha, size, seq in arrivals:
        counts[0] += 1
        if key not in state:
            state[key] = [size, sha, scanned]
            continue
        s = state[key]
        counts[1] += 1
        counts[2] += s[1] is not None and sha is not None and s[1] != sha
        newer = scanned >= s[2]
        if newer:
            s[0] = size
        if (newer and sha is not None) or s[1] is None:
            s[1] = sha
        s[2] = max(s[2], scanned)
    return state, counts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_fold_is_the_row_by_row_rule(spark, seed):
    rnd = random.Random(seed)
    arrivals = [(f"p{rnd.randrange(60)}", rnd.randrange(5), rnd.choice([None, "x", "y", "z"]), rnd.randrange(9), i) for i in range(600)]
    rows = spark.createDataFrame([("h", "v", k, k, size, i, sha, t, None, None, i) for k, t, sha, size, i in arrivals], "hostname string, volume string, path_norm string, path string, size long, mtime long, sha512 string, scanned_at long, mount_point string, os string, seq long")
    state, counts = fold(arrivals)
    got = {r.path_norm: [r.size, r.sha512, r.scanned_at] for r in merge.merge_fold(rows).collect()}
    assert got == state
    assert list(merge.merge_counters(rows).first()) == counts


def greedy(nodes):
    """Coverage one group after another.  nodes: (host, vol, path, kind, sig, size, n), in the order of a walk."""
    groups = {}
    for n in nodes:
        if not n[4].startswith(("U:", "X:")):
            groups.setdefault(n[4], []).append(n)
    groups = [g for g in groups.values() if len(g) > 1]
    groups.sort(key=lambda g: (0 if g[0][2] == "" else g[0][2].count("/") + 1, -g[0][5]))
    covered_dirs, out = set(), {}
    for g in groups:
        flags = []
        for h, v, p, *_ in g:
            parts = p.split("/") if p else []
            flags.append(any((h, v, "/".join(parts[:i])) in covered_dirs for i in range(len(parts))))
        if all(flags):
            continue
        out[g[0][4]] = [(m[0], m[1], m[2], f) for m, f in zip(g, flags)]
        covered_dirs |= {m[:3] for m in g if m[3] == "dir"}
    return out


def walk_nodes(rows):
    """Signatures by recursion."""
    out = []
    for h, v in sorted({r[:2] for r in rows}):
        own = {r[2]: r for r in rows if r[:2] == (h, v)}

        def visit(top):
            pre = top + "/" if top else ""
            names = sorted({p[len(pre) :].split("/")[0] for p in own if p.startswith(pre)})
            children, size, n = [], 0, 0
            for name in names:
                if pre + name in own:
                    r = own[pre + name]
                    sig = "F:" + hashlib.sha512(r[4].encode()).hexdigest() if r[4] else f"X:{h}:{v}:{r[2]}"
                    out.append((h, v, r[2], "file", sig, r[3], 1))
                    children.append((name, 0, sig))
                    size, n = size + r[3], n + 1
            for name in names:
                if any(p.startswith(pre + name + "/") for p in own):
                    sig, s, k = visit(pre + name)
                    children.append((name, 1, sig))
                    size, n = size + s, n + k
            sig = "D:" + hashlib.sha512("".join(f"{a}\0{c}\0" for a, _, c in sorted(children)).encode()).hexdigest()
            out.append((h, v, top, "dir", sig, size, n))
            return sig, size, n

        visit("")
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_coverage_is_the_greedy_rule(spark, seed):
    rnd = random.Random(seed)
    found = {}
    for _ in range(140):
        h, v = rnd.choice("gh"), rnd.choice("vw")
        path = "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) + f"/f{rnd.randrange(2)}"
        c = rnd.choice(["x", "yy", "yz", "zzz"])
        found[h, v, path.strip("/")] = (len(c), c if rnd.random() > 0.03 else None)
    rows = [(*k, *x) for k, x in found.items()]
    nodes = walk_nodes(rows)
    want = greedy(nodes)
    all_nodes = tree.nodes(catalog(spark, rows))
    got_nodes = {(r.hostname, r.volume, r.path, r.kind): (r.sig if r.sig[0] != "U" else "X" + r.sig[1:], r.size, r.n_files) for r in all_nodes.collect()}
    assert {k: v for k, v in got_nodes.items() if k[3] == "file"} == {n[:4]: n[4:] for n in nodes if n[3] == "file"}
    hashed = {n[:4]: n[4:] for n in nodes if n[3] == "dir"}
    assert {k: v[1:] for k, v in got_nodes.items() if k[3] == "dir"} == {k: v[1:] for k, v in hashed.items()}
    got = {}
    for r in tree.coverage_report(all_nodes).orderBy("sig", "member_idx").collect():
        got.setdefault(r.sig, []).append((r.hostname, r.volume, r.path, r.covered_by_ancestor))
    assert got == want


def test_wide_directories_are_signed_in_a_stream(spark):
    rows = [("h", "v", f"d{i % 2}/f{i:03}" if i % 3 else f"d{i % 2}/s/f{i}", 3, f"c{i // 2}") for i in range(200)]
    files = tree.file_nodes(catalog(spark, rows))
    a = {(r.path, r.sig) for r in tree.dir_signatures(files).collect()}
    b = {(r.path, r.sig) for r in tree.dir_signatures(files, most_children=10).collect()}
    assert a == b and len(a) == 5


def test_a_file_and_a_directory_of_one_name(spark):
    rows = [("h", "v", "a", 1, "x"), ("h", "v", "a/b", 1, "y")]
    want = {n[2]: n[4] for n in walk_nodes(rows) if n[3] == "dir"}
    assert {r.path: r.sig for r in tree.dir_signatures(tree.file_nodes(catalog(spark, rows))).collect()} == want


def test_min_size_counts_for_files_only(spark):
    rows = [("h", "v", "a/x", 2, "xx"), ("h", "v", "b/x", 2, "xx")]
    groups = tree.duplicate_groups(tree.nodes(catalog(spark, rows)), min_size=3).collect()
    assert [g.kind for g in groups] == ["dir"]


def test_collisions_and_worklist(spark):
    rows = catalog(spark, [("h", "v", "a", 5, None), ("h", "w", "b", 5, "bbbbb"), ("h", "v", "c", 6, None), ("g", "v", "d", 5, None)])
    assert {r.path for r in collisions.pending(rows).collect()} == {"a", "d"}
    assert [(r.hostname, r.path) for r in collisions.rehash_worklist(rows).collect()] == [("g", "d"), ("h", "a")]
    w = collisions.missing_hash_warning(rows).first()
    assert (w.n_missing, w.examples) == (2, "g:v:d,h:v:a")
    none = collisions.missing_hash_warning(rows.filter("size = 6")).first()
    assert (none.n_missing, none.examples) == (0, "")


def test_scan_decisions(spark):
    old = catalog(spark, [("h", "v", "same", 3, "abc"), ("h", "v", "grown", 3, "abc"), ("h", "v", "gone", 3, "abc")])
    walk = catalog(spark, [("h", "v", "same", 3, None), ("h", "v", "grown", 4, None), ("h", "v", "new", 5, None)])
    quick = {r.path: (r.sha512 is not None, r.unchanged, r.needs_hash) for r in scan.decide(walk, old).collect()}
    assert quick == {"same": (True, True, False), "grown": (False, False, False), "new": (False, False, False)}
    full = {r.path: r.needs_hash for r in scan.decide(walk, old, full_hash=True).collect()}
    assert full == {"same": False, "grown": True, "new": True}
    kept = {r.path: (r.size, r.sha512 is not None) for r in merge.upsert(old, scan.decide(walk, old).select(*CATALOG_COLUMNS)).collect()}
    assert kept == {"same": (3, True), "grown": (4, True), "new": (5, False), "gone": (3, True)}
    clean = scan.invalidate_stale(scan.decide(walk, old), old)
    kept = {r.path: (r.size, r.sha512 is not None) for r in merge.upsert(clean, scan.decide(walk, old).select(*CATALOG_COLUMNS)).collect()}
    assert kept["grown"] == (4, False) and kept["gone"] == (3, True)


def members(spark):
    rows = [
        ("s1", "file", 5, 1, 1, "h1", "v1", "long/path/a"), ("s1", "file", 5, 1, 2, "h2", "v1", "b"), ("s1", "file", 5, 1, 3, "h1", "v2", "c"),
        ("s2", "dir", 9, 2, 1, "h2", "v1", "d"), ("s2", "dir", 9, 2, 2, "h2", "v2", "e"),
        ("s3", "file", 1, 1, 1, "h3", "v1", "x"), ("s3", "file", 1, 1, 2, "h3", "v9", "y"),
    ]
    return spark.createDataFrame(rows, "sig string, kind string, size_each long, file_count_each long, member_idx long, hostname string, volume string, path string")


@pytest.mark.parametrize(
    "rule, keep",
    [
        ("first", {"s1": 1, "s2": 1, "s3": 1}),
        ("host=h2", {"s1": 2}),
        ("host=h1", {}),
        ("volume=v2", {"s1": 3, "s2": 2}),
        ("volume=v9", {"s3": 2}),
        ("shortest-path", {"s1": 2, "s2": 1, "s3": 1}),
        ("nonsense", {}),
    ],
)
def test_keep_rules(spark, rule, keep):
    assert {r.sig: r.keep_idx for r in prune.keepers(members(spark), rule).collect()} == keep


def test_only_local_members_go(spark):
    got = {(r.sig, r.member_idx, r.keep.path) for r in prune.plan_deletions(members(spark), "first", "h1").collect()}
    assert got == {("s1", 3, "long/path/a")}
    states = {r.sig: r.state for r in prune.group_states(members(spark), "host=h2", "h1").collect()}
    assert states == {"s1": "planned", "s2": "no_local", "s3": "no_local"}


def test_subtrees_know_no_wildcards(spark):
    rows = catalog(spark, [("h", "v", "a_b/x", 1, "1"), ("h", "v", "aXb/x", 1, "2"), ("h", "v", "A_B/x", 1, "3"), ("h", "v", "a_b", 7, "4")])
    tops = spark.createDataFrame([("h", "v", "a_b"), ("h", "v", ""), ("h", "v", "none")], "hostname string, volume string, path string")
    got = {r.path: (r.n_files, r.bytes) for r in prune.subtree_info(rows, tops).collect()}
    assert got == {"a_b": (2, 8), "": (4, 10), "none": (0, 0)}


def test_file_level_needs_the_same_content(spark):
    rows = catalog(spark, [("h", "v", "a/x", 1, "1"), ("h", "v", "a/y", 1, "2"), ("h", "v", "b/x", 1, "1"), ("h", "v", "b/y", 1, "9"), ("h", "v", "b/z", 1, "3")])
    m = spark.createDataFrame([("s", "dir", 2, 2, 1, "h", "v", "a"), ("s", "dir", 2, 2, 2, "h", "v", "b")], members(spark).schema)
    plan = prune.plan_deletions(m, "first", "h")
    assert {(r.path_norm, r.keep_path) for r in prune.expand_dirs(plan, rows).collect()} == {("b/x", "a/x")}
    assert {r.path_norm for r in prune.expand_dirs(plan, rows, same_content=False).collect()} == {"b/x", "b/y"}
    lost = {r.sha512: r.survives for r in prune.survivor_check(plan, rows).collect()}
    assert lost[hashlib.sha512(b"1").hexdigest()] and not lost[hashlib.sha512(b"9").hexdigest()]


def test_empty_digests_are_none(spark):
    r = catalog_rows(spark.createDataFrame([("h", "v", "p", "")], "hostname string, volume string, path string, sha512 string")).first()
    assert r.sha512 is None and r.size is None


def test_empty_catalog(spark):
    none = spark.createDataFrame([], CATALOG)
    assert tree.coverage_report(tree.nodes(none)).count() == 0
    assert merge.merge_counters(merge.union_inputs([none])).first().asDict() == {"total": 0, "conflicts": 0, "hash_disagreements": 0}
