"""The four commands: scan, dedupe, prune, merge.  What touches files is here; the rest is operators."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkivist import sources
from arkivist.functions.formats import bytes_text, duration_text, eta_text
from arkivist.functions.paths import ancestors, default_hostname, key_str, normalize_path, os_name, parts
from arkivist.operators import collisions, hashing, merge, prune, scan, tree
from arkivist.operators.common import forget, scratch, written
from arkivist.plans import report
from arkivist.schema import CATALOG_COLUMNS, KEY
from arkivist.ship import ship
from arkivist.sources.jsonl import log_lines, read_worklist, to_lines, tombstones, write_lines
from arkivist.sources.sqlite_catalog import write_catalog


class UsageError(ValueError):
    """Wrong or missing arguments."""


def _say(quiet: bool, text: str) -> None:
    if not quiet:
        sys.stderr.write(text + "\n")


@dataclass
class ScanResult:
    files: int = 0
    hashed: int = 0
    skipped: int = 0
    errors: int = 0
    unreachable: int = 0


def _walk(spark: SparkSession, root: str, hostname: str, volume: str, mount: str, now: int) -> DataFrame:
    sources.register(spark)
    found = spark.read.format("fswalk").option("root", root).load()
    return written(
        found.select(
            F.lit(hostname).alias("hostname"), F.lit(mount).alias("mount_point"), "mtime", F.lit(os_name()).alias("os"), "path",
            normalize_path("path", F.lit(os_name())).alias("path_norm"), F.lit(now).cast("long").alias("scanned_at"), "size", F.lit(volume).alias("volume"), "status",
        ),
        "walk",
    )


def scan_command(
    spark: SparkSession, catalog: str, volume: str, root: str, hostname: str | None = None, mount_point: str | None = None, full_hash: bool = False,
    rehash: bool = False, rehash_list: str | None = None, dataset: str | None = None, hashlog: str | None = None, no_hashlog: bool = False,
    stale_hash: str = "keep", any_host: bool = False, quiet: bool = False, now: int | None = None,
    progress_every: int | None = None, commit_every: int | None = None, hash_threads: int | None = None,
) -> ScanResult:
    """Walks a tree into a catalog, then hashes what can have a copy.

    The walk is committed first.  Files are hashed in slices (see _hash); each is logged and
    committed when it ends, so a scan that breaks off loses a slice at most, and the next one
    goes on from there.  stale_hash='keep' leaves the digest of a changed file until it is hashed
    anew, 'invalidate' takes it out.  Files of other hosts are only read with any_host.
    """
    if not (catalog and volume and root):
        raise UsageError("scan needs --catalog, --volume and --root")
    if not os.path.isdir(root):
        raise UsageError(f"not a directory: {root}")
    if stale_hash not in ("keep", "invalidate"):
        raise UsageError(f"unknown stale_hash: {stale_hash}")
    started = time.time()
    now = int(started) if now is None else now
    root = os.path.abspath(root)
    hostname = hostname or default_hostname()
    store = sources.open_catalog(spark, catalog)

    def log(rows: DataFrame) -> None:
        if not no_hashlog:
            store.log(rows.select(*CATALOG_COLUMNS), hashlog)

    how = Hashing(log, quiet, commit_every, progress_every, hash_threads)
    with scratch():
        if rehash or rehash_list:
            return _rehash(spark, store, volume, root, hostname, mount_point, rehash_list, how)
        store.open_or_create(dataset, now)
        store.upsert_volume(hostname, volume, mount_point or root, os_name(), now)
        walk = _walk(spark, root, hostname, volume, mount_point or root, now)
        states = {r.status: r.n for r in walk.groupBy("status").agg(F.count("*").alias("n")).collect()}
        result = ScanResult(states.get("file", 0), 0, states.get("skipped", 0), states.get("error", 0))
        _say(quiet, f"[scan] walked: {result.files} files, {result.skipped} left out, {result.errors} unreadable")
        files = walk.filter("status = 'file'").drop("status")
        # names that differ in case only are one file on some systems
        rest = [c for c in files.columns if c not in KEY]
        files = files.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "path").alias("r")).select(*KEY, "r.*")
        old = store.rows()
        decided = written(scan.decide(files, old, full_hash), "decided")
        log(decided)
        if stale_hash == "invalidate":
            old = scan.invalidate_stale(decided, old)
        rows = written(merge.upsert(old, decided.select(*CATALOG_COLUMNS)), "upserted")
        store.commit(rows)
        if full_hash:
            todo = decided.filter("needs_hash")
        else:
            todo = collisions.pending(rows)
            if not any_host:
                todo = todo.filter(F.col("hostname") == hostname)
        counts = _hash(store, rows, todo, how, now, root if full_hash else None)
        result.hashed, result.unreachable = counts.get("hashed", 0), counts.get("unreachable", 0)
        result.errors += counts.get("error", 0)
        if full_hash:
            result.errors, result.unreachable = result.errors + result.unreachable, 0
        _say(quiet, f"[scan] {result.files} files, {result.hashed} of them hashed now, {result.unreachable} out of reach, in {duration_text(time.time() - started)}")
    return result


@dataclass
class Hashing:
    """How files are hashed: where digests are logged, files of a slice, files between two lines of progress, tasks."""

    log: Callable[[DataFrame], None]
    quiet: bool = False
    commit_every: int | None = None
    progress_every: int | None = None
    threads: int | None = None


#: Bytes of files in a slice, unless commit_every says how many files.
SLICE_BYTES = 256 << 30


def _hash(store, rows: DataFrame, todo: DataFrame, how: Hashing, now: int | None, root: str | None = None) -> dict[str, int]:
    """Hashes the todo rows in slices of SLICE_BYTES, or of commit_every files; logs and commits each when it ends.

    rows is the catalog's content.  A slice is chosen by a hash of the key, so slices are near
    equal.  Returns the numbers of files by hash_status.
    """
    spark = rows.sparkSession
    columns = [c for c in CATALOG_COLUMNS if c != "sha512"]
    todo = written(todo.select(*columns), "to-hash")
    total = todo.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    slices = max(1, -(-total.n // how.commit_every) if how.commit_every else -(-total.b // SLICE_BYTES))
    _say(how.quiet, f"[scan] to hash: {total.n} files, {bytes_text(total.b)}, in {slices} slices")
    counts: dict[str, int] = {}
    started, said = time.time(), 0
    for i in range(slices if total.n else 0):
        own = todo.filter(F.pmod(F.xxhash64(*KEY), F.lit(slices)) == i)
        # files differ in size: more tasks than cores even them out
        own = own.repartition(how.threads or 4 * spark.sparkContext.defaultParallelism)
        read = written(hashing.hash_files(own, root=root), "hashed")
        for status, n in _counts(read).items():
            counts[status] = counts.get(status, 0) + n
        found = read.filter(F.col("sha512").isNotNull())
        if now is not None:
            found = found.withColumn("scanned_at", F.lit(now).cast("long"))
        how.log(found)
        before, rows = rows, written(merge.set_digests(rows, found), "catalog")
        store.commit(rows)
        forget(before)
        forget(read)
        done = sum(counts.values())
        if done - said >= (how.progress_every or 1):
            said = done
            _say(how.quiet, "[scan] " + eta_text("hashed", done, total.n, started))
    return counts


def _counts(read: DataFrame) -> dict[str, int]:
    return {r.hash_status: r.n for r in read.groupBy("hash_status").agg(F.count("*").alias("n")).collect()}


def _rehash(spark, store, volume, root, hostname, mount_point, rehash_list, how: Hashing) -> ScanResult:
    known = {(v["hostname"], v["volume"]): v for v in store.volumes()}
    if (hostname, volume) not in known:
        raise UsageError(f"volume not in catalog: {hostname}:{volume}")
    v = known[hostname, volume]
    if mount_point and v["mount_point"] != mount_point:
        store.upsert_volume(hostname, volume, mount_point, v["os"], v["scanned_at"])
    rows = written(store.rows(), "rows")
    own = rows.filter((F.col("hostname") == hostname) & (F.col("volume") == volume) & F.col("sha512").isNull())
    if rehash_list:
        own = scan.worklist_rows(own, read_worklist(spark, rehash_list), hostname, volume)
    counts = _hash(store, rows, own, how, None, root)
    hashed = counts.get("hashed", 0)
    return ScanResult(0, hashed, 0, sum(counts.values()) - hashed)


def dedupe_command(spark: SparkSession, catalog: str, format: str = "human", output: str | None = None, min_size: int = 0, bits: int = 512, clock=time.time) -> DataFrame:
    """Writes the report of duplicate files and trees; returns its members."""
    if not catalog:
        raise UsageError("dedupe needs --catalog")
    if format not in ("human", "json"):
        raise UsageError(f"unknown format: {format}")
    store = sources.open_catalog(spark, catalog)
    facts, rows = store.facts(), store.rows()
    with scratch() as keep:
        members = written(tree.coverage_report(tree.nodes(rows, bits), min_size), "report")
        keep.append(members)
    missing = collisions.missing_hash_warning(rows).first()
    warnings = []
    if missing.n_missing:
        warnings.append(f"{missing.n_missing} files share their size with another one but have no digest yet (run scan); e.g. {missing.examples}")
    text = report.human_report if format == "human" else report.json_plan
    lines = text(members, catalog, facts.get("dataset_name"), warnings, clock)
    out = open(output, "w", encoding="utf-8") if output else sys.stdout
    try:
        for line in lines:
            out.write(line + ("\n" if format == "human" else ""))
    finally:
        if output:
            out.close()
    return members


@dataclass
class PruneResult:
    code: int = 0
    planned_files: int = 0
    planned_bytes: int = 0
    deleted_files: int = 0
    deleted_bytes: int = 0
    errors: int = 0
    skipped: int = 0
    no_local: int = 0
    lost: list[str] = field(default_factory=list)
    stale: list[str] = field(default_factory=list)


#: Given a group's members (as rows): the place of the one to keep, None to skip, or "quit".
Chooser = Callable[[list], "int | str | None"]


def ask(members: list) -> int | str | None:
    """Asks at the terminal."""
    g = members[0]
    files = f" ({g.file_count_each} files each)" if g.kind == "dir" else ""
    sys.stderr.write(f"\n{g.kind} of {bytes_text(g.size_each)}{files}, {len(members)} copies:\n")
    for m in members:
        sys.stderr.write(f"  {m.member_idx}. {m.key}{' [covered]' if m.covered_by_ancestor else ''}\n")
    sys.stderr.write("Number of the one to keep (a: all, s: skip, q: quit): ")
    sys.stderr.flush()
    answer = (sys.stdin.readline() or "").strip()
    if answer == "q":
        return "quit"
    return int(answer) if answer.isdigit() and 1 <= int(answer) <= len(members) else None


def _asked(spark: SparkSession, members: DataFrame, chooser: Chooser) -> DataFrame:
    """sig, keep_idx by asking, a group at a time."""
    chosen, group = [], []

    def settle() -> bool:
        answer = chooser(group) if group else None
        if isinstance(answer, int) and not isinstance(answer, bool):
            chosen.append((group[0].sig, answer))
        return answer != "quit"

    go_on = True
    for m in members.orderBy("group_idx", "member_idx").toLocalIterator():
        if group and m.group_idx != group[0].group_idx:
            go_on, group = settle(), []
            if not go_on:
                break
        group.append(m)
    if go_on:
        settle()
    return spark.createDataFrame(chosen, "sig string, keep_idx long")


def _deletions(members: DataFrame, keep: DataFrame, hostname: str) -> DataFrame:
    j = members.join(keep, "sig")
    kept = j.filter("member_idx = keep_idx").select("sig", F.struct("hostname", "volume", "path").alias("keep"))
    gone = j.filter((F.col("member_idx") != F.col("keep_idx")) & (F.col("hostname") == hostname)).drop("keep_idx")
    return gone.join(kept, "sig").select("sig", "kind", "size_each", "file_count_each", "member_idx", "hostname", "volume", "path", "keep")


def prune_command(
    spark: SparkSession, catalog: str, plan: str, apply: bool = False, keep_rule: str | None = None, interactive: bool = True, hostname: str | None = None,
    file_level: bool = False, yes: bool = False, chooser: Chooser = ask, confirm: Callable[[], bool] | None = None, quiet: bool = False, verify: bool = True,
) -> PruneResult:
    """Deletes what a plan and a rule (or answers) say; shows it only, unless apply.

    Files are found by host, volume and path, never by a catalog's own numbers.  Nothing at all
    is deleted, with result code 2, if
    * the catalog has another size or digest (for directories: another signature) than the plan
      for something that is to go, or for something that is to stay in its place;
    * the last copy of a digest would go, or a file without one;
    * with verify, a file that is to stay on this host does not have its catalogued content.
    A file that is to go is left alone if its size, or with verify its content, is not the
    catalogued one.  verify reads those files; without it a catalog whose digests are stale (kept
    from before a change of equal size) is believed.
    """
    with scratch():
        return _prune(spark, catalog, plan, apply, keep_rule, interactive, hostname, file_level, yes, chooser, confirm, quiet, verify)


def _prune(spark, catalog, plan, apply, keep_rule, interactive, hostname, file_level, yes, chooser, confirm, quiet, verify) -> PruneResult:
    if not (catalog and plan):
        raise UsageError("prune needs --catalog and --plan")
    hostname = hostname or default_hostname()
    store = sources.open_catalog(spark, catalog)
    rows = store.rows()
    members = written(report.read_plan(spark, plan), "plan")
    out = PruneResult()
    ruled = prune.keepers(members, keep_rule) if keep_rule else spark.createDataFrame([], "sig string, keep_idx long")
    ruled = written(ruled, "keepers")
    local = members.groupBy("sig").agg(F.max((F.col("hostname") == hostname).cast("int")).alias("local"))
    out.no_local = local.filter("local = 0").count()
    open_ = members.join(local.filter("local = 1").select("sig"), "sig").join(ruled, "sig", "left_anti")
    keep = ruled
    if interactive:
        keep = ruled.unionByName(_asked(spark, open_, chooser))
    keep = written(keep, "kept")
    out.skipped = open_.select("sig").distinct().join(keep, "sig", "left_anti").count()
    deletions = written(_deletions(members, keep, hostname), "deletions")
    stale = _stale(members, keep, rows, hostname)
    if file_level:
        as_files = prune.expand_dirs(deletions, rows)
        as_files = as_files.select(
            "sig", F.lit("file").alias("kind"), F.col("size").alias("size_each"), F.lit(1).cast("long").alias("file_count_each"), F.lit(0).cast("long").alias("member_idx"),
            "hostname", "volume", F.col("path_norm").alias("path"), F.struct(F.col("keep_hostname").alias("hostname"), F.col("keep_volume").alias("volume"), F.col("keep_path").alias("path")).alias("keep"),
        )
        deletions = written(deletions.filter("kind = 'file'").unionByName(as_files), "deletions")
    shown = deletions.select(key_str("keep.hostname", "keep.volume", "keep.path").alias("k"), key_str("hostname", "volume", "path").alias("d"), "size_each", "sig").orderBy("sig", "k", "d")
    last = None
    for r in shown.toLocalIterator():
        if r.k != last:
            _say(quiet, f"  KEEP   {r.k}")
            last = r.k
        _say(quiet, f"  DELETE {r.d}  ({bytes_text(r.size_each)})")
    total = prune.plan_totals(deletions, rows).first()
    out.planned_files, out.planned_bytes = total.n_files, total.bytes
    if last is None:
        _say(quiet, "[prune] no deletion follows from the plan")
        return out
    _say(quiet, f"[prune] total: {total.n_files} files, {bytes_text(total.bytes)}")
    if not apply:
        _say(quiet, "[prune] shown only; with --apply it is done")
        return out
    changed = stale.limit(20).collect()  # a few for the message
    if changed:
        for r in changed:
            _say(quiet, f"[prune] {r.state} in the catalog since the plan was made: {r.key}")
        _say(quiet, "[prune] refused: make a new plan")
        out.code, out.stale = 2, [r.key for r in changed]
        return out
    lost = prune.survivor_check(deletions, rows).filter("not survives").select(F.coalesce("sha512", F.lit("files without a digest")).alias("sha512")).limit(20)
    out.lost = [r.sha512 for r in lost.collect()]
    if out.lost:
        _say(quiet, f"[prune] refused: no copy would survive of {', '.join(out.lost)}")
        out.code = 2
        return out
    if not yes and not (confirm or _confirm)():
        _say(quiet, "[prune] aborted")
        out.code = 1
        return out
    if verify:
        here = prune.kept_files(deletions, rows).filter(F.col("hostname") == hostname)
        asked = here.select(*[c for c in CATALOG_COLUMNS if c != "sha512"], F.col("sha512").alias("expected"))
        broken = hashing.hash_files(asked).filter(F.col("sha512").isNull() | (F.col("sha512") != F.col("expected")))
        broken = broken.select(key_str("hostname", "volume", "path").alias("key")).limit(20).collect()  # a few for the message
        if broken:
            _say(quiet, f"[prune] refused: what should stay is not there as catalogued: {', '.join(r.key for r in broken)}")
            out.code, out.stale = 2, [r.key for r in broken]
            return out
    _delete(spark, store, prune.deleted_files(deletions, rows), deletions, hostname, out, quiet, verify)
    _say(quiet, f"[prune] deleted {out.deleted_files} files of {bytes_text(out.deleted_bytes)}; {out.errors} problems")
    out.code = 2 if out.errors else 0
    return out


def _confirm() -> bool:
    sys.stderr.write("[prune] type 'yes' to delete these: ")
    sys.stderr.flush()
    return sys.stdin.readline().strip() == "yes"


def _stale(members: DataFrame, keep: DataFrame, rows: DataFrame, hostname: str) -> DataFrame:
    """key and state of what the plan counts on but the catalog does not have so: what stays, and what would go and is there."""
    sig = members.filter("kind = 'dir'").select(F.length("sig").alias("n")).limit(1).collect()
    bits = 4 * (sig[0].n - 2) if sig else 512
    own = members.join(keep, "sig")
    stays = F.col("member_idx") == F.col("keep_idx")
    used = own.withColumn("stays", stays).filter(stays | (F.col("hostname") == hostname))
    states = prune.member_states(used, rows, bits)
    return states.filter((F.col("state") == "changed") | (F.col("stays") & (F.col("state") != "current"))).select("key", "state")


def _unlink(rows: DataFrame, mounts: dict, hostname: str, verify: bool) -> DataFrame:
    """Deletes files where the tasks run (their host: prune runs where the files are); one row for each
    with what became of it.  A task that runs again finds its files gone already."""
    columns = [*KEY, "path", "size", "sha512"]

    def step(mount: str | None, host: str, path: str, size: int, sha: str | None) -> str:
        if host != hostname or not mount:
            return "foreign"
        full = hashing.place(mount, path)
        if not os.path.isfile(full):
            return "missing"
        try:
            if os.stat(full).st_size != size:
                return "size"
            if verify and (sha is None or hashing.file_digest(full) != sha):
                return "content"
            os.unlink(full)
        except OSError as e:
            return f"error: {e}"
        return "deleted"

    def run(batches):
        for b in batches:
            c = {k: b.column(i).to_pylist() for i, k in enumerate(columns)}
            done = [step(mounts.get((h, v)), h, p, n, s) for h, v, p, n, s in zip(c["hostname"], c["volume"], c["path"], c["size"], c["sha512"], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], [*columns, "done"])

    ship(rows.sparkSession)
    return rows.select(*columns).mapInArrow(run, "hostname string, volume string, path_norm string, path string, size long, sha512 string, done string")


SAYS = {
    "foreign": "not on this host, or its volume has no mount point", "missing": "not there any more; its row goes too",
    "size": "not the size that was catalogued; left alone", "content": "not the content that was catalogued; left alone",
}


def _delete(spark, store, gone: DataFrame, deletions: DataFrame, hostname: str, out: PruneResult, quiet: bool, verify: bool) -> None:
    """Unlinks in tasks on the files' host; the catalog then loses the rows of what is really gone, in one commit, and the log gets their tombstones."""
    mounts = {(v["hostname"], v["volume"]): v["mount_point"] for v in store.volumes()}
    out.errors += deletions.filter("kind = 'file'").select("hostname", "volume", F.col("path").alias("path_norm")).join(store.rows(), KEY, "left_anti").count()
    done = written(_unlink(gone, mounts, hostname, verify), "unlinked")
    total = done.filter("done = 'deleted'").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    out.deleted_files, out.deleted_bytes = total.n, total.b
    for r in done.filter("done <> 'deleted'").toLocalIterator():
        out.errors += 1
        _say(quiet, f"[prune] {r.hostname}:{r.volume}:{r.path}: {SAYS.get(r.done, r.done)}")
    # emptied directories, the deepest first, never the mount point itself
    above = done.filter("done = 'deleted'").select("hostname", "volume", F.explode(ancestors("path")).alias("dir")).filter("dir <> ''").distinct()
    for r in above.orderBy(F.size(parts("dir")).desc()).toLocalIterator():
        try:
            os.rmdir(hashing.place(mounts[r.hostname, r.volume], r.dir))
        except OSError:
            pass  # not empty
    left = done.filter("done in ('deleted', 'missing')").select(*KEY)
    if not left.isEmpty():
        store.log(tombstones(left, int(time.time())))
        store.commit(written(merge.delete_rows(store.rows(), left), "catalog"))


def merge_command(
    spark: SparkSession, output: str, inputs: list[str], rehash_list: str | None = None, dataset: str | None = None, mode: str = "error", lenient: bool = False, quiet: bool = False, now: int | None = None
) -> dict[str, int]:
    """Merges catalogs of any format; the output's suffix says which it is.  Returns the counters.

    JSON lines get all valid rows as they are, in one file; catalogs get one row for each key.  mode='append'
    merges onto an existing catalog.
    """
    if not output or not inputs:
        raise UsageError("merge needs --output and --inputs")
    now = int(time.time()) if now is None else now
    frames = [sources.read_catalog(spark, p, lenient) for p in inputs]
    as_lines = output.lower().endswith(".jsonl")
    target = None if as_lines else sources.open_catalog(spark, output)
    if target is not None and target.exists():
        if mode != "append":
            raise FileExistsError(f"output exists already: {output}")
        frames.insert(0, target.rows())
    with scratch():
        rows = written(merge.valid_rows(merge.union_inputs(frames), now), "merged")
        merged = merge.merge_catalogs(rows, now)
        counters = merge.merge_counters(rows).first().asDict()
        if as_lines:
            write_lines(log_lines(rows.orderBy("seq")), output)
        elif output.lower().endswith((".sqlite", ".db")) and not target.exists():
            write_catalog(merged, output, dataset, now)
        else:
            target.open_or_create(dataset, now)
            volumes = [r.asDict() for r in merge.merge_volumes(rows, now).collect()]  # a row for each volume
            target.commit(written(merged, "catalog"), volumes)
        _say(quiet, f"[merge] merged {counters['total']} rows from {len(inputs)} inputs; {counters['conflicts']} rows of known keys, {counters['hash_disagreements']} disagreeing digests")
        if rehash_list:
            write_lines(to_lines(collisions.rehash_worklist(merged)), rehash_list)
    return counters
