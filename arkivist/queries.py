"""The registered queries of the catalog engine, by name; oracle.py has the same in SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkivist.functions import formats, paths
from arkivist.operators import collisions, common, hashing, merge, prune, scan, tree
from arkivist.plans import report
from arkivist.schema import CATALOG_COLUMNS, KEY, LOG
from arkivist.sources import register
from arkivist.sources.jsonl import append_log, read_jsonl, tombstones, write_jsonl
from arkivist.sources.store import CatalogStore
from arkivist.streaming import collisions as stream_collisions
from arkivist.streaming import hashlog as stream_hashlog
from arkivist.testdata import BITS, documents, events, part_trees, table

Query = Callable[[SparkSession, str], DataFrame]
NOW = 2_000_000_000
HOST = "src1"
PART_HOST = "Brand#13"


def _temporary(spark: SparkSession, name: str) -> str:
    return f"{common.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def normalize_paths(spark, d):
    p = table(spark, d, "pages")
    os = F.element_at(F.array(F.lit("linux"), F.lit("darwin"), F.lit("MSWin32")), (F.col("page_id") % 3 + 1).cast("int"))
    url = F.regexp_replace("url", "^[a-z]+://", "")
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("./"), F.translate(url, "/", "\\"), F.lit("\\"))).otherwise(F.concat(F.lit(".//Photos/"), url, F.lit("//")))
    return p.select("page_id", raw.alias("raw"), os.alias("os")).select("page_id", "os", paths.normalize_path("raw", "os").alias("path_norm"))


def path_depth_ancestors(spark, d):
    return documents(spark, d).select(
        "hostname", "path_norm", paths.depth("path_norm").alias("depth"), paths.basename("path_norm").alias("name"),
        F.array_join(paths.ancestors("path_norm"), "|").alias("ancestors"), paths.key_str("hostname", "volume", "path_norm").alias("key"),
    )


def format_values(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice")) * F.col("o_orderkey") % 99999999999).cast("long").alias("n"))
    return o.select("o_orderkey", formats.fmt_bytes("n").alias("bytes_text"), formats.fmt_dur(F.col("n") % 500000).alias("duration_text"))


def size_histogram(spark, d):
    return collisions.size_histogram(documents(spark, d))


def size_collisions(spark, d):
    return collisions.size_collisions(documents(spark, d)).select(*KEY, "size")


def missing_hash_warning(spark, d):
    return collisions.missing_hash_warning(documents(spark, d, missing=3))


def catalog_load(spark, d):
    rows = documents(spark, d)
    volumes = rows.groupBy("hostname", "volume").agg(F.min("mount_point").alias("mount_point"), F.max("scanned_at").alias("volume_scanned_at"))
    return scan.load(rows.drop("mount_point"), volumes).select(*KEY, "size", "sha512", "mount_point", "volume_scanned_at")


def _renamed(rows, every: int, suffix: str):
    """Every so many files under another name: new there, and vanished on the other side."""
    return rows.withColumn("path_norm", F.when(F.col("mtime") % every == 0, F.concat("path_norm", F.lit(suffix))).otherwise(F.col("path_norm"))).withColumn("path", F.col("path_norm"))


def _walk(spark, d):
    """A later walk of the documents: every fifth has grown, every eleventh has a new name."""
    return _renamed(documents(spark, d), 11, ".new").withColumns({
        "size": F.when(F.col("mtime") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")),
        "scanned_at": F.lit(2000).cast("long"), "sha512": F.lit(None).cast("string"),
    })


def _before(spark, d):
    """The catalog before it: every thirteenth had another name."""
    return _renamed(documents(spark, d, missing=4), 13, ".old")


def scan_decisions(spark, d):
    out = scan.decide(_walk(spark, d), _before(spark, d), full_hash=True)
    return out.select(*KEY, "size", "sha512", "unchanged", "needs_hash")


def scan_upsert(spark, d):
    old = _before(spark, d)
    out = merge.upsert(old, scan.decide(_walk(spark, d), old).select(*CATALOG_COLUMNS))
    return out.select(*KEY, "size", "mtime", "sha512", "scanned_at")


def quick_scan_hash(spark, d):
    """Reads the content of those without a digest whose size collides, and only those."""
    text = table(spark, d, "documents").select(F.col("doc_id").alias("mtime"), "text")
    todo = collisions.pending(documents(spark, d, missing=2)).join(text, "mtime")
    return todo.select(*KEY, "size", hashing.content_digest("text", BITS).alias("sha512"))


def file_dup_groups(spark, d):
    g = tree.duplicate_groups(tree.file_nodes(documents(spark, d)), min_size=50)
    return g.select("sig", "copies", "size", paths.key_str("first_hostname", "first_volume", "path").alias("first_key"))


def keep_candidates(spark, d):
    """The report of duplicate files, as dedupe makes it where no directory is one."""
    rows = tree.coverage_report(tree.file_nodes(documents(spark, d, missing=5)))
    return rows.select("sha512", "copies", "hostname", "volume", "path", "member_idx", F.trim(report.tag()).alias("tag"))


def dir_totals(spark, d):
    return tree.dir_totals(documents(spark, d))


def dir_signatures(spark, d):
    return tree.dir_signatures(tree.file_nodes(part_trees(spark, d)), BITS)


def dir_dup_groups(spark, d):
    g = tree.duplicate_groups(tree.dir_nodes(tree.file_nodes(part_trees(spark, d)), BITS))
    return g.select("sig", "copies", "size", "n_files", paths.key_str("first_hostname", "first_volume", "path").alias("first_key"))


def _report(spark, d):
    return tree.coverage_report(tree.nodes(part_trees(spark, d), BITS))


def coverage_report(spark, d):
    return _report(spark, d).select("sig", "kind", "size_each", "file_count_each", "member_idx", "key", "covered_by_ancestor")


def merge_catalogs(spark, d):
    return merge.merge_fold(events(spark, d))


def merge_counters(spark, d):
    return merge.merge_counters(events(spark, d))


def merge_volumes(spark, d):
    return merge.merge_volumes(events(spark, d), NOW)


def hash_disagreements(spark, d):
    return merge.hash_disagreements(events(spark, d))


def rehash_worklist(spark, d):
    return collisions.rehash_worklist(documents(spark, d, missing=3))


def rehash_list_apply(spark, d):
    rows = documents(spark, d, missing=3)
    own = scan.worklist_rows(rows, collisions.rehash_worklist(rows), HOST, "en")
    text = table(spark, d, "documents").select(F.col("doc_id").alias("mtime"), hashing.content_digest("text", BITS).alias("new"))
    found = own.join(text, "mtime").select(*KEY, F.col("new").alias("sha512"))
    return merge.set_digests(rows, found).select(*KEY, "sha512")


def _members(spark, d):
    return _report(spark, d)


def _prune(rule: str, host: str = PART_HOST) -> Query:
    def query(spark, d):
        out = prune.plan_deletions(_members(spark, d), rule, host)
        return out.select("sig", "kind", "member_idx", *KEY[:2], "path", paths.key_str("keep.hostname", "keep.volume", "keep.path").alias("keep_key"))

    return query


def prune_group_states(spark, d):
    return prune.group_states(_members(spark, d), "volume=x0", PART_HOST)


def prune_stale_plan(spark, d):
    """A plan held against the catalog some time on: what of it still is as it was."""
    return prune.member_states(_members(spark, d), part_trees(spark, d, later=True), BITS).select("sig", "kind", "hostname", "volume", "path", "state")


def prune_file_level(spark, d):
    rows = part_trees(spark, d)
    return prune.expand_dirs(prune.plan_deletions(_members(spark, d), "first", PART_HOST), rows).select("sig", *KEY, "size", "keep_hostname", "keep_volume", "keep_path")


def subtree_info(spark, d):
    rows = documents(spark, d)
    tops = rows.select("hostname", "volume", F.concat(F.lit("d"), F.col("mtime") % 8).alias("path")).distinct()
    return prune.subtree_info(rows, tops)


def prune_apply_catalog(spark, d):
    rows = part_trees(spark, d)
    gone = prune.deleted_files(prune.plan_deletions(_members(spark, d), "first", PART_HOST), rows)
    return merge.delete_rows(rows, gone).select(*KEY, "size", "sha512")


def survivor_check(spark, d):
    return prune.survivor_check(prune.plan_deletions(_members(spark, d), "shortest-path", PART_HOST), part_trees(spark, d))


def plan_totals(spark, d):
    return prune.plan_totals(prune.plan_deletions(_members(spark, d), "first", PART_HOST), part_trees(spark, d))


def format_report(spark, d):
    return report.report_lines(_report(spark, d)).select("sig", "line_no", "line")


def plan_json(spark, d):
    return report.group_lines(_report(spark, d)).select("sig", "value")


def jsonl_roundtrip(spark, d):
    where = _temporary(spark, "roundtrip")
    write_jsonl(common.catalog_rows(documents(spark, d, missing=3)), where)
    return read_jsonl(spark, where).select(*CATALOG_COLUMNS)


def _log(spark, d):
    """A hash log of four appends out of order, in segments: rows without digests, late digests of an
    older scan, digests of the first scan's time that partly differ, tombstones, and some rows anew."""
    where = _temporary(spark, "hashlog")
    rows = common.catalog_rows(documents(spark, d))
    none = F.lit(None).cast("string")
    append_log(rows.withColumn("sha512", none), where, segments=True)
    append_log(rows.withColumn("scanned_at", F.col("scanned_at") - F.col("mtime") % 3).withColumn("sha512", F.when(F.col("mtime") % 4 != 0, F.col("sha512"))), where)
    append_log(rows.withColumn("sha512", F.when(F.col("mtime") % 5 == 0, F.sha2(F.col("path"), BITS))).withColumn("size", F.col("size") + 1), where)
    append_log(tombstones(rows.filter("mtime % 17 = 0"), NOW), where)
    append_log(rows.filter("mtime % 34 = 0"), where)
    return where


def hashlog_replay(spark, d):
    """The log through the merge."""
    log = merge.valid_rows(merge.union_inputs([read_jsonl(spark, _log(spark, d), LOG)]), NOW)
    return merge.merge_catalogs(log, NOW).select(*KEY, "size", "sha512", "scanned_at")


def file_hash_scan(spark, d):
    """The documents' texts written as files, walked, and hashed from disk."""
    root = _temporary(spark, "files")
    fs, where = common.filesystem(spark, root)
    if fs.getScheme() != "file":
        raise ValueError("files are walked on file systems only; spark.checkpoint.dir is none")
    top = where.toUri().getPath()

    def put(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = os.path.join(top, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", newline="") as f:
                    f.write(text or "")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    own = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id") % 7, F.lit("/doc"), "doc_id").alias("path"), "text")
    own.mapInArrow(put, "n long").agg(F.sum("n")).collect()
    register(spark)
    found = spark.read.format("fswalk").option("root", top).load().filter("status = 'file'")
    return hashing.hash_files(found.select("path", "size", F.lit(top).alias("mount_point")), BITS).select("path", "size", "sha512", "hash_status")


def lineitem_upsert(spark, d):
    """Keyed upsert at scale: orders' lines over the lines of earlier ships."""
    rows = table(spark, d, "lineitem").select(
        F.lit("h").alias("hostname"), (F.concat(F.lit("v"), F.col("l_orderkey") % 16)).alias("volume"), F.concat("l_orderkey", F.lit("/"), "l_linenumber").alias("path_norm"),
        F.concat("l_orderkey", F.lit("/"), "l_linenumber").alias("path"), F.col("l_quantity").cast("long").alias("size"), F.unix_timestamp("l_shipdate").alias("mtime"),
        F.unix_timestamp("l_shipdate").alias("scanned_at"), F.when(F.col("l_returnflag") != "N", F.sha2(F.col("l_partkey").cast("string"), BITS)).alias("sha512"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
    )
    return merge.merge_fold(rows).select(*KEY, "size", "sha512", "scanned_at")


def _stream_folder(spark, d):
    where = _temporary(spark, "stream")
    documents(spark, d).select(*KEY, "size").write.parquet(where)
    return where


def stream_size_collisions(spark, d):
    source = spark.readStream.schema("hostname string, volume string, path_norm string, size long").parquet(_stream_folder(spark, d))
    out = _temporary(spark, "stream-out")
    q = stream_collisions.collisions(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_hashlog_merge(spark, d):
    """The log as a stream, a few files at a time."""
    store = CatalogStore(spark, _temporary(spark, "store")).create(now=NOW)
    stream_hashlog.replay(spark, _log(spark, d), store, _temporary(spark, "replay"), NOW, files_per_batch=3)
    return store.rows().select(*KEY, "size", "sha512", "scanned_at")


def store_roundtrip(spark, d):
    store = CatalogStore(spark, _temporary(spark, "store")).create("documents", NOW)
    store.commit(common.catalog_rows(documents(spark, d, missing=3)))
    store.commit(merge.upsert(store.rows(), _walk(spark, d)))
    return store.rows().select(*KEY, "size", "sha512", "scanned_at")


def queries() -> dict[str, Query]:
    """All queries by name."""
    out = {
        f.__name__: f
        for f in (
            normalize_paths, path_depth_ancestors, format_values, size_histogram, size_collisions, missing_hash_warning, catalog_load, scan_decisions, scan_upsert,
            quick_scan_hash, file_dup_groups, keep_candidates, dir_totals, dir_signatures, dir_dup_groups, coverage_report, merge_catalogs, merge_counters,
            merge_volumes, hash_disagreements, rehash_worklist, rehash_list_apply, prune_group_states, prune_stale_plan, file_hash_scan, prune_file_level, subtree_info, prune_apply_catalog,
            survivor_check, plan_totals, format_report, plan_json, jsonl_roundtrip, hashlog_replay, lineitem_upsert, stream_size_collisions, stream_hashlog_merge,
            store_roundtrip,
        )
    }
    out |= {
        "prune_plan_first": _prune("first"), "prune_plan_host": _prune(f"host={PART_HOST}", "Brand#14"), "prune_plan_volume": _prune("volume=x1"),
        "prune_plan_shortest": _prune("shortest-path"),
    }
    return out
