"""Prune planning: which member of a group to keep, what to delete, and whether a copy survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkivist.operators import tree
from arkivist.operators.common import exchanged, redealt
from arkivist.schema import KEY

#: Members: sig, kind, size_each, file_count_each, member_idx, hostname, volume, path (and more).
MEMBER_KEY = ["sig", "member_idx"]


def _choice(rule: str) -> tuple[Column, Column, bool]:
    """(candidates, order, whether there must be just one candidate); an unknown rule has no candidate."""
    name, _, value = rule.partition("=")
    if rule == "first":
        return F.lit(True), F.struct(F.lit(0).alias("k"), "member_idx"), False
    if rule == "shortest-path":
        return F.lit(True), F.struct(F.length("path").alias("k"), "member_idx"), False
    if name in ("host", "volume") and "=" in rule:
        return F.col("hostname" if name == "host" else name) == value, F.struct(F.lit(0).alias("k"), "member_idx"), True
    return F.lit(False), F.struct(F.lit(0).alias("k"), "member_idx"), True


def keepers(members: DataFrame, rule: str) -> DataFrame:
    """sig, keep_idx for the groups in which the rule finds its one keeper: aggregates, so that a huge group is no task of its own."""
    candidate, order, single = _choice(rule)
    g = members.filter(candidate).groupBy("sig").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    if single:
        g = g.filter("n = 1")
    return g.select("sig", F.col("best.member_idx").alias("keep_idx"))


def plan_deletions(members: DataFrame, rule: str, hostname: str) -> DataFrame:
    """Each local member that the rule deletes, with the member that stays.

    Members on other hosts are never deleted; groups without a local member and groups in
    which the rule finds no keeper have no row.
    """
    keep = redealt(keepers(members, rule), "sig")
    j = members.join(exchanged(keep), "sig")
    kept = j.filter(F.col("member_idx") == F.col("keep_idx")).select("sig", F.struct("hostname", "volume", "path").alias("keep"))
    gone = j.filter((F.col("member_idx") != F.col("keep_idx")) & (F.col("hostname") == hostname)).drop("keep_idx")
    return gone.join(exchanged(redealt(kept, "sig")), "sig").select("sig", "kind", "size_each", "file_count_each", "member_idx", "hostname", "volume", "path", "keep")


def group_states(members: DataFrame, rule: str, hostname: str) -> DataFrame:
    """One row for each group: 'no_local', 'skipped' or 'planned'."""
    local = members.groupBy("sig").agg(F.max((F.col("hostname") == hostname).cast("int")).alias("local"))
    j = local.join(exchanged(keepers(members, rule)), "sig", "left")
    return j.select("sig", F.when(F.col("local") == 0, "no_local").when(F.col("keep_idx").isNull(), "skipped").otherwise("planned").alias("state"))


def in_subtree(path_norm: Column, top: Column) -> Column:
    """Exactly below: no wildcards, and case counts."""
    return (top == "") | (path_norm == top) | path_norm.startswith(F.concat(top, F.lit("/")))


def _under(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """rows with the top (hostname, volume, top) they are below: an equi-join on each path's own prefixes."""
    from arkivist.functions.paths import ancestors

    prefixes = F.array_append(ancestors("path_norm"), F.col("path_norm"))
    r = rows.withColumn("top", F.explode(F.array_distinct(prefixes)))
    return r.join(exchanged(tops), ["hostname", "volume", "top"])


def subtree_info(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Files and bytes below each (hostname, volume, path); 0 where there are none."""
    t = tops.select("hostname", "volume", F.col("path").alias("top")).distinct()
    found = _under(rows.select(*KEY, "size"), t).groupBy("hostname", "volume", "top").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    out = t.join(exchanged(found), ["hostname", "volume", "top"], "left")
    return out.select("hostname", "volume", F.col("top").alias("path"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def expand_dirs(deletions: DataFrame, rows: DataFrame, same_content: bool = True) -> DataFrame:
    """Directory deletions as deletions of files, each beside the file at the same relative path of the kept tree.

    Files without such a partner stay; with same_content so do those whose digests are not equal.
    """
    d = deletions.filter("kind = 'dir'").select("sig", "hostname", "volume", F.col("path").alias("top"), "keep")
    facts = rows.select(*KEY, "size", "sha512")

    def relative(top: Column) -> Column:
        return F.when(top == "", F.col("path_norm")).otherwise(F.substr("path_norm", F.length(top) + 2))

    gone = _under(facts, d).withColumn("rel", relative(F.col("top")))
    kept_tops = d.select(F.col("keep.hostname").alias("hostname"), F.col("keep.volume").alias("volume"), F.col("keep.path").alias("top")).distinct()
    kept = _under(facts, kept_tops).select(
        F.struct("hostname", "volume", F.col("top").alias("path")).alias("keep"), relative(F.col("top")).alias("rel"),
        F.col("path_norm").alias("keep_path"), F.col("sha512").alias("keep_sha"),
    )
    j = gone.join(exchanged(kept), ["keep", "rel"])
    if same_content:
        j = j.filter(F.col("sha512") == F.col("keep_sha"))
    return j.select("sig", *KEY, "size", F.col("keep.hostname").alias("keep_hostname"), F.col("keep.volume").alias("keep_volume"), "keep_path", "sha512")


def deleted_files(deletions: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog rows that a plan deletes, those of whole directories included."""
    files = deletions.filter("kind = 'file'").select("hostname", "volume", F.col("path").alias("path_norm"))
    dirs = deletions.filter("kind = 'dir'").select("hostname", "volume", F.col("path").alias("top")).distinct()
    below = _under(rows.select(*KEY), dirs).select(*KEY)
    return rows.join(exchanged(files.unionByName(below).distinct()), KEY, "left_semi")


def survivor_check(deletions: DataFrame, rows: DataFrame) -> DataFrame:
    """sha512, n_all, n_deleted, survives for each digest of which something would be deleted.
    Files without a digest have no known copy: their row, of a null digest, never survives."""
    gone = deleted_files(deletions, rows).groupBy("sha512").agg(F.count("*").alias("n_deleted"))
    all_ = redealt(rows.groupBy("sha512").agg(F.count("*").alias("n_all")), "sha512")
    j = gone.join(exchanged(all_.withColumnRenamed("sha512", "_all")), F.col("sha512").eqNullSafe(F.col("_all")))
    return j.select("sha512", "n_all", "n_deleted", ((F.col("n_all") > F.col("n_deleted")) & F.col("sha512").isNotNull()).alias("survives"))


def member_states(members: DataFrame, rows: DataFrame, bits: int = 512) -> DataFrame:
    """A plan's members with state: 'current', 'changed' or 'missing' in the catalog as it is now.

    A file is current if its row has the size and the digest that the plan has for it; a row
    without a digest has changed.  A directory is current if its signature, made anew from the
    catalog's rows, is the plan's.  Only the volumes that the plan's directories are on are signed.
    """
    known = F.struct("size", F.when(F.col("sha512") != "", F.concat(F.lit("F:"), F.col("sha512"))).alias("sig"), F.lit(1).cast("long").alias("n_files"))
    files = rows.select("hostname", "volume", F.col("path_norm").alias("path"), F.lit("file").alias("kind"), known.alias("now"))
    tops = members.filter("kind = 'dir'").select("hostname", "volume").distinct()
    signed = tree.dir_nodes(tree.file_nodes(rows.join(tops, ["hostname", "volume"], "left_semi")), bits)
    dirs = signed.select("hostname", "volume", "path", "kind", F.struct("size", "sig", "n_files").alias("now"))
    expected = F.when(F.col("kind") == "dir", F.col("sig")).otherwise(F.concat(F.lit("F:"), F.coalesce("sha512", F.regexp_extract("sig", "^F:(.*)$", 1))))
    same = (F.col("now.size") == F.col("size_each")) & F.coalesce(F.col("now.sig") == expected, F.lit(False))
    out = members.join(exchanged(files.unionByName(dirs)), ["hostname", "volume", "path", "kind"], "left")
    return out.withColumn("state", F.when(F.col("now").isNull(), "missing").when(same, "current").otherwise("changed")).drop("now")


def kept_files(deletions: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog rows that a plan's deletions rely on: each kept file, and in kept directories the partner of every deleted file."""
    keys = ["hostname", "volume", "path_norm"]
    single = deletions.filter("kind = 'file'").select(F.col("keep.hostname").alias("hostname"), F.col("keep.volume").alias("volume"), F.col("keep.path").alias("path_norm"))
    below = expand_dirs(deletions, rows).select(F.col("keep_hostname").alias("hostname"), F.col("keep_volume").alias("volume"), F.col("keep_path").alias("path_norm"))
    return rows.join(exchanged(single.unionByName(below).distinct()), keys, "left_semi")


def plan_totals(deletions: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: files and bytes that a plan deletes."""
    gone = deleted_files(deletions, rows)
    return gone.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
