"""Directory trees: signatures from the leaves up, duplicate groups, and which copies a larger copy covers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkivist.functions.paths import ancestors, basename, depth, key_str, order_key, parent, parts
from arkivist.operators.collisions import size_histogram
from arkivist.operators.common import exchanged, redealt, written
from arkivist.operators.numbering import numbered
from arkivist.ship import ship

VOLUME = ["hostname", "volume"]
#: Directories with more direct children than this, files or directories, are signed in a stream of sorted children.
MOST_CHILDREN = 500_000
#: So many levels are one plan; then the level is written, which cuts the lineage.
LEVELS_AT_ONCE = 4


def file_nodes(rows: DataFrame) -> DataFrame:
    """Files as nodes.  sig: F: and the digest; without one X: if the size collides, else U:, with an id of its own."""
    own = F.concat_ws(":", "hostname", "volume", "path_norm") if "file_id" not in rows.columns else F.col("file_id").cast("string")
    sha = F.when(F.col("sha512") != "", F.col("sha512"))
    sizes = redealt(size_histogram(rows).filter("n > 1").select("size"), "size").withColumn("collides", F.lit(True))
    # Only rows without a digest need their size looked up.
    known = rows.filter(sha.isNotNull()).withColumn("sig", F.concat(F.lit("F:"), sha))
    rest = rows.filter(sha.isNull()).join(exchanged(sizes), "size", "left")
    rest = rest.withColumn("sig", F.concat(F.when(F.col("collides"), "X:").otherwise("U:"), own)).drop("collides")
    both = known.unionByName(rest)
    return both.select(
        *VOLUME, F.array_join(parts("path_norm"), "/").alias("path"), F.lit("file").alias("kind"), "sig", "size", F.lit(1).cast("long").alias("n_files"),
        order_key("path_norm", False).alias("order_key"), sha.alias("sha512"), F.col("path").alias("orig_path"),
    )


def dir_totals(rows: DataFrame) -> DataFrame:
    """Size and number of all files below each directory, the root included: one exchange, summed before it."""
    up = rows.select(*VOLUME, F.explode(ancestors("path_norm")).alias("path"), "size")
    return up.groupBy(*VOLUME, "path").agg(F.sum("size").alias("size"), F.count("*").alias("n_files"))


def _sign_arrays(children: DataFrame, bits: int) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("name", "is_dir", "sig", "path")))
    text = F.array_join(F.transform(kids, lambda c: F.concat(c["name"], F.lit("\0"), c["sig"], F.lit("\0"))), "")
    return children.groupBy(*VOLUME, "parent").agg(F.concat(F.lit("D:"), F.sha2(text, bits)).alias("sig"))


def _sign_streams(children: DataFrame, bits: int) -> DataFrame:
    """The same for directories of any size: children sorted in their partition, hashed one by one."""
    ship(children.sparkSession)
    keys = [*VOLUME, "parent"]
    dealt = children.select(*keys, "name", "is_dir", "sig", "path").repartition(*keys).sortWithinPartitions(*keys, "name", "is_dir", "sig", "path")

    def sign(batches):
        now, h = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, "D:" + h.hexdigest())], [*keys, "sig"])

        for b in batches:
            cols = b.to_pydict()
            for *key, name, _, sig, _ in zip(*(cols[c] for c in (*keys, "name", "is_dir", "sig", "path")), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, h = key, hashlib.new(f"sha{bits}")
                h.update(f"{name}\0{sig}\0".encode())
        if now is not None:
            yield done()

    return dealt.mapInArrow(sign, "hostname string, volume string, parent string, sig string")


def widths(leaf: DataFrame) -> DataFrame:
    """For each directory the number of its direct children, files and directories, and the depth of its deepest file."""
    own = leaf.groupBy(*VOLUME, parent("path").alias("p")).agg(F.count("*").alias("n"), F.max("level").alias("level"))
    every = own.select(*VOLUME, F.explode(F.array_append(ancestors("p"), F.col("p"))).alias("p")).distinct()
    below = every.filter("p != ''").select(*VOLUME, parent("p").alias("p")).groupBy(*VOLUME, "p").agg(F.count("*").alias("n"), F.lit(0).alias("level"))
    return own.unionByName(below).groupBy(*VOLUME, "p").agg(F.sum("n").alias("n"), F.max("level").alias("level"))


def dir_signatures(files: DataFrame, bits: int = 512, most_children: int = MOST_CHILDREN) -> DataFrame:
    """hostname, volume, path, sig of every directory, from file nodes.

    A directory's signature is the digest of its children's names and signatures in order of
    their names, a file before a directory of the same name.  Levels go from the deepest up;
    only direct children ever meet in one row.
    """
    leaf = files.select(*VOLUME, "path", "sig", F.lit(0).alias("is_dir"), F.size(parts("path")).alias("level"))
    facts = widths(leaf).agg(F.max("level").alias("top"), F.max("n").alias("widest")).first()
    if facts.top is None:
        return leaf.select(*VOLUME, "path", "sig")
    sign = _sign_streams if facts.widest > most_children else _sign_arrays
    out, below = None, None
    for level in range(facts.top, 0, -1):
        here = leaf.filter(F.col("level") == level).drop("level")
        if below is not None:
            here = here.unionByName(below.withColumn("is_dir", F.lit(1)))
        named = here.withColumns({"parent": parent("path"), "name": basename("path")})
        below = sign(named, bits).withColumnRenamed("parent", "path")
        if (facts.top - level) % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
            below = written(below, "signatures")
        out = below if out is None else out.unionByName(below)
    return out


def dir_nodes(files: DataFrame, bits: int = 512, most_children: int = MOST_CHILDREN) -> DataFrame:
    """All directories as nodes, from file nodes."""
    totals = dir_totals(files.select(*VOLUME, F.col("path").alias("path_norm"), "size"))
    signed = dir_signatures(files, bits, most_children)
    out = signed.join(exchanged(totals), [*VOLUME, "path"])
    return out.select(
        *VOLUME, "path", F.lit("dir").alias("kind"), "sig", "size", "n_files", order_key("path", True).alias("order_key"),
        F.lit(None).cast("string").alias("sha512"), F.lit(None).cast("string").alias("orig_path"),
    )


def nodes(rows: DataFrame, bits: int = 512) -> DataFrame:
    """All files and directories of a catalog, with signatures and totals."""
    files = written(file_nodes(rows), "files")  # read once for each level
    return files.unionByName(dir_nodes(files, bits))


PLACE = ["hostname", "volume", "order_key"]


def _place() -> Column:
    return F.struct(*PLACE)


def duplicate_groups(all_nodes: DataFrame, min_size: int = 0) -> DataFrame:
    """One row for each signature of two nodes or more, with its first member's facts.

    Unhashed files and what contains them never match.  min_size counts for files only.
    """
    whole = all_nodes.filter(~F.col("sig").rlike("^[UX]:") & (F.col("sig") != "D:empty"))
    g = whole.groupBy("sig").agg(F.count("*").alias("copies"), F.min(F.struct(*PLACE, "path", "kind", "size", "n_files")).alias("f"))
    g = g.filter("copies > 1").select("sig", "copies", *[F.col(f"f.{c}").alias(f"first_{c}") for c in PLACE], *[F.col(f"f.{c}").alias(c) for c in ("path", "kind", "size", "n_files")])
    return g.filter((F.col("kind") == "dir") | (F.col("size") >= min_size))


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Adds rank: the order in which groups are looked at, the shallowest and then the largest first.

    The rank is the place in one distributed sort; it grows with the order but has gaps.
    """
    order = [depth("path").asc(), F.col("size").desc(), *[F.col(f"first_{c}") for c in PLACE]]
    return groups.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())


def coverage(all_nodes: DataFrame, min_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of all duplicate groups; members have covered, groups have reported.

    A member is covered if a directory above it is in a group of an earlier rank; a group is
    reported unless all its members are covered.  (An unreported earlier group's members are
    covered themselves, so any group will do in place of a reported one.)
    """
    all_nodes = written(all_nodes, "nodes")
    groups = written(ranked_groups(duplicate_groups(all_nodes, min_size)), "groups")
    facts = groups.select("sig", "rank", F.col("size").alias("size_each"), F.col("n_files").alias("file_count_each"), F.col("kind").alias("group_kind"), "copies")
    members = written(all_nodes.join(exchanged(facts), "sig"), "members")
    place = [*VOLUME, "path"]
    above = members.filter("kind = 'dir'").select(*VOLUME, F.col("path").alias("above"), F.col("rank").alias("above_rank"))
    under = members.select(*place, "kind", "rank", F.explode(ancestors("path")).alias("above"))
    hit = under.join(exchanged(above), [*VOLUME, "above"]).filter("above_rank < rank").select(*place, "kind").distinct().withColumn("covered", F.lit(True))
    members = members.join(exchanged(hit), [*place, "kind"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    state = members.groupBy("sig").agg((~F.bool_and("covered")).alias("reported"))
    return members, groups.join(exchanged(state), "sig")


def coverage_report(all_nodes: DataFrame, min_size: int = 0) -> DataFrame:
    """The members of reported groups, numbered in the order of a walk (1: the one to keep)."""
    members, groups = coverage(all_nodes, min_size)
    shown = members.join(exchanged(redealt(groups.filter("reported").select("sig"), "sig")), "sig", "left_semi")
    widest = groups.agg(F.max("copies")).first()[0] or 0
    return numbered(shown, ["sig"], PLACE, "member_idx", widest).select(
        "sig", F.col("group_kind").alias("kind"), "size_each", "file_count_each", "rank", "copies", "member_idx", *VOLUME, "path",
        key_str("hostname", "volume", "path").alias("key"), F.col("covered").alias("covered_by_ancestor"), "sha512", "orig_path", "order_key",
    )


def report_order() -> list[Column]:
    """Largest groups first, then those with most files, then by rank."""
    return [F.col("size_each").desc(), F.col("file_count_each").desc(), F.col("rank")]
