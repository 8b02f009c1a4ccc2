"""Line dedup by a suffix array over line ids.

A document is the sequence of its lines that hold a word; a line's id is the hash of its
bytes, and ids are ordered as numbers.  Prefix doubling ranks all suffixes of all documents
by their first 1, 2, 4, .. lines: at each level only suffixes that still share their prefix
with another stay, their next rank is the order of the pair (rank, rank of the suffix as
many lines on), taken from one distributed sort of the distinct shared pairs.  A suffix that
runs past the end of its document shares nothing from there on.

Suffixes with equal prefixes of w lines are an interval of the suffix array whose longest
common prefixes are at least w; two overlapping power-of-two ranks name it.  Deleted are the
lines of all runs of ``min_words`` words or more that start earlier too.  These are the lines of
the intervals' prefixes; not all of them are looked at:

* of a suffix, the shortest prefix with ``min_words`` words, and
* longer ones, as long as the lines after the first have less than ``min_words`` words together.

That is enough: take any run that starts earlier, and its last suffix whose shortest prefix is
still inside the run.  The lines after that suffix's first have less than ``min_words`` words up
to the run's end, so the prefix that ends there is among those looked at; the suffixes before it
mark the lines before it.  In each interval the earliest suffix (smallest document, then line)
stays, the others mark their prefixes.  As a shortest prefix has at most ``min_words`` lines, so
many lines are all that doubling has to rank.

Beside the line ids goes a second hash, of the words of the shortest prefix in another lane.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from arkivist.llm import textvec as tv
from arkivist.llm.base import apart, forget, hashed_side, session, written
from arkivist.llm.substring import pack

MIN_WORDS = 20
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

LINE = "doc_id long, tid long, pos int, rank long, need int, proof long, more array<long>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def worded(w: tv.Words, lines: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words of the lines, and which lines have any."""
    n = np.searchsorted(w.start, lines.end) - np.searchsorted(w.start, lines.start)
    return n, n > 0


def _further(h: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.ListArray:
    """For each row, checksums of the first 1, 2, .. count lines from start."""
    off = np.concatenate([[0], np.cumsum(count)])
    flat, now = np.zeros(off[-1], np.uint64), np.zeros(len(count), np.uint64)
    for t in range(int(count.max(initial=0))):
        own = np.flatnonzero(count > t)
        x = (now[own] ^ h[start[own] + t]) * _MIX
        now[own] = flat[off[own] + t] = (x ^ (x >> np.uint64(29))) * _MIX + np.uint64(t + 1)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.view(np.int64)))


def _lines(named: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with words: its place, its id, the lines that min_words take from it (0: too few
    follow), the second hash of these, and checksums of the lines after them by which the prefix may grow."""

    def make(batches):
        for part in tv.slices(batches):
            w, lines = tv.Words(part.column(1)), tv.Words(part.column(1), _NEWLINE)
            n, has = worded(w, lines)
            row, n, h = tv.row_of(lines.row)[has], n[has], lines.hash[has]
            if not len(row):
                continue
            bound = np.searchsorted(row, np.arange(part.num_rows + 1))
            total = np.concatenate([[0], np.cumsum(n)])  # words before each line
            at = np.arange(len(row))
            to = np.searchsorted(total, total[:-1] + min_words)
            need = np.where(to <= bound[row + 1], to - at, 0)
            proof, some = np.zeros(len(row), np.uint64), np.flatnonzero(need)
            proof[some] = tv.Runs(w.hash, 1).of(total[some], total[to[some]] - total[some])
            take = pa.array(row)
            end = np.minimum(np.searchsorted(total, total[1:] + min_words) - 1, bound[row + 1])
            more = _further(h, at + need, np.where(need > 0, np.maximum(0, end - at - need), 0))
            columns = [part.column(0).take(take), part.column(2).take(take), *map(pa.array, ((at - bound[row]).astype(np.int32), h.view(np.int64), need.astype(np.int32), proof.view(np.int64))), more]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "pos", "rank", "need", "proof", "more"])

    return named.select("doc_id", "text", "tid").mapInArrow(make, LINE)


def later_copies(named: DataFrame, min_words: int) -> DataFrame:
    """doc_id, tid, pos, need: line runs that an earlier suffix has too.  named: doc_id, text, tid."""
    ids = _lines(named, min_words)
    tied = ids.groupBy("rank").agg(F.count("*").alias("c")).filter("c > 1").select(apart("rank").alias("rank"))
    level = written(ids.join(tied, "rank").select("doc_id", "tid", "pos", "rank", "need", "proof", "more"), "suffixes")
    most = level.agg(F.max("need")).first()[0] or 0
    late, span = None, 1
    while span <= most:
        here = level.filter((F.col("need") >= span) & (F.col("need") < 2 * span))
        other = level.select("doc_id", "tid", F.col("pos").alias("at"), F.col("rank").alias("rank2"))
        if span > 1:
            here = here.withColumn("at", F.col("pos") + F.col("need") - span).join(other, ["doc_id", "tid", "at"]).drop("at")
            here = here.withColumn("name", F.xxhash64("need", "rank", "rank2"))
        else:
            here = here.withColumn("name", F.col("rank"))
        longer = F.concat(F.array("name"), F.transform("more", lambda m: F.xxhash64("name", m)))
        here = here.select("doc_id", "tid", "pos", "need", "proof", F.posexplode(longer).alias("by", "name")).withColumn("need", F.col("need") + F.col("by"))
        here = written(here.select("doc_id", "tid", "pos", "need", "proof", "name"), "intervals")
        first = here.groupBy("name", "proof").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("c")).filter("c > 1").select(apart("name").alias("name"), apart("proof").alias("proof"), "first")
        found = here.join(first, ["name", "proof"]).filter(F.struct("doc_id", "pos") != F.col("first")).select("doc_id", "tid", "pos", "need")
        late = found if late is None else late.unionByName(found)
        if 2 * span > most:
            break
        ahead = Window.partitionBy("doc_id", "tid").orderBy("pos").rangeBetween(span, span)
        pairs = level.withColumn("rank2", F.max("rank").over(ahead)).filter(F.col("rank2").isNotNull())
        pairs = pairs.withColumn("more", F.when(F.col("need") >= 2 * span, F.col("more")))  # the others have had their turn
        pairs = written(pairs, "pairs")
        shared = pairs.groupBy("rank", "rank2").agg(F.count("*").alias("c")).filter("c > 1").select("rank", "rank2")
        # The place in a sorted frame grows with the pair: an order-preserving rank.
        ranked = shared.orderBy("rank", "rank2").withColumn("next", F.monotonically_increasing_id())
        grown = pairs.join(ranked, ["rank", "rank2"]).select("doc_id", "tid", "pos", F.col("next").alias("rank"), "need", "proof", "more")
        before, level = level, written(grown, "suffixes")
        forget(pairs)
        forget(before)
        span *= 2
    if late is None:
        return level.filter("false").select("doc_id", "tid", "pos", "need")
    return late


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, carry: bool = False) -> DataFrame:
    """doc_id, text (null stays null), kept, n_lines, n_removed, for each row of documents; with carry also
    row, a struct of the other columns.

    Lines are split at newlines.  Deleted are the lines of all runs with min_words words or more
    that start earlier too, in a document of smaller id or above in the same one.  Lines without
    a word are never deleted, and do not part the lines around them.  Rows without an id are
    compared with nothing.  Repeated rows have the same place, so neither goes for the other.
    An empty table gives no rows.
    """
    session(docs)
    types = dict(docs.dtypes)
    own = [F.col(c) if types[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))]
    rest = [F.struct(F.col("doc_id").alias("doc_id"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row")] if carry else []
    text = docs.select(*own, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0).cast("long")).alias("tid"), *rest)
    named = text.filter(F.col("doc_id").isNotNull())
    late = later_copies(named, min_words)
    runs = late.select("doc_id", "tid", pack(F.col("pos"), F.col("pos") + F.col("need")).alias("s")).groupBy("doc_id", "tid").agg(F.collect_list("s").alias("runs"))
    extra = ["row"] if carry else []
    full = named.join(hashed_side(written(runs, "runs")), ["doc_id", "tid"], "left").select("doc_id", "text", "runs", *extra)
    full = full.unionByName(text.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<long>").alias("runs"), *extra))

    def keep(batches):
        for part in tv.slices(batches):
            w, lines = tv.Words(part.column(1)), tv.Words(part.column(1), _NEWLINE)
            _, has = worded(w, lines)
            count = np.bincount(tv.row_of(lines.row)[has], minlength=part.num_rows)
            kept, gone = part.column(1).to_pylist(), np.zeros(part.num_rows, np.int64)
            spans = part.column(2)
            for r in np.flatnonzero(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist():
                s = np.array(spans[r].as_py(), np.int64)
                step = np.zeros(count[r] + 1, np.int64)
                np.add.at(step, s >> 32, 1)
                np.add.at(step, s & 0xFFFFFFFF, -1)
                drop = np.cumsum(step[:-1]) > 0
                number, out = 0, []
                own = has[lines.row[r] : lines.row[r + 1]].tolist()
                full = 0  # lines that are not empty
                for line in kept[r].split("\n"):
                    if line:
                        worded_ = own[full]
                        full += 1
                        if worded_:
                            number += 1
                            if drop[number - 1]:
                                continue
                    out.append(line)
                kept[r], gone[r] = "\n".join(out), int(drop.sum())
            cols = [part.column(0), part.column(1), pa.array(kept, pa.string()), pa.array(count), pa.array(gone), *([part.column(3)] if carry else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "kept", "n_lines", "n_removed", *extra])

    schema = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("kept", T.StringType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()))])
    return full.mapInArrow(keep, T.StructType([*schema.fields, T.StructField("row", text.schema["row"].dataType)]) if carry else schema)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
