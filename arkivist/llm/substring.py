"""Substring dedup by compaction of a de Bruijn graph.

Every window of ``window`` words is a k-mer: an edge from its first window - 1 words to its last
ones.  Edges are not shuffled one by one: a window holds ``window - K + 1`` runs of K words, and the
smallest of these (by hash, the leftmost of equal ones) stands for it, so the windows in a row
that one run stands for, a *stretch*, are one row with its source coordinates (document, first
window, count).  Equal windows choose equal runs.  Then, in Spark:

* stretches are counted by run; a run that occurs once has no repeated edge and leaves the game;
* the counts are joined back.  Where all stretches of a run read the same words, the stretch is a
  nonbranching path already.  Where they differ (where copies begin, end or differ) the graph may
  branch, and the windows themselves are edges: counted by their words, and joined back;
* two successive stretches compact into one path if the node between them is nonbranching: all
  occurrences of either are followed, or preceded, by the other.  That is so if both have the same
  occurrences, one moved along by the other's length, and two sums over the occurrences
  tell (see ``met``), which come with the counts.  So each document compacts the stretches
  along its own coordinates, all documents alike, and an occurrence of a path is one row however
  long it is.

All occurrences of a path are equal, so the first one stays and the others go.  Words count as equal
where two 64-bit hashes of them in different lanes agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm import textvec as tv
from arkivist.llm.base import apart, hashed_side, session, texts_of, written

WINDOW = 20
U64 = np.uint64


def _nth(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same (row, hash) came earlier."""
    order = np.lexsort((np.arange(len(h)), h, row))
    again = np.zeros(len(h), bool)
    r, x = row[order], h[order]
    again[order[1:]] = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
    return again


def stretches(w: tv.Words, window: int):
    """Of each stretch: row, its run's hash, hash of its words, first window (word of its row), windows."""
    k = max(1, window - 15) if window >= 16 else 1
    per = window - k + 1
    none = np.zeros(0, np.int64)
    at, g = w.grams(k)
    if len(g) < per:
        return none, none.astype(U64), none.astype(U64), none, none
    best = np.arange(len(g))
    reach = 1
    while reach < per:  # smallest run of 2, 4, .. successive ones, the left one of equals
        step = min(reach, per - reach)
        a, b = best[:-step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        reach += step
    row = tv.row_of(w.row)
    start = at[: len(best)]
    whole = at[: len(best)] + window <= w.row[row[start] + 1]
    start, best = start[whole], best[whole]
    if not len(start):
        return none, none.astype(U64), none.astype(U64), none, none
    r = row[start]
    head = np.ones(len(start), bool)
    head[1:] = (best[1:] != best[:-1]) | (r[1:] != r[:-1])
    i = np.flatnonzero(head)
    n = np.diff(np.append(i, len(start)))
    first, chosen = start[i], best[i]
    # the words, and where in them the run is
    reads = tv.mix(tv.Runs(w.hash, 1).of(first, n - 1 + window) + (at[chosen] - first).astype(U64))
    return r[i], g[chosen], reads, first - w.row[r[i]], n


EDGE = "run long, reads long, doc_id long, tid long, a int, n int, again boolean"


def edge_table(docs: DataFrame, window: int) -> DataFrame:
    def make(batches):
        for part in tv.slices(batches):
            w = tv.Words(part.column(1))
            r, run, reads, a, n = stretches(w, window)
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(run.view(np.int64)), pa.array(reads.view(np.int64)), part.column(0).take(take), part.column(2).take(take), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(_nth(r, run))],
                ["run", "reads", "doc_id", "tid", "a", "n", "again"],
            )

    return docs.mapInArrow(make, EDGE)


def pack(a, b):
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


#: A prime; sums of up to 2 ** 32 numbers below it are longs.
PRIME = (1 << 31) - 1

def face(place):
    """What a stretch shows to the one before it (place: its second sum), or to the one after it (its second sum, moved along)."""
    return F.pmod(F.xxhash64("c", F.pmod("docs", F.lit(PRIME)), place), F.lit(1 << 31))


def met(docs: DataFrame, window: int) -> DataFrame:
    """Occurrences of repeated runs: doc_id, tid, run, a, n, branches, later (not the first one), c, and both faces."""
    e = edge_table(docs, window)
    # A run's occurrences in two sums modulo PRIME: of the documents' numbers, and of these times the
    # places.  Where all places move along by n, the second grows by n times the first.
    doc = F.pmod(F.xxhash64("doc_id", "tid"), F.lit(PRIME))
    place = F.pmod(doc * F.col("a"), F.lit(PRIME))
    runs = e.groupBy("run").agg(
        F.count("*").alias("c"), F.min("reads").alias("lo"), F.max("reads").alias("hi"), F.min("doc_id").alias("doc0"), F.sum(doc).alias("docs"), F.sum(place).alias("places")
    ).filter("c > 1")
    runs = runs.select(apart("run").alias("run"), (F.col("lo") != F.col("hi")).alias("branches"), "doc0", "c", "docs", "places")
    own = e.join(runs, "run")
    later = (F.col("doc_id") != F.col("doc0")) | F.col("again")
    before, after = F.pmod("places", F.lit(PRIME)), F.pmod(F.pmod("places", F.lit(PRIME)) + F.pmod("docs", F.lit(PRIME)) * F.col("n"), F.lit(PRIME))
    return own.select("doc_id", "tid", "run", "a", "n", "branches", later.alias("later"), "c", pack(face(before), face(after)).alias("faces"))


def compacted(m: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of one document's stretches (first << 32 | 2 * count + removed), each once and in order, those of
    one path as one; and for each of them the place of its first stretch among the given ones."""
    m, at = np.unique(m, return_index=True)
    faces = faces[at]
    a, n, gone = m >> 32, (m & 0xFFFFFFFF) >> 1, m & 1
    glued = np.zeros(len(m), bool)
    glued[1:] = (gone[1:] & gone[:-1] == 1) & (a[1:] == a[:-1] + n[:-1]) & (faces[1:] >> 32 == faces[:-1] & 0xFFFFFFFF)
    head = np.flatnonzero(~glued)
    total = np.add.reduceat(n, head) if len(head) else n
    return a[head] << 32 | total * 2 + gone[head], at[head]


def repeated(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tid and marks: occurrences of paths that go, and stretches whose windows are to be counted."""
    own = met(docs, window).filter("branches or later")
    mark = F.struct(pack(F.col("a"), F.col("n") * 2 + (~F.col("branches")).cast("int")).alias("m"), F.col("faces").alias("f"))
    listed = own.select("doc_id", "tid", mark.alias("m")).groupBy("doc_id", "tid").agg(F.collect_list("m").alias("marks"))

    def compact(batches):
        for b in batches:
            marks = b.column(2)
            off = marks.offsets.to_numpy()
            m, f = (x.to_numpy(zero_copy_only=False) for x in marks.values.flatten())
            out = [compacted(m[i:j], f[i:j])[0] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            bound = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bound), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "tid", "marks"])

    return listed.mapInArrow(compact, "doc_id long, tid long, marks array<long>")


def paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The compacted nonbranching paths: run (of the first stretch), copies, windows, and doc_id and first window
    of the first occurrence.  Windows where the graph branches are no path's."""
    session(docs)
    own = met(_texts(docs), window).filter("not branches and not later")
    listed = own.groupBy("doc_id", "tid").agg(F.collect_list(F.struct(pack(F.col("a"), F.col("n") * 2 + 1).alias("m"), F.col("faces").alias("f"), "run", "c")).alias("marks"))

    def compact(batches):
        for b in batches:
            for doc, marks in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                m, f, run, c = (x.to_numpy(zero_copy_only=False) for x in marks.values.flatten())
                path, at = compacted(m, f)
                cols = [run[at], c[at], (path & 0xFFFFFFFF) >> 1, np.full(len(at), doc), path >> 32]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["run", "copies", "windows", "doc_id", "start"])

    return listed.mapInArrow(compact, "run long, copies long, windows long, doc_id long, start long")


def windows(joined: DataFrame, window: int) -> DataFrame:
    """Windows that are edges of their own: two hashes, doc_id, tid, start, and whether the document has it earlier."""

    def make(batches):
        for part in tv.slices(batches):
            w = tv.Words(part.column(1))
            marks = part.column(3)
            m = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            r = np.repeat(np.arange(part.num_rows), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            open_ = (m & 1) == 0
            m, r = m[open_], r[open_]
            n = (m & 0xFFFFFFFF) >> 1
            a = (m >> 32) + w.row[r]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n) + np.arange(int(n.sum()))
            r = np.repeat(r, n)
            order = np.argsort(at, kind="stable")
            at, r = at[order], r[order]
            if not len(at):
                continue
            h, h2 = (tv.Runs(w.hash, lane).of(at, window) for lane in (0, 1))
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), part.column(0).take(take), part.column(2).take(take), pa.array((at - w.row[r]).astype(np.int32)), pa.array(_nth(r, h))],
                ["h", "h2", "doc_id", "tid", "a", "again"],
            )

    return joined.mapInArrow(make, "h long, h2 long, doc_id long, tid long, a int, again boolean")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and tid, which tells apart rows that share an id, of all rows with an id.
    tid is never null, or joins on it would filter it differently and not share one exchange of the texts."""
    text = texts_of(docs).filter(F.col("doc_id").isNotNull())
    return text.withColumn("tid", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))


def removals(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, text, tid) and their covered word spans (doc_id, tid, spans as start << 32 | end)."""
    named = _texts(docs)
    marks = written(repeated(named, window), "marks", clean=True)
    some = F.exists("marks", lambda m: m.bitwiseAND(F.lit(1)) == 0)
    joined = named.join(hashed_side(marks).filter(some), ["doc_id", "tid"]).select("doc_id", "text", "tid", "marks")
    win = windows(joined, window)
    # One row of a document for each window; what it repeats itself is known already.
    first = win.groupBy("h", "h2").agg(F.min("doc_id").alias("doc0"), F.count("*").alias("c")).filter("c > 1").select(apart("h").alias("h"), apart("h2").alias("h2"), "doc0")
    late = win.join(first, ["h", "h2"]).filter((F.col("doc_id") != F.col("doc0")) | F.col("again")).select("doc_id", "tid", pack(F.col("a"), F.col("a") + window).alias("s"))
    size = F.shiftright(F.col("m").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    direct = marks.select("doc_id", "tid", F.explode("marks").alias("m")).filter(F.col("m").bitwiseAND(F.lit(1)) == 1)
    a = F.shiftright(F.col("m"), 32)
    direct = direct.select("doc_id", "tid", pack(a, a + size - 1 + window).alias("s"))
    spans = direct.unionByName(late).groupBy("doc_id", "tid").agg(F.collect_list("s").alias("spans"))
    return named, spans


def covered(w: tv.Words, spans: pa.Array) -> np.ndarray:
    """Which words of a slice the rows' spans cover."""
    s = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    r = np.repeat(np.arange(len(w.row) - 1), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, w.row[r] + (s >> 32), 1)
    np.add.at(step, w.row[r] + (s & 0xFFFFFFFF), -1)
    return np.cumsum(step[:-1]) > 0


def kept_bytes(w: tv.Words, drop: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each row, joined by one space; all rows together, and their bounds."""
    keep = np.flatnonzero(~drop)
    row = tv.row_of(w.row)[keep]
    more = np.zeros(len(keep), bool)
    more[:-1] = row[1:] == row[:-1]  # not the row's last kept word
    step = np.zeros(len(w.buf) + 2, np.int8)
    step[w.start[keep]] += 1
    np.add.at(step, w.end[keep] + more, -1)
    mask = np.cumsum(step[: len(w.buf)], dtype=np.int8) > 0
    out = np.where(tv.SPACE[w.buf], np.uint8(32), w.buf)[mask]
    total = np.concatenate([[0], np.cumsum(mask)])
    return out.tobytes(), total[w.off]


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text that stays, if asked for).

    A word goes if a window of words that covers it starts earlier: in a document of smaller
    id, or earlier in its own.  Null texts and texts without words: 0 words, the checksum of
    the empty string.  Rows without an id are compared with nothing and stay whole.  Repeated
    rows have the same place in the order, so neither goes for the other; each gives a row.
    An empty table gives no rows.
    """
    session(docs)
    named, spans = removals(docs, window)
    full = named.join(hashed_side(written(spans, "spans", clean=True)), ["doc_id", "tid"], "left").select("doc_id", "text", "spans")
    rest = texts_of(docs).filter(F.col("doc_id").isNull())
    full = full.unionByName(rest.withColumn("spans", F.lit(None).cast("array<long>")))

    def keep(batches):
        for part in tv.slices(batches):
            w = tv.Words(part.column(1))
            drop = covered(w, part.column(2))
            raw, bound = kept_bytes(w, drop)
            gone = np.concatenate([[0], np.cumsum(drop)])
            texts = [raw[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            cols = [part.column(0), pa.array(w.counts()), pa.array(gone[w.row[1:]] - gone[w.row[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([t.decode() for t in texts], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    return full.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
