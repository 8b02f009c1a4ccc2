"""N-gram Jaccard join as a blocked sparse product of documents by shingles.

Overlaps are only accumulated where they can reach the bound:

1. *Columns.*  Two sets that reach the threshold share one of their first
   n - ceil(threshold * n) + 1 shingles in any order that all sets use.  The order is by hash,
   with the most frequent shingles last (those that were counted in lengthened prefixes of
   all documents; a bounded number of the most frequent ones), so that passages which many
   documents share stay out of the prefixes.
2. *Rows.*  Equal sets are one row.  Rows that share a prefix shingle are compared by size
   and by exclusive-or bitmaps: the bits that differ are no more than the shingles that
   differ, so the bound loses no pair.  Long lists are cut into pairs of chunks, and each
   gives a spanning forest of the pairs that pass, never all of them.
3. *Blocks.*  Rows that are connected by passing pairs meet with their whole sets in blocks
   (pairs of chunks where there are many), where a matrix product counts all overlaps, and
   the links found give a spanning forest again.
4. Connected components of the links, by contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm import textvec as tv
from arkivist.llm.base import apart, forget, hashed_side, session, texts_of, written
from arkivist.llm.graph import components

U64 = np.uint64
SHINGLE = 3
THRESHOLD = (90, 100)
#: At most so many frequent shingles are put last; shingles rarer than FREQUENT never are.
MOST_FREQUENT = 400_000
FREQUENT = 6
#: Rows of a chunk, and shingles in a chunk of whole sets.
CHUNK = 256
CHUNK_SHINGLES = 1 << 20
#: Runs up to this long are compared together with others.
SHORT = 16
COLUMNS = 8192
#: Bits of the widest bitmap.  It goes along with each prefix shingle, so the work of a long text stays in
#: proportion to its length; beyond some ten thousand shingles it holds back less, and loses no pair either.
WIDEST = 13


def prefix_size(n, threshold):
    num, den = threshold
    return n - (num * n + den - 1) // den + 1


def shingle_sets(w: tv.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than k are one shingle."""
    at, g = w.grams(k)
    bound = np.searchsorted(at, w.row)
    out = []
    for r in range(len(w.row) - 1):
        if bound[r + 1] > bound[r]:
            out.append(np.unique(g[bound[r] : bound[r + 1]]))
        elif (n := int(w.row[r + 1] - w.row[r])) > 0:
            h = np.array([n], U64)
            for x in w.hash[w.row[r] : w.row[r + 1]]:
                h = tv.mix(h * U64(0x9E3779B97F4A7C15) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits: about one bit for a shingle, 64 at least and 2 ** WIDEST at most."""
    bits = 1 << min(WIDEST, max(6, int(len(s) * 3 // 4).bit_length()))
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    bound = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(bound), pa.array(flat.view(np.int64)))


def frequent(docs: DataFrame, k: int, threshold) -> np.ndarray:
    """The most frequent shingles among all documents' lengthened prefixes, sorted."""

    def first(batches):
        for part in tv.slices(batches):
            own = [s[: (p := prefix_size(len(s), threshold)) + p // 3 + 3] for s in shingle_sets(tv.Words(part.column(1), lower=True), k)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["token"])

    many = written(docs.mapInArrow(first, "token long").groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") >= FREQUENT), "frequent")
    # Powers of two: a row for each, about 60 at most.
    sizes = {r.p: r.n for r in many.groupBy(F.floor(F.log2("df")).alias("p")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, 1 << 62
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > MOST_FREQUENT:
            break
        least = 1 << p
    out = np.sort(many.filter(F.col("df") >= least).select("token").toArrow()["token"].to_numpy().view(U64)) if sizes else np.zeros(0, U64)
    forget(many)
    return out


PROFILE = "doc_id long, n long, s1 long, s2 long, prefix array<long>, bits binary"


def profiles(docs: DataFrame, k: int, threshold, last: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(last)  # MOST_FREQUENT hashes at most

    def make(batches):
        last = shared.value
        for part in tv.slices(batches):
            sets = shingle_sets(tv.Words(part.column(1), lower=True), k)
            flat = np.concatenate(sets)
            low = np.zeros(len(flat), bool)
            if len(last) and len(flat):
                low = last[np.minimum(np.searchsorted(last, flat), len(last) - 1)] == flat
            bound = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            prefix, bits, s1, s2 = [], [], [], []
            for s, a, b in zip(sets, bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                f = low[a:b]
                p = prefix_size(len(s), threshold) if len(s) else 0
                prefix.append(np.concatenate([s[~f][:p], s[f][:p]])[:p] if f.any() else s[:p])
                bits.append(bitmap(s) if len(s) else b"")
                s1.append(int(s.sum(dtype=U64)))
                s2.append(int(tv.mix(s).sum(dtype=U64)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bound)), pa.array(np.array(s1, U64).view(np.int64)), pa.array(np.array(s2, U64).view(np.int64)), _longs(prefix), pa.array(bits, pa.binary())],
                ["doc_id", "n", "s1", "s2", "prefix", "bits"],
            )

    return docs.mapInArrow(make, PROFILE)


def forest(adj: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a graph given by its symmetric matrix."""
    seen = np.zeros(len(adj), bool)
    a, b = [], []
    for root in np.flatnonzero(adj.any(axis=1)).tolist():
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(adj[x] & ~seen).tolist()
            seen[new] = True
            a += [x] * len(new)
            b += new
            todo += new
    return a, b


class Bitmaps:
    """Bitmaps of several widths, compared by folding the wider one."""

    def __init__(self, col: pa.Array, n: np.ndarray, threshold):
        self.n, (self.num, self.den) = n, threshold
        raw, off = tv.string_bytes(col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col)
        size = np.diff(off)
        self.width = size // 8
        self.place = np.zeros(len(n), np.int64)
        self.by = {}
        for wd in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == wd)
            self.place[rows] = np.arange(len(rows))
            self.by[wd] = raw[(off[rows][:, None] + np.arange(wd * 8)[None, :])].view("<u8")

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows can reach the threshold."""
        na, nb = self.n[a], self.n[b]
        ok = self.den * np.minimum(na, nb) >= self.num * np.maximum(na, nb)
        i = np.flatnonzero(ok)
        swap = self.width[a[i]] > self.width[b[i]]
        x, y = np.where(swap, b[i], a[i]), np.where(swap, a[i], b[i])
        wx, wy = self.width[x], self.width[y]
        for u, v in {(p, q) for p, q in zip(wx.tolist(), wy.tolist(), strict=True)} if len(i) else ():
            j = np.flatnonzero((wx == u) & (wy == v))
            right = self.by[v][self.place[y[j]]]
            while right.shape[1] > u:
                half = right.shape[1] // 2
                right = right[:, :half] ^ right[:, half:]
            differ = np.bitwise_count(self.by[u][self.place[x[j]]] ^ right).sum(axis=1, dtype=np.int64)
            ok[i[j]] = (self.den + self.num) * differ <= (self.den - self.num) * (self.n[x[j]] + self.n[y[j]])
        return ok


def runs(batches, keys: list[str]):
    """Batches of whole runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(b.schema.get_field_index(c)).to_numpy() for c in keys]
        new = np.zeros(b.num_rows, bool)
        for c in k:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        same = held and all(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() == x[0] for c, x in zip(keys, k, strict=True))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if not len(cuts):
            held.append(b)
            continue
        if held:
            yield pa.Table.from_batches([*held, b.slice(0, cuts[0])])
            b, cuts = b.slice(cuts[0]), cuts - cuts[0]
        if cuts[-1]:
            yield pa.Table.from_batches([b.slice(0, cuts[-1])])
        held = [b.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long"


def _edges(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bounds(cols: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(cols[0]))


def passing(rows: DataFrame, threshold) -> DataFrame:
    """Spanning edges of the pairs that pass, from rows (token, i, j, c, rep, n, bits) sorted by token, i, j."""

    def find(batches):
        for t in runs(batches, ["token", "i", "j"]):
            t = t.combine_chunks()
            col = {c: t.column(c).to_numpy() for c in ("token", "i", "j", "c", "rep", "n")}
            bound = _bounds([col["token"], col["i"], col["j"]])
            size = np.diff(bound)
            bits = Bitmaps(t.column("bits").chunk(0), col["n"], threshold)
            out_a, out_b = [], []
            for m in np.unique(size[(size > 1) & (size <= SHORT)]).tolist():
                head = bound[:-1][size == m]
                x, y = np.triu_indices(m, 1)
                a, b = (head[:, None] + x).ravel(), (head[:, None] + y).ravel()
                ok = bits.passes(a, b)
                out_a.append(col["rep"][a[ok]])
                out_b.append(col["rep"][b[ok]])
            for s, e in zip(bound[:-1][size > SHORT].tolist(), bound[1:][size > SHORT].tolist(), strict=True):
                adj = np.zeros((e - s, e - s), bool)
                x, y = np.triu_indices(e - s, 1)
                if col["i"][s] != col["j"][s]:  # each chunk for itself is another block
                    apart = col["c"][s + x] != col["c"][s + y]
                    x, y = x[apart], y[apart]
                ok = bits.passes(s + x, s + y)
                adj[x[ok], y[ok]] = adj[y[ok], x[ok]] = True
                a, b = forest(adj)
                out_a.append(col["rep"][s:e][a])
                out_b.append(col["rep"][s:e][b])
            if out_a:
                yield _edges(np.concatenate(out_a), np.concatenate(out_b))

    return rows.mapInArrow(find, EDGES)


def _blocked(rows: DataFrame, *keys: str) -> DataFrame:
    """Each row once for every block of its chunk c out of chunks; dealt out and sorted by keys, i and j."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o")
    out = rows.select("*", each).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).drop("o", "chunks")
    return out.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: the product of the incidence matrix with itself, by blocks of columns that two rows share."""
    size = [len(s) for s in sets]
    row = np.repeat(np.arange(len(sets)), size)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    live = n[col] > 1
    row, col = row[live], (np.cumsum(n > 1) - 1)[col[live]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (start, start + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        out += m @ m.T
    return out


def links(rows: DataFrame, threshold) -> DataFrame:
    """Spanning edges of the links, from rows (cluster, i, j, c, rep, shingles) sorted by cluster, i, j."""
    num, den = threshold

    def find(batches):
        for t in runs(batches, ["cluster", "i", "j"]):
            t = t.combine_chunks()
            rep, i, j, c = (t.column(x).to_numpy() for x in ("rep", "i", "j", "c"))
            bound = _bounds([t.column("cluster").to_numpy(), i, j])
            lists = t.column("shingles").chunk(0)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
            out_a, out_b = [], []
            for s, e in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                n = off[s + 1 : e + 1] - off[s:e]
                both = overlaps([flat[off[r] : off[r + 1]] for r in range(s, e)])
                adj = den * both >= num * (n[:, None] + n[None, :] - both)
                if i[s] != j[s]:
                    adj &= c[s:e, None] != c[None, s:e]
                np.fill_diagonal(adj, False)
                a, b = forest(adj)
                out_a.append(rep[s:e][a])
                out_b.append(rep[s:e][b])
            if out_a:
                yield _edges(np.concatenate(out_a), np.concatenate(out_b))

    return rows.mapInArrow(find, EDGES)


def whole_sets(docs: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """rep, cluster, chunks, c, shingles of the documents named by (rep, cluster, chunks, c)."""

    def make(batches):
        for part in tv.slices(batches):
            sets = shingle_sets(tv.Words(part.column(0), lower=True), k)
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in range(1, 5)), _longs(sets)], ["rep", "cluster", "chunks", "c", "shingles"])

    own = docs.join(hashed_side(named), docs["doc_id"] == named["rep"]).select("text", "rep", "cluster", "chunks", "c")
    return own.mapInArrow(make, "rep long, cluster long, chunks long, c long, shingles array<long>")


def _chunked(members: DataFrame, key: str, size) -> DataFrame:
    """members with chunks (by the key's size) and their own chunk c, a hash of rep."""
    sizes = members.groupBy(key).agg(F.count("*").alias("k"), size.alias("chunks")).filter("k > 1").select(apart(key).alias(key), "chunks")
    return members.join(sizes, key).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of documents.

    Two documents link when the overlap is at least threshold of the union of their sets of
    k-word shingles.  Texts without words and null texts have no set and are linked with
    nothing.  Rows without an id are linked with nothing, and their component is null; rows
    of one id are one document.  Repeated rows give repeated results; an empty table none.
    """
    session(docs)
    text = texts_of(docs)
    named = text.filter(F.col("doc_id").isNotNull())
    seen = written(profiles(text, k, threshold, frequent(named, k, threshold)), "profiles")
    own = seen.filter("doc_id is not null and n > 0")
    classes = own.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = written(classes, "classes")
    posts = classes.select(F.explode("prefix").alias("token"), "rep")
    shared = written(_chunked(posts, "token", F.ceil(F.count("*") / F.lit(CHUNK))).select("token", "rep", "chunks", "c"), "postings")
    facing = shared.join(hashed_side(classes).select("rep", "n", "bits"), "rep")
    near = passing(_blocked(facing, "token"), threshold)
    cluster = components(near).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    cluster = written(cluster.join(classes.select("rep", "n"), "rep"), "clusters")
    chunks = F.greatest(F.ceil(F.count("*") / F.lit(CHUNK)), F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)))
    blocks = written(_chunked(cluster, "cluster", chunks).select("rep", "cluster", "chunks", "c").distinct(), "blocks")
    found = links(_blocked(whole_sets(named, blocks, k), "cluster"), threshold)
    linked = components(found).select(F.col("id").alias("rep"), "component")
    for table in (shared, cluster, blocks):
        forget(table)
    member = own.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
    member = member.join(linked, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    # one id may stand for several rows: its smallest component, for all of them
    member = member.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = seen.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
