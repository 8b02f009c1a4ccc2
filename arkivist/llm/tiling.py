"""Benchmark decontamination by greedy string tiling.

The runs of ``MIN_MATCH`` words of items and documents are hashed (running Karp-Rabin hashes) and
joined in Spark.  An item counts as leaked when tiles cover at least ``COVERAGE`` of its words.
Of an item those runs are left out of the join that most items share, as long as they cover less
than that together: no document can leak the item by them alone.  So a phrase that thousands of items
share makes no candidates, and no leak is lost.

Documents and items that met are tiled.  Seeds in a line are maximal matches.  The longest match
is marked as a tile, what it overlaps is cut down to the unmarked rest, and so on until no match of
MIN_MATCH words is left: the order of the passages in the document does not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm import textvec as tv
from arkivist.llm.base import apart, session, texts_of, written

MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of hashes by which the documents' runs are sifted before they are shuffled.
FILTER_BITS = 22
#: Sets of items that a worker keeps ready.
KEPT_SEEDS = 256


class Seeds:
    """Runs of words of some items: sorted hashes, and where each occurs."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        w = tv.Words(pa.array(texts, pa.string()), tv.NOT_ALNUM, lower=True)
        self.ids, self.words = ids, w.counts()
        self.by: dict[int, tuple] = {}
        row = tv.row_of(w.row)
        # items shorter than k are looked for as a whole
        for size in sorted({min(k, n) for n in self.words.tolist() if n}):
            at, g = tv.rolling(w.hash, w.row, size)
            fit = self.words[row[at]] >= k if size == k else self.words[row[at]] == size
            at, g = at[fit], g[fit]
            order = np.argsort(g, kind="stable")
            keys, first = np.unique(g[order], return_index=True)
            self.by[size] = (keys, np.append(first, len(g)), row[at[order]], at[order] - w.row[row[at[order]]])

    def meet(self, w: tv.Words):
        """(row, item, place in the row, place in the item, size) of all seeds of a slice."""
        out = []
        for size, (keys, bound, item, place) in self.by.items():
            at, g = tv.rolling(w.hash, w.row, size)
            if not len(g) or not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            ok = keys[k] == g
            at, k = at[ok], k[ok]
            n = bound[k + 1] - bound[k]
            src = np.repeat(bound[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            row = np.searchsorted(w.row, at, "right") - 1
            out.append((row, item[src], at - w.row[row], place[src], np.full(len(at), size)))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def matches(doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in the item, place in the document) of seeds of one size."""
    order = np.lexsort((doc, doc - item))
    d, i = doc[order], item[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] - i[1:] != d[:-1] - i[:-1]) | (d[1:] != d[:-1] + 1)
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(d))) + size - 1
    return list(zip(n.tolist(), i[a].tolist(), d[a].tolist(), strict=True))


def tiles(found: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, length), longest first; ties to earlier places."""
    heap = [(-n, i, d) for n, i, d in found]
    heapq.heapify(heap)
    items: set[int] = set()
    docs: set[int] = set()
    out = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [i + x not in items and d + x not in docs for x in range(n)]
        if all(free):
            out.append((i, d, n))
            items.update(range(i, i + n))
            docs.update(range(d, d + n))
            continue
        x = 0
        while x < n:
            y = x
            while y < n and free[y]:
                y += 1
            if y - x >= least:
                heapq.heappush(heap, (x - y, i + x, d + x))
            x = y + 1
    return out


def leaks(texts: pa.Array, seeds: Seeds, coverage: float) -> list[tuple]:
    """(row, item id, words of the item, matched, number of tiles, coverage, tiles) of all leaks into the texts."""
    w = tv.Words(texts, tv.NOT_ALNUM, lower=True)
    met = seeds.meet(w)
    if met is None:
        return []
    row, item, d, i, size = met
    order = np.lexsort((item, row))
    row, item, d, i, size = (c[order] for c in (row, item, d, i, size))
    cut = np.ones(len(row), bool)
    cut[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    bound = np.append(np.flatnonzero(cut), len(row))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        n, k = int(seeds.words[item[a]]), int(size[a])
        reach = np.unique((np.unique(i[a:b])[:, None] + np.arange(k)).ravel())
        if len(reach) < coverage * n:  # no tiling covers more than the seeds touch
            continue
        t = tiles(matches(d[a:b], i[a:b], k), k)
        got = sum(x[2] for x in t)
        if got >= coverage * n:
            out.append((int(row[a]), seeds.ids[item[a]], n, got, len(t), got / n, [{"item": x, "doc": y, "words": z} for x, y, z in sorted(t)]))
    return out


OUT = "doc_id long, item_id long, item_words long, matched long, n_tiles long, coverage double, tiles array<struct<item: long, doc: long, words: long>>"


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_text and iid, which tells apart items that share an id."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).filter("item_id is not null and item_text is not null")
    return own.distinct().withColumn("iid", F.xxhash64("item_text"))


def _item_runs(items: DataFrame, k: int, coverage: float) -> DataFrame:
    """size, g, item_id, iid: of each item the runs that are to be joined."""

    def make(batches):
        for part in tv.slices(batches, "item_text"):
            w = tv.Words(part.column(1), tv.NOT_ALNUM, lower=True)
            words = w.counts()
            row = tv.row_of(w.row)
            for size in sorted({min(k, n) for n in words.tolist() if n}):  # items shorter than k are looked for as a whole
                at, g = tv.rolling(w.hash, w.row, size)
                fit = words[row[at]] >= k if size == k else words[row[at]] == size
                at, g = at[fit], g[fit]
                r = row[at]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size, np.int32)), pa.array(g.view(np.int64)), part.column(0).take(take), part.column(2).take(take), pa.array(at - w.row[r]), pa.array(words[r])],
                    ["size", "g", "item_id", "iid", "place", "words"],
                )

    def choose(t: pa.Table) -> pa.Table:
        """Runs of one item: the commonest ones that cover too little are left out."""
        size, words = t.column("size")[0].as_py(), t.column("words")[0].as_py()
        place, df = t.column("place").to_numpy(), t.column("df").to_numpy()
        covered, keep = np.zeros(words, bool), np.ones(t.num_rows, bool)
        for i in np.lexsort((place, -df)).tolist():
            span = covered[place[i] : place[i] + size]
            if covered.sum() + size - span.sum() < coverage * words:
                span[:] = True
                keep[i] = False
        return t.filter(pa.array(keep)).select(["size", "g", "item_id", "iid"])

    runs = items.select("item_id", "item_text", "iid").mapInArrow(make, "size int, g long, item_id long, iid long, place long, words long")
    df = runs.groupBy("size", "g").agg(F.count("*").alias("df")).select("size", apart("g").alias("g"), "df")
    own = runs.join(df, ["size", "g"]).groupBy("item_id", "iid").applyInArrow(choose, "size int, g long, item_id long, iid long")  # the runs of one item
    return own.distinct()


def _candidates(text: DataFrame, benchmark: DataFrame, k: int, coverage: float) -> DataFrame:
    """tid (of a text) and items (structs of item_id and item_text): a row for each text that may hold a leak."""
    spark = text.sparkSession
    items = _items(benchmark)
    runs = written(_item_runs(items, k, coverage), "item-runs")
    # 2 ** FILTER_BITS numbers of each size at most
    some = runs.select("size", F.shiftrightunsigned("g", 64 - FILTER_BITS).cast("int").alias("bits")).distinct().toArrow()
    sieve: dict[int, np.ndarray] = {}
    for size in np.unique(some["size"].to_numpy()).tolist():
        sieve[size] = np.zeros(1 << FILTER_BITS, bool)
        sieve[size][some["bits"].to_numpy()[some["size"].to_numpy() == size]] = True
    shared = spark.sparkContext.broadcast(sieve)

    def sift(batches):
        for part in tv.slices(batches):
            w = tv.Words(part.column(0), tv.NOT_ALNUM, lower=True)
            row = tv.row_of(w.row)
            for size, maybe in shared.value.items():
                at, g = tv.rolling(w.hash, w.row, size)
                hit = np.flatnonzero(maybe[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                if not len(hit):
                    continue
                both = np.unique(np.stack([row[at[hit]].astype(np.uint64), g[hit]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), size, np.int32)), pa.array(both[:, 1].view(np.int64)), part.column(1).take(pa.array(both[:, 0].astype(np.int64)))], ["size", "g", "tid"])

    seeds = text.filter(F.col("text").isNotNull()).select("text", "tid").mapInArrow(sift, "size int, g long, tid long")
    pairs = seeds.join(runs, ["size", "g"]).select("tid", "item_id", "iid").distinct()
    own = pairs.select(apart("tid").alias("tid"), "item_id", "iid").join(items, ["item_id", "iid"])
    return written(own.groupBy("tid").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")), "candidates")


def _met(docs: DataFrame, benchmark: DataFrame, k: int, coverage: float) -> DataFrame:
    """doc_id, text, tid and items of the texts that may hold a leak."""
    text = texts_of(docs).withColumn("tid", F.xxhash64("text"))
    return text.join(_candidates(text, benchmark, k, coverage), "tid").select("doc_id", "text", "tid", "items")


def _tiler(k: int):
    """Leaks of one text and its items; sets of items are laid out once."""
    kept: dict[tuple, Seeds] = {}

    def of(text: pa.Array, items: list[dict], coverage: float) -> list[tuple]:
        key = tuple(sorted((x["item_id"], x["item_text"]) for x in items))
        if key not in kept:
            if len(kept) >= KEPT_SEEDS:
                kept.clear()
            kept[key] = Seeds([i for i, _ in key], [t for _, t in key], k)
        return leaks(text, kept[key], coverage)

    return of


def tile(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that leaked into it: doc_id, item_id, item_words,
    matched (words), n_tiles, coverage, tiles (places and lengths in words).

    Words are runs of letters and digits, lower-cased in ASCII.  Items shorter than min_match
    words must occur whole.  Null and empty texts on either side match nothing, nor do items
    without an id; rows without a doc_id are compared and keep their null.  Repeated
    documents repeat their rows; items that share an id are items of their own.  Empty
    tables give no rows.
    """
    session(docs)

    def find(batches):
        tiled = _tiler(min_match)
        kind = pa.list_(pa.struct([("item", pa.int64()), ("doc", pa.int64()), ("words", pa.int64())]))
        for b in batches:
            for r in range(b.num_rows):
                out = tiled(b.column(1).slice(r, 1), b.column(3)[r].as_py(), coverage)
                if out:
                    c = list(zip(*out, strict=True))
                    ids = b.column(0).take(pa.array([r] * len(out)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in c[1:5]), pa.array(c[5], pa.float64()), pa.array(c[6], kind)], ["doc_id", "item_id", "item_words", "matched", "n_tiles", "coverage", "tiles"])

    return _met(docs, benchmark, min_match, coverage).mapInArrow(find, OUT)


def leaked_texts(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """tid, the xxhash64 of each text that holds a leak: a written table."""
    session(docs)

    def find(batches):
        tiled = _tiler(min_match)
        for b in batches:
            hit = [r for r in range(b.num_rows) if tiled(b.column(1).slice(r, 1), b.column(3)[r].as_py(), coverage)]
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(hit, pa.int64()))], ["tid"])

    return written(_met(docs, benchmark, min_match, coverage).mapInArrow(find, "tid long").distinct(), "leaks")
