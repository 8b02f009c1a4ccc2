"""Best-two-fit packing of token sequences.

1. Texts are tokenised once, by words: the tokenizer splits at white space, so the ids of
   a text are the ids of its words in order.  A worker keeps the ids of the words it has
   seen in sorted arrays of bounded size and asks the tokenizer for new words only.
2. Packing needs lengths, not documents.  Counts of pieces by length (at most ``capacity``
   numbers, however large the corpus) are packed as patterns with multiplicities: a bin
   takes the largest length that fits until none does; then its smallest piece gives way to
   the two remaining lengths that fill the widened gap best, if they fill it better.  A
   pattern is repeated while the counts last, which is the same as packing bin after bin.
3. Pieces are sorted by length in range partitions, which cut a frequent length like any other
   run; a piece's number among those of its length is its place in the partition plus what the
   partitions before have of the length.  The number finds the pattern, bin and offset by binary
   search in the pattern table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm import textvec as tv
from arkivist.llm.base import session, texts_of, written

#: Words whose ids a worker remembers.
CACHE_WORDS = 1_500_000
LEARN_AT_ONCE = 2048
#: Slices with longer words than this are tokenised text by text.
MOST_WORD_BYTES = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _merge(a, b):
    """Two sorted parts as one."""
    to = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
    old = np.ones(len(a[0]) + len(b[0]), bool)
    old[to] = False
    out = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(len(old), x.dtype)
        z[old], z[to] = x, y
        out.append(z)
    return tuple(out)


class WordIds:
    """Token ids of words, found by 64-bit hashes of their bytes.

    Hashes are kept sorted in two parts: most of them, and those learned lately, which are
    merged in when they have become a quarter.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self._clear()

    def _clear(self):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint16))
        self.parts = [none, none]  # (hashes, where the ids begin, how many)
        self.flat = np.zeros(1 << 16, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def known(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: sorted and new."""
        at, size = [], []
        for i in range(0, len(words), LEARN_AT_ONCE):
            for e in self.tok.encode_batch_fast(words[i : i + LEARN_AT_ONCE], add_special_tokens=False):
                ids = e.ids
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat) // 2), self.flat.dtype)])
                self.flat[self.used : self.used + len(ids)] = ids
                at.append(self.used)
                size.append(len(ids))
                self.used += len(ids)
        self.parts[1] = _merge(self.parts[1], (hashes, np.array(at, np.int32), np.array(size, np.uint16)))
        if 4 * len(self.parts[1][0]) > len(self.parts[0][0]):
            self.parts = [_merge(*self.parts), tuple(x[:0] for x in self.parts[1])]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, at, size = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for keys, begin, count in self.parts:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == hashes)
                known[hit], at[hit], size[hit] = True, begin[place[hit]], count[place[hit]]
        return known, at, size

    def ids(self, w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a slice in order, and their bounds by row."""
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(len(w.row), np.int64)
        if int((w.end - w.start).max()) > MOST_WORD_BYTES:
            return self._plain(w)
        uniq, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        known, at, size = self._find(uniq)
        if not known.all():
            new = np.flatnonzero(~known)
            if self.known() + len(new) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(uniq))
                if len(new) > CACHE_WORDS:
                    return self._plain(w)
            raw = w.buf.tobytes()
            self._learn(uniq[new], [raw[a:b].decode("utf-8") for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            _, at, size = self._find(uniq)
        at, size = at[back], size[back]
        bound = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.arange(bound[-1]) - np.repeat(bound[:-1] - at, size)]
        return out, bound[w.row]

    def _plain(self, w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """Without memory, for a slice with more or longer words than it may hold."""
        raw = w.buf.tobytes()
        rows = [self.tok.encode(raw[a:b].decode("utf-8"), add_special_tokens=False).ids for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)]
        bound = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return np.fromiter((i for r in rows for i in r), np.uint32, int(bound[-1])), bound


_words: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One memory for each Python worker, kept between its tasks."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and the end id, cut every capacity ids."""

    def cut(batches):
        words = _word_ids(tokenizer)
        for part in tv.slices(batches):
            ids, bound = words.ids(tv.Words(part.column(1)))
            cols = [[], [], [], [], []]
            for doc, a, b in zip(part.column(0).to_pylist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    x = own[s : s + capacity]
                    for c, v in zip(cols, (doc, k, s, len(x), zlib.crc32(x.tobytes())), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(cut, PIECE)


def two_fit_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths in a bin, number of such bins) until all counts are used."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    out = []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return out
        own: dict[int, int] = {}
        gap = capacity
        while True:
            at = int(np.searchsorted(sizes, gap, "right")) - 1
            while at >= 0 and own.get(int(sizes[at]), 0) >= left[sizes[at]]:
                at -= 1
            if at < 0:
                break
            s = int(sizes[at])
            n = int(min(gap // s, left[s] - own.get(s, 0)))
            own[s] = own.get(s, 0) + n
            gap -= n * s
        if gap and sum(own.values()) > 1:
            small = min(own)
            own[small] -= 1
            if not own[small]:
                del own[small]
            wide = gap + small
            free = left.copy()
            for k, v in own.items():
                free[k] -= v
            a = np.flatnonzero(free[: wide + 1])
            # for each first length the largest second one that fits beside it
            at = np.searchsorted(a, wide - a, "right") - 1
            ok = at >= 0
            a1, a2 = a[ok], a[at[ok]]
            alone = (a1 == a2) & (free[a1] < 2)
            lower = at[ok] - 1
            a2 = np.where(alone, np.where(lower >= 0, a[np.maximum(lower, 0)], 0), a2)
            total = np.where(a2 > 0, a1 + a2, 0)
            best = int(np.argmax(total)) if len(total) else 0
            if len(total) and total[best] > small:
                for x in (int(a1[best]), int(a2[best])):
                    own[x] = own.get(x, 0) + 1
            else:
                own[small] = own.get(small, 0) + 1
        times = int(min(left[k] // v for k, v in own.items()))
        for k, v in own.items():
            left[k] -= v * times
        out.append((own, times))


def pattern_table(patterns) -> dict[int, np.ndarray]:
    """By length: rows of (first number, pieces in a bin, first bin, offset in the bin)."""
    seen: dict[int, int] = {}
    rows: dict[int, list] = {}
    bins = 0
    for own, times in patterns:
        offset = 0
        for length in sorted(own, reverse=True):
            n = own[length]
            rows.setdefault(length, []).append((seen.get(length, 0), n, bins, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        bins += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def best_two_fit(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs all documents into sequences of at most capacity ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (in ids).  Null or
    empty text: one piece that is the end id alone.  Rows without an id are packed like any
    other, and their pieces have none.  Longer documents than capacity are cut
    every capacity ids.  Repeated rows are packed one by one; an empty table gives no rows.
    """
    session(docs)
    return place(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def place(made: DataFrame, capacity: int) -> DataFrame:
    order = ["length", "doc_id", "piece", "ids_crc32"]
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = made.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    # A partition holds successive lengths: capacity lengths and as many partitions are the most rows.
    groups = placed.groupBy("length", F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for g in sorted(groups):
        base[g.length, g.part] = counts.get(g.length, 0) - g.first
        counts[g.length] = counts.get(g.length, 0) + g.n
    table = pattern_table(two_fit_patterns(counts, capacity))
    shared = made.sparkSession.sparkContext.broadcast((table, base))  # bounded by capacity and the number of partitions

    def assign(batches):
        table, base = shared.value
        for b in batches:
            length, at = b.column("length").to_numpy(), b.column("at").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                n = at[own] + np.fromiter((base[k, p] for p in (at[own] >> 33).tolist()), np.int64, len(own))
                t = table[k]
                hit = t[np.searchsorted(t[:, 0], n, "right") - 1]
                inner = n - hit[:, 0]
                seq[own] = hit[:, 2] + inner // hit[:, 1]
                off[own] = hit[:, 3] + inner % hit[:, 1] * k
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(assign, PIECE + ", sequence_id long, offset long")
