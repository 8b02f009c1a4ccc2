"""Language identification of mixed-language text.

Words get a score for every learned language from a naive-Bayes model over byte trigrams.
The script of a word (told from the lead bytes of its UTF-8 form) narrows the candidates to
the languages that were seen in that script.  A Viterbi path over the words, with a penalty
for switching, labels spans; the document's language is the one with most letters in them.
Letters are code points that Unicode calls so, whatever bytes they take.

The path is found for all texts of a slice at once: blocks of words advance in step, each
as a max-plus matrix from entering to leaving states; the blocks are then chained.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkivist.llm import textvec as tv
from arkivist.llm.base import fold_crc, session, texts_of

TRIGRAM_BITS = 16
#: The fit takes at most so many documents of each language, chosen by a hash of the id, none longer than SAMPLE_CHARS.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
#: Of a language that has longer ones only, the fit takes so many of them, whole.
LONG_DOCS = 20
SWITCH = 10.0
#: How much better one word may score for one language than for another.
MOST_PER_WORD = 12.0
BLOCK = 128

_LETTERLESS = tv.NOT_ALNUM.copy()
_LETTERLESS[48:58] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32

# Scripts by UTF-8 lead byte.  0: ASCII or continuation, 1: Latin, 2: Greek,
# 3: Cyrillic, 4: Armenian, 5: Hebrew, 6: Arabic, 7: Indic and Thai, 8: other of E1,
# 9: kana and CJK, 10: Hangul, 11: beyond the basic plane.
N_SCRIPTS = 12
_SCRIPT = np.zeros(256, np.uint8)
for _a, _b, _s in ((0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD5, 4), (0xD6, 0xD7, 5), (0xD8, 0xDB, 6), (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE9, 9), (0xEA, 0xED, 10), (0xF0, 0xF4, 11)):
    _SCRIPT[_a : _b + 1] = _s


def words_of(arr: pa.Array) -> tv.Words:
    return tv.Words(arr, _LETTERLESS)


def trigrams(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte trigrams that end in each byte of a word, words in order, and their bounds by word."""
    size = w.end - w.start
    bound = np.concatenate([[0], np.cumsum(size)])
    inner = np.arange(bound[-1]) - np.repeat(bound[:-1], size)
    at = inner + np.repeat(w.start, size)
    low = _LOWER[w.buf]
    c = low[at]
    b = np.where(inner >= 1, low[at - 1], 32)
    a = np.where(inner >= 2, low[at - 2], 32)
    code = ((a << 16) | (b << 8) | c) * np.uint32(2654435761)
    return (code >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64), bound


def scripts(w: tv.Words) -> np.ndarray:
    """The script of each word: the highest-numbered one of its bytes; plain ASCII words are Latin."""
    if not len(w.start):
        return np.zeros(0, np.uint8)
    s = _SCRIPT[w.buf]
    cut = np.stack([w.start, w.end], axis=1).ravel()
    if cut[-1] == len(s):
        s = np.append(s, np.uint8(0))
    return np.maximum(np.maximum.reduceat(s, cut)[::2], 1)


def letter_counts(w: tv.Words) -> np.ndarray:
    """The letters of each word: ASCII ones, and of the other code points those that are alphabetic."""
    buf = w.buf
    is_letter = ~_LETTERLESS[buf] & (buf < 128)
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (padded[lead + k].astype(np.uint32) for k in range(4))
        two, three = ((b0 & 0x1F) << 6) | (b1 & 0x3F), ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
        four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
        code = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        seen, back = np.unique(code, return_inverse=True)
        is_letter[lead] = np.fromiter((chr(c).isalpha() for c in seen.tolist()), bool, len(seen))[back]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(is_letter, out=total[1:])
    return total[w.end] - total[w.start]


class Model:
    """Log-probabilities of trigrams by language, and the scripts each language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, seen: np.ndarray):
        self.langs = langs
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        self.table = np.ascontiguousarray(np.log(p).T.astype(np.float32))  # a row for each trigram
        share = seen / np.maximum(1, seen.sum(axis=1, keepdims=True))
        self.allowed = share.T >= 0.002  # a row for each script
        self.allowed |= ~self.allowed.any(axis=1, keepdims=True)

    def word_scores(self, w: tv.Words) -> np.ndarray:
        k = len(self.langs)
        if not len(w.start):
            return np.zeros((0, k), np.float32)
        code, bound = trigrams(w)
        s = np.add.reduceat(self.table[code], bound[:-1], axis=0)
        s = np.where(self.allowed[scripts(w)], s, -np.inf)
        s -= s.max(axis=1, keepdims=True)
        return np.maximum(s, -MOST_PER_WORD)


def viterbi(score: np.ndarray, fresh: np.ndarray, switch: float, block: int = BLOCK) -> np.ndarray:
    """The best state of each step; fresh steps begin a new sequence.  Ties keep the state, then take the first."""
    n, k = score.shape
    if not n or k == 1:
        return np.zeros(n, np.int64)
    nb = -(-n // block)
    s = np.zeros((nb * block, k), np.float32)
    s[:n] = score
    s = s.reshape(nb, block, k)
    pen = np.full(nb * block, switch, np.float32)
    pen[:n][fresh] = 0
    pen = pen.reshape(nb, block)
    v = np.full((nb, k, k), -1e9, np.float32)
    v[:, np.arange(k), np.arange(k)] = 0
    for t in range(block):
        best = v.max(axis=2) - pen[:, t, None]
        v = np.maximum(v, best[:, :, None]) + s[:, t, None, :]
    enter = np.zeros((nb, k))
    now = np.zeros(k)
    for b in range(nb):
        enter[b] = now
        now = (now[:, None] + v[b]).max(axis=0)
        now -= now.max()
    back = np.zeros((nb, block, k), np.int8 if k < 128 else np.int32)
    v = enter.astype(np.float32)
    own = np.arange(k)
    for t in range(block):
        top = v.argmax(axis=1)
        best = v[np.arange(nb), top] - pen[:, t]
        back[:, t] = np.where(v >= best[:, None], own, top[:, None])
        v = np.maximum(v, best[:, None]) + s[:, t]
    through = np.tile(own, (nb, 1))
    for t in range(block - 1, -1, -1):
        through = np.take_along_axis(back[:, t], through, axis=1)
    through = through.tolist()
    end = [0] * nb
    end[-1] = int(v[-1].argmax())
    for b in range(nb - 1, 0, -1):
        end[b - 1] = through[b][end[b]]
    path = np.zeros((nb, block), np.int64)
    cur, rows = np.array(end), np.arange(nb)
    for t in range(block - 1, -1, -1):
        path[:, t] = cur
        cur = back[rows, t, cur]
    return path.ravel()[:n]


def train(docs: DataFrame, trains) -> Model | None:
    """Counts of a bounded sample of each language; None without any labelled document."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & trains)
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    short = F.length("text") <= SAMPLE_CHARS
    sizes = own.groupBy("lang").agg(F.count(F.when(short, 1)).alias("short"), F.count("*").alias("n")).collect()  # as many as there are languages
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return None
    # Of each language somewhat more documents than wanted pass a bar for a hash of the id; the least hashes of these are taken.
    bars, only_long = {}, []
    for r in sizes:
        most, have = (SAMPLE_DOCS, r.short) if r.short else (LONG_DOCS, r.n)
        bars[r.lang] = min(1.0, 2.0 * (most + 20) / have)
        if not r.short:
            only_long.append(r.lang)
    allowed = short | F.col("lang").isin(only_long) if only_long else short
    bar = F.coalesce(*[F.when(F.col("lang") == x, F.lit(v)) for x, v in bars.items()])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.filter(allowed & (draw < bar)).select("lang", "doc_id", draw.alias("draw")).distinct()
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")  # about twice the sample of each language
    limit = F.when(F.col("lang").isin(only_long), LONG_DOCS).otherwise(SAMPLE_DOCS) if only_long else F.lit(SAMPLE_DOCS)
    ids = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("doc_id", "lang")
    chosen = own.filter(allowed & (draw < bar)).join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")  # bounded by the sample
    place = {x: i for i, x in enumerate(langs)}

    def count(batches):
        c, s = np.zeros((len(langs), 1 << TRIGRAM_BITS), np.int64), np.zeros((len(langs), N_SCRIPTS), np.int64)
        for part in tv.slices(batches):
            w = words_of(part.column(1))
            if not len(w.start):
                continue
            lang = np.repeat(np.array([place[x] for x in part.column(0).to_pylist()]), w.counts())
            code, bound = trigrams(w)
            np.add.at(c, (np.repeat(lang, np.diff(bound)), code), 1)
            np.add.at(s, (lang, scripts(w)), 1)
        both = np.concatenate([c, s], axis=1)
        a, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(both[a, b])], ["lang", "code", "n"])

    rows = chosen.mapInArrow(count, "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((len(langs), (1 << TRIGRAM_BITS) + N_SCRIPTS))
    both[rows["lang"].to_numpy(), rows["code"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, both[:, : 1 << TRIGRAM_BITS], both[:, 1 << TRIGRAM_BITS :])


def label(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (byte start, byte end, language).

    score is the share of the text's letters that are in spans of the language; ties go to the
    first language by name.  Null texts and texts without a letter: 'und', score 0.  Every row is labelled, repeated ones alike;
    an empty table gives no rows.  Only doc_id and text are read.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)  # 2 ** TRIGRAM_BITS numbers for each language

    def make(batches):
        m = shared.value
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
        for part in tv.slices(batches):
            w, n = words_of(part.column(1)), part.num_rows
            pred, top, spans = ["und"] * n, np.zeros(n), pa.array([[]] * n, pa.list_(kind))
            if m is not None and len(w.start):
                counts, row = w.counts(), tv.row_of(w.row)
                fresh = np.zeros(len(w.start), bool)
                fresh[w.row[:-1][counts > 0]] = True
                path = viterbi(m.word_scores(w), fresh, switch)
                k = len(m.langs)
                letters = np.bincount(row * k + path, letter_counts(w), n * k).reshape(n, k)
                best, all_ = letters.argmax(axis=1), letters.sum(axis=1)
                top = np.where(all_ > 0, letters[np.arange(n), best] / np.maximum(all_, 1), 0)
                pred = [m.langs[b] if a else "und" for a, b in zip(all_, best, strict=True)]
                edge = fresh.copy()
                edge[1:] |= path[1:] != path[:-1]
                a = np.flatnonzero(edge)
                z = np.append(a[1:], len(path)) - 1
                of = w.off[row[a]]
                names = pa.array(m.langs).take(pa.array(path[a]))
                flat = pa.StructArray.from_arrays([pa.array(w.start[a] - of), pa.array(w.end[z] - of), names], fields=list(kind))
                bounds = np.concatenate([[0], np.cumsum(np.bincount(row[a], minlength=n))])
                spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(top), spans], ["doc_id", "lang_pred", "score", "spans"])

    text = texts_of(docs)
    return text.mapInArrow(make, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans.  Documents with crc32(doc_id) mod folds = held are not learned from.

    Rows without an id: held_out is null, nothing is learned from them, they are labelled like any
    other.  Rows without a language or a text are not learned from.  Without any learned row, and
    for null texts and texts without a letter: 'und'.  Repeated rows give repeated results; an
    empty table gives no rows.
    """
    session(docs)
    model = train(docs, fold_crc("doc_id", folds) != held)
    return label(docs, model).select("doc_id", (fold_crc("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "spans")
