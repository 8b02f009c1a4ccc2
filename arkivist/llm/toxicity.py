"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from a linear model over
hashed words; the document's probability is their noisy-or, 1 - prod(1 - p).  Only documents
are labelled: the likelihood of the document labels is maximised through the noisy-or, so
the model learns by itself which sentences carry the label, and afterwards names them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm import textvec as tv
from arkivist.llm.base import fold_crc, session, texts_of, written

FEATURE_BITS = 20
#: The fit takes at most so many labelled documents of each class, chosen by a hash of the id ...
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: ... and none longer than this; beside them a few long ones, whose many sentences must not add up.
SAMPLE_CHARS = 8_000
LONG_TOXIC, LONG_CLEAN, LONG_CHARS = 100, 300, 60_000
MIN_DOCS = 8
FIT_AT_ONCE = 1 << 20
#: Inflected words share these many first bytes.
PREFIXES = (4, 6, 8)

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentences(w: tv.Words) -> np.ndarray:
    """Bounds, in words, of the sentences of a slice; each row has its own."""
    n = len(w.hash)
    if not n:
        return np.zeros(1, np.int64)
    stops = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(_STOP[w.buf], out=stops[1:])
    new = np.ones(n, bool)
    new[1:] = stops[w.start[1:]] != stops[w.end[:-1]]
    new[w.row[:-1][np.diff(w.row) > 0]] = True
    return np.append(np.flatnonzero(new), n)


def features(w: tv.Words) -> np.ndarray:
    """A row for each word: its own feature and those of its prefixes; 0 where it is too short."""
    f = np.stack([w.hash, *(w.prefixes(k) for k in PREFIXES)], axis=1)
    return (f >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, trains) -> DataFrame:
    """The labelled documents of the fit: a bounded number of each class."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & trains)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    length = F.length("text")
    sizes = texts_of(docs).select("doc_id", length.alias("n")).filter(F.col("n") <= LONG_CHARS)
    own = written(own.join(sizes, "doc_id"), "labelled")
    ids = [
        own.filter((F.col("y") == y) & ((F.col("n") > SAMPLE_CHARS) == long)).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for y, long, most in ((1, False, SAMPLE_TOXIC), (0, False, SAMPLE_CLEAN), (1, True, LONG_TOXIC), (0, True, LONG_CLEAN))
    ]
    chosen = reduce(DataFrame.unionByName, ids).distinct()  # bounded by the limits
    return texts_of(docs).filter(length <= LONG_CHARS).join(F.broadcast(chosen), "doc_id").select("text", "y")


def bags(chosen: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, sentence bounds, label) of each document of the sample."""

    def make(batches):
        for part in tv.slices(batches, "text"):
            w = tv.Words(part.column(0), tv.NOT_ALNUM, lower=True)
            f, s = features(w).astype(np.int32), sentences(w)
            out = []
            for a, b in zip(w.row[:-1].tolist(), w.row[1:].tolist(), strict=True):
                own = s[np.searchsorted(s, a) : np.searchsorted(s, b)]
                out.append((f[a:b].tobytes(), (own - a).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), part.column(1).cast(pa.int32())], ["f", "s", "y"])

    rows = chosen.mapInArrow(make, "f binary, s binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r.f), bytes(r.s), r.y))
    return [(np.frombuffer(r.f, np.int32).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(r.s, np.int32), r.y) for r in rows]


def fit(data, steps: int = 200, rate: float = 0.1, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights of the hashed words and the bias, by Adam on the noisy-or likelihood.  The list is used up."""
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    data[:] = [d for d in data if len(d[0])]
    y = np.array([d[2] for d in data], float)
    if not len(data) or y.min() == y.max():
        return weights, (3.0 if len(data) and y.min() == 1 else -8.0)
    seen = np.zeros(1 << FEATURE_BITS, np.int32)
    for d in data:
        seen[np.unique(d[0])] += 1
    seen[0] = 0
    kept = np.flatnonzero(seen >= MIN_DOCS)
    place = np.full(1 << FEATURE_BITS, -1, np.int32)  # rare features have no weight
    place[kept] = np.arange(len(kept))
    x, of, doc, n_sent, n_docs = [], [], [], 0, len(data)
    blocks, held = [], 0
    for k in range(n_docs):
        f, s, _ = data[k]
        data[k] = None  # what is laid out need not be held twice
        own = place[f]
        at = np.repeat(np.arange(n_sent, n_sent + len(s), dtype=np.int32), np.diff(np.append(s, len(f))))
        at = np.broadcast_to(at[:, None], own.shape)[own >= 0]
        x.append(own[own >= 0])
        of.append(at)
        doc.append(np.full(len(s), k, np.int32))
        n_sent += len(s)
        held += len(at)
        if held > FIT_AT_ONCE or k == n_docs - 1:
            blocks.append((np.concatenate(x), np.concatenate(of)))
            x, of, held = [], [], 0
    doc = np.concatenate(doc)
    v, bias = np.zeros(len(kept)), -5.0
    m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        z = np.full(n_sent, bias)
        for x, of in blocks:
            z += np.bincount(of, v[x], n_sent)
        z = np.clip(z, -30, 30)
        none = np.bincount(doc, -np.logaddexp(0, z), n_docs)  # log prod(1 - p)
        q = np.exp(none)
        pull = np.where(y == 1, -q / np.maximum(1e-9, 1 - q), 1.0)
        g = pull[doc] / (1 + np.exp(-z))
        grad = np.zeros(len(kept) + 1)
        for x, of in blocks:
            grad[:-1] += np.bincount(x, g[of], len(kept))
        grad[-1] = g.sum()
        grad /= n_docs
        grad[:-1] += decay * v
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.98 * m2 + 0.02 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.98**t)) + 1e-8)
        v -= step[:-1]
        bias -= step[-1]
    weights[kept] = v
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, trains) -> tuple[np.ndarray, float]:
    return fit(bags(sample(docs, labels, trains)))


def _scores(w: tv.Words, weights: np.ndarray, bias: float):
    """Sentence bounds, sentence scores, document scores."""
    s = sentences(w)
    n = len(w.row) - 1
    if len(s) < 2:
        return s, np.zeros(0), np.zeros(n)
    total = np.concatenate([[0.0], np.cumsum(weights[features(w)].sum(axis=1), dtype=np.float64)])
    z = np.clip(bias + total[s[1:]] - total[s[:-1]], -30, 30)
    none = np.concatenate([[0.0], np.cumsum(-np.logaddexp(0, z))])
    of = np.searchsorted(s, w.row)
    return s, 1 / (1 + np.exp(-z)), np.clip(1 - np.exp(none[of[1:]] - none[of[:-1]]), 0, 1)


def score_column(spark, model, text="text"):
    """The score of a text column, for use on frames of any columns."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** FEATURE_BITS weights

    @F.arrow_udf("double")
    def own(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        out = [np.zeros(0)]
        for part in tv.slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            out.append(_scores(tv.Words(part.column(0), tv.NOT_ALNUM, lower=True), weights, bias)[2])
        return pa.array(np.concatenate(out))

    return own(F.col(text).cast("string"))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score and spans: byte spans of the sentences with a score of a half or more.

    Null, empty and wordless texts score 0.  Every row is scored, repeated ones alike; an
    empty table gives no rows.  Only doc_id and text are read.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(model)  # 2 ** FEATURE_BITS weights

    def make(batches):
        weights, bias = shared.value
        for part in tv.slices(batches):
            w = tv.Words(part.column(1), tv.NOT_ALNUM, lower=True)
            s, p, doc = _scores(w, weights, bias)
            bad = np.flatnonzero(p >= 0.5)
            row = np.searchsorted(w.row, s[bad], "right") - 1
            a, b = w.start[s[bad]] - w.off[row], w.end[s[bad + 1] - 1] - w.off[row]
            spans = [[] for _ in range(part.num_rows)]
            for r, i, j in zip(row.tolist(), a.tolist(), b.tolist(), strict=True):
                spans[r].append({"start": i, "end": j})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(doc), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    text = texts_of(docs)
    return text.mapInArrow(make, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, spans.  Labels with crc32(doc_id) mod folds = 0 are not read.

    Rows without an id: held_out is null, they are scored like any other; labels without an id or a
    value, and labelled rows without a text, are not learned from.  Of several labels of one id the
    largest counts; of several rows of one id each text is learned.  Without labels of both kinds
    every text scores alike.  Null, empty and wordless texts score 0.  Repeated rows give repeated
    results; an empty table gives no rows.
    """
    session(docs)
    model = train(docs, labels, fold_crc("doc_id", folds) != 0)
    return score(docs, model).select(
        "doc_id", (fold_crc("doc_id", folds) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans",
    )
