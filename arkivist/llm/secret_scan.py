"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

The guess cost of a value is the cheapest way to cut it into known words, separators, dates,
repeats, keyboard walks and brute-force spans, by dynamic programming over (end, number of
parts): log10 of the product of the parts' guesses times the orderings of the parts.  A value
that costs at least ``MIN_LOG10`` guesses is reported as a span of kind ``guess``.  Only whether
it does is asked, so the program follows all cuts that cost less, and no others: the orderings
alone then bound the number of parts, and costs the length of brute-force spans.

Known words are a fixed list and, after it, the words of the corpus itself by their counts over
all documents: all that occur as often as some power of two, the least of which there are no more
than ``VOCABULARY`` words.

After a sign, "is" or "was" every value is weighed; after a blank alone only values with a digit,
a sign or an inner capital, as any plain word of a sentence can follow there.  A value that is not
reported may itself begin with a naming word, so the search goes on at its start.

Bytes are searched first for what any match must hold; only texts with such bytes are
decoded and matched, over their whole length.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkivist.llm import textvec as tv
from arkivist.llm.base import forget, session, texts_of, written

KINDS = ("assign", "access", "hex", "guess")
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: A value in a credential context: a naming word, then a sign or "is" (group 1) or a blank, then the value (group 2).
CONTEXT = re.compile(
    r"""(?ai:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|bearer|auth)["']?(?:([\x20\t]*(?:[:=]|=>|->)[\x20\t]*|[\x20\t]+(?:is|was)[\x20\t]+)|[\x20\t]+)["'`]?([^\s"'`<>,;]{6,})"""
)
_NEEDLES = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"accesskey", b"access_key", b"access-key", b"credential", b"bearer", b"auth")
MIN_LOG10 = 11.0
#: So many of the corpus's words are known at most, for the table goes through the driver to every task.
VOCABULARY = 50_000
LETTERS = (3, 24)

# Words that guessers and people who write examples take first, likeliest first.
WORDS = (
    "password", "123456", "qwerty", "letmein", "admin", "welcome", "monkey", "dragon", "master", "login",
    "secret", "token", "default", "changeme", "example", "test", "user", "root", "guest", "hello",
    "love", "sun", "shine", "princess", "football", "baseball", "shadow", "super", "man", "batman",
    "trust", "access", "key", "pass", "word", "your", "my", "the", "api", "none",
    "null", "true", "false", "demo", "sample", "temp", "server", "data", "base", "public",
    "private", "summer", "winter", "spring", "autumn", "company", "office", "home", "work", "system",
    "name", "field", "value", "required", "optional", "string", "type", "file", "path", "here",
    "insert", "enter", "change", "this", "that", "not", "set", "get", "env", "config",
    "process", "settings", "self", "args", "options", "client", "service", "account", "database", "host",
    "port", "email", "username", "auth", "bearer", "basic", "credentials", "local", "prod", "dev",
    "new", "old", "one", "two", "three", "red", "blue", "green", "black", "white",
    "cat", "dog", "horse", "battery", "staple", "correct", "star", "fire", "water", "tiger",
    "db", "id", "to", "in", "of", "is", "on", "by", "me", "we",
)
_FIXED = {w: i + 1 for i, w in enumerate(WORDS)}
# Rows of a US keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_LEET = str.maketrans("@4831!05$7", "aaebiiosst")
SEPARATORS = "-_./: "
_DATE = re.compile(r"(?a:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d)")
_YEAR = re.compile(r"(?a:(?:19|20)\d\d)")


def _alphabet(s: str) -> int:
    return (10 * any("0" <= c <= "9" for c in s) + 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s) + 33 * any(not c.isalnum() for c in s)) or 100


class Costs:
    """The parts of one value that cost less than a limit, by where they begin."""

    def __init__(self, value: str, ranks: dict[str, int], limit: float):
        self.v, self.low, self.plain = value, (low := value.lower()), low.translate(_LEET)
        if len(low) != len(value):  # a letter whose small form is longer
            self.low = self.plain = value
        self.ranks, self.limit, self.n = ranks, limit, len(value)
        self.longest = max(map(len, ranks), default=0)
        self.each = math.log10(max(10, _alphabet(value)))
        # of each period: how far the value goes on with it from each place
        self.same = {p: self._period(p) for p in range(1, min(max(int(limit) + 1, self.longest), self.n // 2) + 1)}

    def _period(self, p: int) -> list[int]:
        run = [0] * (self.n + 1)
        for i in range(self.n - p - 1, -1, -1):
            run[i] = run[i + 1] + 1 if self.v[i] == self.v[i + p] else 0
        return run

    def short(self, i: int):
        """(end, cost) of words, separators, dates and keyboard walks that begin at i."""
        v, n = self.v, self.n
        for j in range(i + 2, min(n, i + self.longest) + 1):
            costs = [math.log10(r + 1) + extra + (0.5 if v[i:j] != self.low[i:j] else 0.0) for form, extra in ((self.low, 0.0), (self.plain, 0.5)) if (r := self.ranks.get(form[i:j]))]
            if costs:
                yield j, min(costs)
        if v[i] in SEPARATORS:
            yield i + 1, math.log10(len(SEPARATORS))
        for pattern, guesses in ((_DATE, 120 * 366), (_YEAR, 120)):
            if m := pattern.match(v, i):
                yield m.end(), math.log10(guesses) + (0.0 if m[0].isdigit() else 0.6)
        j, turns, last = i, 0, None
        while j + 1 < n and self.low[j] in _KEY and self.low[j + 1] in _KEY:
            (r0, c0), (r1, c1) = _KEY[self.low[j]], _KEY[self.low[j + 1]]
            step = (r1 - r0, c1 - c0)
            if step == (0, 0) or abs(step[0]) > 1 or abs(step[1]) > 1:
                break
            turns += last is not None and step != last
            last, j = step, j + 1
            cost = math.log10(47 * (j - i)) + (turns + 1) * math.log10(5)
            if cost >= self.limit:
                break
            if j - i >= 2:
                yield j + 1, cost

    def repeats(self, i: int):
        """(period, cost of one, last end) of repeats that begin at i.  What is repeated is a part itself, or brute force if it repeats nothing shorter."""
        parts = dict[int, float]()
        for p, same in self.same.items():
            if same[i] < p:
                continue
            if not parts:
                parts = {0: 0.0}
                for j, cost in self.short(i):
                    parts[j] = min(cost, parts.get(j, math.inf))
            cost = parts.get(i + p, math.inf)
            if not any(p % d == 0 and self.same[d][i] >= p - d for d in range(1, p)):
                cost = min(cost, p * math.log10(_alphabet(self.v[i : i + p])))
            if cost < self.limit:
                yield p, cost, i + p + same[i] // p * p


def cheapest(value: str, limit: float = MIN_LOG10, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest cut of the value costs, or limit if none costs less.

    Level by level of the number of parts: the least cost of each beginning of the value.  More
    parts are followed only from where they made it cheaper.  Of repeats in one run of a period,
    a later beginning is followed only to the ends at which it can be cheaper than an earlier one.
    """
    n = len(value)
    if not n:
        return 0.0
    costs = Costs(value, _FIXED if ranks is None else ranks, limit)
    least = {0: 0.0}  # of all levels so far
    now, found, k = {0: 0.0}, limit, 0
    best_start: dict[tuple[int, int, int], tuple[int, float]] = {}  # of (period, last end, place in the period)
    while now:
        k += 1
        orders = math.log10(math.factorial(k))
        if orders >= limit:
            break
        new: dict[int, float] = {}
        def reach(j: int, cost: float, new=new, orders=orders) -> None:
            if cost + orders < limit and cost < least.get(j, math.inf) and cost < new.get(j, math.inf):
                new[j] = cost

        for i in sorted(now):
            at = now[i]
            if i >= n:
                continue
            for j, cost in costs.short(i):
                reach(j, at + cost)
            for j in range(i + 1, min(n, i + int((limit - at) / costs.each) + 1) + 1):
                reach(j, at + (j - i) * costs.each)
            for p, cost, end in costs.repeats(i):
                key = (p, end, i % p)
                last = end
                if key in best_start:
                    a, was = best_start[key]
                    more = at + cost - was
                    if more > 0:
                        last = min(last, i + int((i - a) / (10**more - 1)) + 1)
                if key not in best_start or at + cost < best_start[key][1]:
                    best_start[key] = (i, at + cost)
                for j in range(i + 2 * p, last + 1, p):
                    reach(j, at + cost + math.log10((j - i) // p))
        for j, cost in new.items():
            least[j] = cost
        if n in new:
            found = min(found, new[n] + orders)
        now = new
    return found


def guess_log10(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest cut costs, whatever that is; one brute-force span bounds it."""
    return cheapest(value, len(value) * math.log10(max(10, _alphabet(value))) + 1e-9, ranks) if value else 0.0


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """Ranks of known words: the fixed ones, then the corpus's most frequent runs of ASCII letters, counted over all texts."""

    def count(batches):
        for part in tv.slices(batches):
            w = tv.Words(part.column(1), _NO_LETTER, lower=True)
            size = w.end - w.start
            fit = np.flatnonzero((size >= LETTERS[0]) & (size <= LETTERS[1]))
            _, first, n = np.unique(w.hash[fit], return_index=True, return_counts=True)
            raw = _LOWER[w.buf].tobytes()
            own = fit[first]
            words = [raw[a:b].decode("ascii") for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], ["word", "n"])

    counts = written(texts_of(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    power = F.floor(F.log2("n"))
    total, least = 0, 1 << 62
    for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("k")).orderBy(F.desc("p")).collect():  # 62 rows at most
        total += r.k
        if total > most:
            break
        least = 1 << r.p
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()  # most rows at most
    forget(counts)
    out = dict(_FIXED)
    for r in top:
        out.setdefault(r.word, len(out) + 1)
    return out


def find(text: str, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text, in code points, by start and then by kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    at = 0
    while m := CONTEXT.search(text, at):
        at, value = m.start(2), m[2].rstrip(".)]}!?:")
        if m[1] or any(c.isdigit() for c in value) or any(not c.isalnum() for c in value[:-1]) or any(c.isupper() for c in value[1:]):
            if cheapest(value, MIN_LOG10, ranks) >= MIN_LOG10:
                out.append(("guess", at, at + len(value)))
                at += len(value)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_HEXES = np.zeros(256, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123)]] = False


def suspects(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold bytes without which nothing can match."""
    hit = np.zeros(len(off) - 1, bool)
    flag = np.zeros(len(buf) + 2, np.int8)
    flag[1:-1] = _HEXES[buf]
    step = np.diff(flag)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = b - a >= MIN_HEX
    # a run may cross rows: it is looked at in all that it touches
    for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True):
        hit[max(0, np.searchsorted(off, i, "right") - 1) : np.searchsorted(off, j, "left")] = True
    raw = buf.tobytes()
    low = _LOWER[buf].tobytes()
    for hay, needles in ((raw, (b"AKIA",)), (low, _NEEDLES)):
        for x in needles:
            at = hay.find(x)
            while at >= 0:
                r = int(np.searchsorted(off, at, "right")) - 1
                hit[r] = True
                at = hay.find(x, int(off[r + 1]) - len(x) + 1 if off[r + 1] - len(x) + 1 > at else at + 1)
    return np.flatnonzero(hit)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_NONE = hashlib.sha256(b"").hexdigest()


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts: no spans, the checksum of the empty string.  Every row is
    scanned, repeated ones alike, rows without an id too; an empty table gives no rows.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(vocabulary(docs))  # VOCABULARY words and the fixed ones

    def scan(batches):
        for part in tv.slices(batches):
            n = part.num_rows
            counts = np.zeros((3, n), np.int64)
            digest, spans = [_NONE] * n, [""] * n
            buf, off = tv.string_bytes(part.column(1))
            for r in suspects(buf, off).tolist():
                found = find(part.column(1)[r].as_py() or "", shared.value)
                base = [f"{k}:{a}:{b}" for k, a, b in found if k != "guess"]
                for k, _, _ in found:
                    if k != "guess":
                        counts[KINDS.index(k), r] += 1
                digest[r] = hashlib.sha256(",".join(base).encode()).hexdigest()
                spans[r] = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(digest), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts_of(docs).mapInArrow(scan, OUT)
