import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from arkivist.llm import textvec as tv
from tests.llm.corpus import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\n\t\x0b\x1fé日-9", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_grams(texts):
    w = tv.Words(pa.array(texts, pa.string()))
    got = [[w.buf[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.row[:-1], w.row[1:])]
    assert got == [words(t) for t in texts]
    seen = {}
    for k, x in zip(w.hash.tolist(), [x for t in got for x in t]):
        assert seen.setdefault(k, x) == x
    assert len(seen) == len({x for t in got for x in t})
    at, g = w.grams(3)
    flat = [x for t in got for x in t]
    runs = [tuple(flat[i : i + 3]) for i in at.tolist()]
    assert runs == [tuple(t[i : i + 3]) for t in got for i in range(len(t) - 2)]
    assert len(set(zip(g.tolist(), runs))) == len(set(runs)) == len(set(g.tolist()))


def test_lower_case_is_ascii_only():
    a, b = (tv.Words(pa.array([t]), lower=True).hash for t in ("Ab É", "aB É"))
    assert (a == b).all()
    assert tv.Words(pa.array(["É"]), lower=True).hash[0] != tv.Words(pa.array(["é"]), lower=True).hash[0]


def test_slices_keep_rows_whole_and_in_order():
    b = pa.RecordBatch.from_pydict({"i": list(range(7)), "text": ["a" * n for n in (0, 50, 3, 3, 200, 0, 1)]})
    parts = list(tv.slices([b], budget=60))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len(t) for t in p.column(1).to_pylist()) <= 60 for p in parts)


def test_prefixes():
    w = tv.Words(pa.array(["abcd abce ab"]))
    p = w.prefixes(3)
    assert p[0] == p[1] != 0 and p[2] == 0 and np.all(w.prefixes(4)[:2] != p[:2])


def thue_morse(levels, a="a", b="b"):
    """Two texts that no polynomial hash with an odd base, modulo a power of two, can tell apart."""
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def test_structured_words_are_told_apart():
    for levels in (3, 8, 10, 12):
        w = tv.Words(pa.array([" ".join(thue_morse(levels))]))
        assert w.hash[0] != w.hash[1]
    x, y = thue_morse(10, "a ", "b ")
    w = tv.Words(pa.array([x + y]))
    assert len(set(tv.Runs(w.hash).of(np.array([0, 1024]), 1024).tolist())) == 2


def test_runs_of_any_length():
    w = tv.Words(pa.array(["a b c a b c d a b c a b c d a b"]))
    r = tv.Runs(w.hash, 1)
    start, size = np.meshgrid(np.arange(8), np.arange(1, 9))
    got = r.of(start.ravel(), size.ravel())
    text = "a b c a b c d a b c a b c d a b".split()
    by = {}
    for s, n, h in zip(start.ravel().tolist(), size.ravel().tolist(), got.tolist()):
        assert by.setdefault(h, tuple(text[s : s + n])) == tuple(text[s : s + n])
    assert len(by) == len({tuple(text[s : s + n]) for s in range(8) for n in range(1, 9)})


def test_blocks_within_a_text(monkeypatch):
    text = "ab  c\nd " * 30 + "x" * 50 + " é日本 " * 9
    whole = tv.Words(pa.array([text, None, "z", text]))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(tv, "BLOCK_BYTES", size)
        w = tv.Words(pa.array([text, None, "z", text]))
        assert all((getattr(w, k) == getattr(whole, k)).all() for k in ("start", "end", "hash", "row"))
