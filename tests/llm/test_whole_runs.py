import random

import pytest

from arkivist.llm import jaccard, lines, substring
from tests.llm.corpus import frame, odd_rows, sentence, words
from tests.llm.test_operators_brute import by_id, sha


def plain_runs(rows, least=20):
    """Deletes every run that an earlier place has too, by trying all pairs of places."""
    own = [(i, [x for x in (t or "").split("\n") if words(x)]) for i, t, *_ in rows]
    places, out = {}, []
    for r, (i, ls) in enumerate(own):
        for a, x in enumerate(ls if i is not None else ()):
            places.setdefault(x, []).append((i, a, r))
    for (i, t, *_), (_, ls) in zip(rows, own, strict=True):
        gone = set()
        for a, x in enumerate(ls if i is not None else ()):
            for j, b, r in places[x]:
                if (j, b) < (i, a):
                    other, n = own[r][1], 0
                    while a + n < len(ls) and b + n < len(other) and ls[a + n] == other[b + n]:
                        n += 1
                    if sum(len(words(y)) for y in ls[a : a + n]) >= least:
                        gone.update(range(a, a + n))
        number, kept = -1, []
        for x in (t or "").split("\n"):
            number += bool(words(x))
            if not (words(x) and number in gone):
                kept.append(x)
        out.append((i, number + 1, len(gone), sha("\n".join(kept))))
    return out


@pytest.mark.parametrize("least", [20, 3])
def test_whole_runs(spark, least):
    rnd = random.Random(8)
    pool = [sentence(rnd, n) for n in (1, 1, 2, 2, 3, 5, 8, 25)] + ["", " "]
    rows = odd_rows(4) + [(1000 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(40))), "en", "a") for i in range(60)]
    tail = f"{sentence(rnd, 60)}\n{sentence(rnd, 10)}"
    rows += [(2000, tail, "en", "a"), (2001, f"{sentence(rnd, 3)}\n{tail}\n{sentence(rnd, 4)}", "en", "a")]
    got = lines.digest(lines.line_dedup(frame(spark, rows), least)).collect()
    assert by_id(map(tuple, got)) == by_id(plain_runs(rows, least))
    assert {r.doc_id: r.n_removed for r in got}[2001] >= 2


def test_a_long_repeat_is_one_path(spark):
    rnd = random.Random(21)
    shared = sentence(rnd, 1000).split()
    shared = [f"{w}-{i}" for i, w in enumerate(shared)]
    rows = [(i, " ".join([f"x{i}.{k}" for k in range(40)] + shared + [f"y{i}.{k}" for k in range(40)]), "en", "a") for i in (3, 5, 9)] + [(None, " ".join(shared), "en", "a"), (11, None, None, None)]
    (p,) = substring.paths(frame(spark, rows)).collect()
    assert (p.copies, p.doc_id) == (3, 3) and 940 <= p.windows <= 981 and 40 <= p.start <= 60
    cut = [(20, " ".join(shared[:400]), "en", "a")]
    found = substring.paths(frame(spark, rows + cut)).collect()
    assert len(found) == 2 and sorted(p.copies for p in found) == [3, 4]


@pytest.mark.parametrize("levels", [10, 12])
def test_structured_words_and_lines_stay(spark, levels):
    """Texts that differ in one long word only, of bytes that weak hashes take for equal."""
    from tests.llm.test_textvec import thue_morse

    a, b = thue_morse(levels)
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {a}", "en", "x"), (2, f"{lead} {b}", "en", "x"), (3, f"{a}\n{lead}\nx3", "en", "x"), (4, f"{b}\n{lead}\ny4", "en", "x")]
    docs = frame(spark, rows)
    assert {r.n_removed for r in substring.substring_dedup(docs).collect()} == {0}
    assert {r.n_removed for r in lines.line_dedup(docs, 20).collect()} == {0}
    assert sorted(r.component_id for r in jaccard.jaccard_components(docs, 20).collect()) == [1, 2, 3, 4]


def test_rows_go_along_with_their_lines(spark):
    rows = odd_rows(5, 20)
    rows.append(rows[3])
    docs = frame(spark, rows)
    got = lines.line_dedup(docs, carry=True).collect()
    assert len(got) == len(rows) and all(r["row"]["rank"] == "z" and r["row"]["doc_id"] == r.doc_id for r in got)
    assert by_id((r.doc_id, r["row"]["n_chars"]) for r in got) == by_id((i, None if t is None else len(t)) for i, t, *_ in rows)
