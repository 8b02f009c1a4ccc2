import random

from arkivist.llm import langid
from tests.llm.corpus import frame


def test_a_language_with_long_documents_only_is_learned(spark):
    rnd = random.Random(2)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, make("abcde", 60), "aa", "a") for i in range(12)] + [(100 + i, make("vwxyz", 3200), "zz", "a") for i in range(12)]
    assert all(len(t) > langid.SAMPLE_CHARS for i, t, *_ in rows if i >= 100)
    got = {r.doc_id: r.lang_pred for r in langid.language_id(frame(spark, rows)).collect()}
    assert got == {i: lang for i, _, lang, _ in rows}
