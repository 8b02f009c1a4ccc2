"""Small corpora with every odd case, and plain versions of the operators."""

import random
import re

from pyspark.sql import types as T

#: Extra columns with names that operators use inside.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("token", "rep", "score", "tid", "marks", "spans", "rank", "label", "kept", "c", "cluster", "size")]
)
VOCABULARY = ["la", "ve", "Ört", "sun", "moon,", "river", "stone", "fire", "x", "tree", "wind", "sea", "Ash", "oak.", "elm", "fir", "日本", "é"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, parts=3):
    full = [(i, t, lang, src, None if t is None else len(t), *["z"] * 12) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) + str(rnd.randrange(30)) for _ in range(n))


def odd_rows(seed=0, n=60):
    """Documents with copies, near copies, shared passages, repeats in a document, blanks of all kinds."""
    rnd = random.Random(seed)
    shared = [sentence(rnd, 30) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = rnd.randrange(8)
        if kind == 0 and rows:
            text = rnd.choice(rows)[1]
        elif kind == 1 and rows and (base := rnd.choice(rows)[1]):
            w = base.split(" ")
            for _ in range(rnd.randrange(1, 3)):
                w[rnd.randrange(len(w))] = "edit" + str(i)
            text = " ".join(w)
        elif kind == 2:
            text = f"{sentence(rnd, rnd.randrange(25))}\n{rnd.choice(shared)}\n{sentence(rnd, rnd.randrange(25))}"
        elif kind == 3:
            own = sentence(rnd, 22)
            text = f"{own}\t{sentence(rnd, 5)}\n\n{own} {own}"
        else:
            text = sentence(rnd, rnd.randrange(1, 80))
        rows.append((i * 3, text, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None])))
    rows += [(7, None, None, None), (10, "", "en", "a"), (11, " \n\t ", "en", "a"), (13, "one", "en", "a"), (14, "One", "en", "a"), (16, "one two", "en", "a")]
    rows += [(None, rows[0][1], "en", "a"), rows[1], rows[1]]
    rows += [(17, "la " * 3000, "en", "a"), (19, sentence(rnd, 4000), "en", "a"), (20, "\n".join(shared), "en", "a")]
    return rows
