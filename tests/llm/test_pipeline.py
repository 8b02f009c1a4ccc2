import random

import corpus_pipeline
from tests.llm.corpus import frame, odd_rows, sentence
from tests.llm.test_operators_brute import plain_components, plain_tiles, plain_words
from tests.llm.test_whole_runs import plain_runs


def write(spark, tmp_path):
    rnd = random.Random(9)
    rows = [r for r in odd_rows(11) if r[0] is None or r[0] != 3]  # one row for each id
    item = sentence(rnd, 25)
    rows += [(7000 + i, f"{sentence(rnd, 9)} {'grubber' if i % 2 else ''} {sentence(rnd, 9)}", "en", "a") for i in range(300)]
    rows += [(8000, f"{sentence(rnd, 5)} {item} {sentence(rnd, 5)}", "en", "a")]
    where = str(tmp_path)
    frame(spark, rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(7000 + i, i % 2) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, item


def test_every_stage(spark, tmp_path):
    where, rows, item = write(spark, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], where).write.parquet(f"{where}/stage{k}")
        seen.append(spark.read.parquet(f"{where}/stage{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns and seen[-1].dtypes == docs.dtypes, name
    facts = [[tuple(r)[:4] for r in s.select("doc_id", "text", "lang", "source").collect()] for s in seen[:5]]
    ids = [sorted((r[0] for r in f), key=lambda i: (i is None, i or 0)) for f in facts]
    toxic = {i for i, t, *_ in rows if t and "grubber" in t}
    assert len(toxic & set(ids[1])) <= 9 and len(set(ids[0]) - toxic - set(ids[1])) <= 9  # a handful of labels to learn from
    want = {i: (gone, digest) for i, _, gone, digest in plain_runs(facts[1])}
    import hashlib

    for i, t, *_ in facts[2]:
        assert hashlib.sha256((t or "").encode()).hexdigest() == want[i][1]
    emptied = set(ids[1]) - set(ids[2])
    assert all(want[i][0] for i in emptied)
    lengths = {r.doc_id: (r.n_chars, r.text) for r in seen[2].collect()}
    assert all(n == (None if t is None else len(t)) for n, t in lengths.values())
    assert set(ids[3]) == {i for i, _, c in plain_components(facts[2], 5, 80, 100) if i == c}
    own = plain_words(item)
    leaked = {i for i, t, *_ in facts[3] if len(plain_words(t)) < 3000 and plain_tiles(own, plain_words(t), 5) >= 0.5 * len(own)}
    assert 8000 in leaked and set(ids[4]) == set(ids[3]) - leaked
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == set(ids[4])
    # run() is the same stages in a row
    again = corpus_pipeline.run(spark, where)
    assert sorted(map(str, again.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, seen[5].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_empty_tables(spark, tmp_path):
    where = str(tmp_path)
    frame(spark, []).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0
