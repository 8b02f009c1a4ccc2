import random

import corpus_pipeline
from tests.llm.corpus import frame, sentence


def test_pipeline_leaves_no_stub_of_an_exact_copy(spark, tmp_path):
    rnd = random.Random(5)
    texts = [f"{sentence(rnd, 40)}\n{sentence(rnd, rnd.randrange(1, 8))}\n{sentence(rnd, 2)}" for _ in range(6)]
    rows = [(100 * c + i, t, "en", "a") for c in range(3) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    for k, stage in enumerate((corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies)):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(i, t) for i, t, *_ in rows[: len(texts)]]
