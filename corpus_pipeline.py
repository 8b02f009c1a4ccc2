"""A training-corpus pipeline of five stages, each one of the operators of arkivist.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir).  Each stage is
written as Parquet and read again as the next one's documents.  All but the last return the
columns of documents, whatever these are.

Null and empty texts pass all filters, and so do rows without an id where rows are compared
by id; a filter that looks at one text only looks at theirs too.  Repeated rows stay or go
together.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkivist.llm import jaccard, lines, packing, tiling, toxicity
from arkivist.llm.base import fold_crc, hashed_side, session, table, written
from arkivist.llm.queries import TOKENIZER

#: A name beside those of the documents' own columns.
ID = "__stage_doc_id"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose noisy-or toxicity is a half or more."""
    session(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold_crc("doc_id", 5) != 0)
    return docs.filter(toxicity.score_column(spark, model) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of whole repeated line runs, and documents of which nothing else was left.  n_chars follows the text."""
    made = lines.line_dedup(docs, carry=True).filter("n_removed = 0 or kept rlike '\\\\S'")
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        old = F.col("text").cast(docs.schema[c].dataType) if c == "text" else F.col("row")[c]
        new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}.get(c)
        columns.append((old if new is None else F.when(changed, new.cast(docs.schema[c].dataType)).otherwise(old)).alias(c))
    return made.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of five-word Jaccard links of 0.8 or more."""
    found = jaccard.jaccard_components(docs, k=5, threshold=(80, 100)).filter("doc_id != component_id")
    copies = hashed_side(written(found.select(F.col("doc_id").alias(ID)).distinct(), "copies"))
    return docs.join(copies, docs["doc_id"].cast("long") == copies[ID], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold at least half of a benchmark item."""
    leaks = tiling.leaked_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("tid").alias(ID))
    return docs.join(leaks, F.xxhash64(docs["text"].cast("string")) == leaks[ID], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.best_two_fit(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: Training, tokenising and graph components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    session(docs)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
