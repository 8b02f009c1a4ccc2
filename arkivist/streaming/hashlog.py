"""Replaying a hash log as a stream: each batch is folded into a catalog store.

The store's rows come first and the batch's after them, by file, block and line as in a batch
merge.  Files are taken by their time of change, which for the segments of a log is the order of
writing.  As a folded row stands for its arrivals, the store ends with what one merge of the
whole log gives.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from arkivist.operators.common import filesystem, scratch, written
from arkivist.operators.merge import merge_catalogs, union_inputs, valid_rows
from arkivist.schema import LOG
from arkivist.sources.jsonl import parse, with_places
from arkivist.sources.store import CatalogStore


def read_hashlog(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The lines of a log (a file, or a folder of segments) with their places."""
    fs, where = filesystem(spark, path)
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if fs.exists(where) and fs.getFileStatus(where).isFile():  # a stream watches a folder or a pattern: this one fits the file alone
        name = re.sub(r"([*?{}\[\]\\])", r"\\\1", where.getName())
        path = f"{where.getParent()}/{{{name}}}"
    return with_places(stream.text(path))


def fold_into(store: CatalogStore, now: int, lenient: bool = False):
    """A foreachBatch function."""

    def batch(lines: DataFrame, _: int) -> None:
        with scratch():
            new = valid_rows(parse(lines, LOG, lenient), now)
            store.commit(written(merge_catalogs(union_inputs([store.rows(), new]), now), "replayed"))

    return batch


def replay(spark: SparkSession, path: str, store: CatalogStore, checkpoint: str, now: int, files_per_batch: int = 1000, lenient: bool = False) -> None:
    """Folds all that the log has into the store, and ends.  A malformed line is an error unless lenient."""
    stream = read_hashlog(spark, path, files_per_batch)
    q = stream.writeStream.foreachBatch(fold_into(store, now, lenient)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
