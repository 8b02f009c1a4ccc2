import gc
import time

from arkivist.llm import substring
from arkivist.operators.common import CLEANUP

WORDS = [f"w{i % 97}x{i}" for i in range(400)]
ROWS = [(i, " ".join(WORDS[i : i + 200] + WORDS[:60])) for i in range(40)]


def shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = (blocks.apply(i).name() for i in range(blocks.size()))
    return {x for x in names if x.startswith("shuffle_")}


def test_written_phases_leave_no_shuffle_files(spark):
    """op2's first two phases are over when the frame is there; what they shuffled does not wait for a garbage collection."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    before, setting = shuffle_blocks(spark), spark.conf.get(CLEANUP)
    gc.disable()
    try:
        out = substring.substring_dedup(docs)
        until = time.time() + 10  # files go in the background
        while (left := shuffle_blocks(spark) - before) and time.time() < until:
            time.sleep(0.1)
    finally:
        gc.enable()
    assert not left
    assert spark.conf.get(CLEANUP) == setting
    assert out.filter("n_removed > 0").count() > 30
