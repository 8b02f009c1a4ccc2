"""Second-arrival trigger: files pass once their size has been seen twice, and the first one with them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arkivist.ship import ship

STATE = "seen long, held string"


def collisions(stream: DataFrame, output: str = "hostname string, volume string, path_norm string, size long") -> DataFrame:
    """A stream's rows whose size occurs again.  The state is a count and one held row for
    each size, and is never dropped: any later file may collide."""
    ship(stream.sparkSession)
    columns = [c.split()[0] for c in output.split(", ")]

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, "")
        for rows in parts:
            rows = rows[columns]
            if seen == 0 and len(rows):
                held = json.dumps([x.item() if hasattr(x, "item") else x for x in rows.iloc[0].tolist()])
                rows, seen = rows.iloc[1:], 1
            if len(rows):
                if seen == 1:
                    yield pd.DataFrame([json.loads(held)], columns=columns)
                    held = ""
                seen += len(rows)
                yield rows
        state.update((seen, held))

    return stream.groupBy("size").applyInPandasWithState(step, output, STATE, "append", GroupStateTimeout.NoTimeout)
