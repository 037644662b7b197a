"""Sums that tasks make over their rows, added up on the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows taken at a time.
PART = 2048


def summed(rows: DataFrame, size: int, width: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """``add(total, batch)`` over all batches of all tasks, one array of ``size`` by ``width`` a task, then summed.

    What reaches the driver is one such array, whatever the number of rows.
    """

    def run(batches):
        total = np.zeros((size, width))
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                add(total, batch.slice(at, PART))
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(size), pa.int32()), "sums": [r.tobytes() for r in total]})

    def reduce(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table["sums"]:
            total += np.frombuffer(x.as_py())
        return pa.table({"place": table["place"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((size, width))
    schema = "place int, sums binary"
    for r in rows.mapInArrow(run, schema).groupBy("place").applyInArrow(reduce, schema).collect():
        out[r["place"]] = np.frombuffer(r["sums"])
    return out
