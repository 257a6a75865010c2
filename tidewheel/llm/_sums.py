"""Sums of wide values (packed integers, matrices) that tasks hold as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

SALTS = 32


def summed(partials: DataFrame, load: Callable[[bytes], Any], dump: Callable[[Any], bytes]) -> DataFrame:
    """(part, packed): the sum of each part's values from rows (part string, salt long, packed binary).

    Rows are added up per part and salt first and per part then, so that a part
    of all rows is spread over ``SALTS`` tasks.  Rows arrive sorted and a task
    holds one running sum.  No rows give no rows; null parts are a part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        total: Any = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([dump(total)], pa.binary())], names=["part", "packed"])
        for batch in batches:
            keys = zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns - 1)], strict=True)
            for key, value in zip(keys, batch.column(batch.num_columns - 1), strict=True):
                value = load(value.as_buffer().to_pybytes())
                if key == held:
                    total = total + value
                    continue
                if held is not None:
                    yield out()
                held, total = key, value
        if held is not None:
            yield out()

    schema = "part string, packed binary"
    salted = partials.select("part", "salt", "packed").repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(run, schema)
    return salted.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)
