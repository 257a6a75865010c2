"""Groups of rows that arrive sorted, and links within a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._store import small_side, stored


def in_blocks(rows: DataFrame, sizes: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """``rows`` dealt so that all members of a key meet, in groups of at most about 2 * ``block`` rows.

    ``sizes`` has the row count of each key as ``n``.  A key's members are
    hashed into blocks, and each pair of blocks is a group (i, j); ``mine`` is
    the block a row belongs to.  Rows come sorted by key and group.
    """
    counted = stored(sizes.select(*keys, F.ceil(F.col("n") / block).alias("blocks")), "sizes")
    rows = rows.join(small_side(counted), keys).withColumn("mine", F.pmod(F.xxhash64(member), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("blocks", "other")
    group = [*keys, "i", "j"]
    return rows.repartition(*group).sortWithinPartitions(*group)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table per run of equal values in the first ``keys`` columns, whole runs only."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        values = np.column_stack([table.column(k).to_numpy() for k in range(keys)])
        at = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(at, at[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest


def least_labels(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row reaches through the boolean matrix ``near``."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return label
        label = new


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of integers."""
    sizes = np.array([len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    common = times > 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = common[at]
    column, owner = (np.cumsum(common) - 1)[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, width = np.zeros((len(sets), len(sets))), int(common.sum())
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), min(4096, width - lo)), dtype=np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)
