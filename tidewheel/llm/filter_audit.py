"""How filters interact, whatever their order, by wide packed counters.

A row is a mask: which filters it fails and which tallies it belongs to.  For
every mask one integer holds, in a field per outcome, order and step, what
becomes of such a row when the filters are applied in that order.  Adding these
integers counts everything at once; a part's sum is unpacked at the end.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._store import stored
from tidewheel.llm._sums import SALTS, summed

FIELD = np.dtype("<u8")   # a field cannot overflow: it counts rows, which Spark numbers by signed 64-bit integers
HELD_PARTS = 64           # sums that a task holds before it passes them on
WORD = r"[^\x20\x09-\x0D]+"


def outcome_fields(n_filters: int, n_tallies: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, fields): all orders of the filters, and 0/1 by (mask, outcome, order, step).

    Bit i of a mask says that filter i fails, bit n_filters + j that tally j
    holds.  Outcomes: kept, removed, redundant, unique fail, then one per tally.
    """
    orders = np.array(list(itertools.permutations(range(n_filters))), dtype=np.int64).reshape(-1, n_filters)
    bits = (np.arange(1 << (n_filters + n_tallies))[:, None] >> np.arange(n_filters + n_tallies)) & 1 == 1
    failing = bits[:, :n_filters]
    fails = failing[:, orders]
    gone = np.logical_or.accumulate(fails, axis=2)
    before = np.zeros_like(gone)
    before[:, :, 1:] = gone[:, :, :-1]
    removed = fails & ~before
    alone = (failing.sum(axis=1) == 1)[:, None, None]
    lost = [removed & bits[:, n_filters + j, None, None] for j in range(n_tallies)]
    return orders, np.stack([~gone, removed, fails & before, fails & alone, *lost], axis=1)


def packed_masks(n_filters: int, n_tallies: int) -> list[int]:
    """The integer of each mask."""
    _, fields = outcome_fields(n_filters, n_tallies)
    return [int.from_bytes(f.astype(FIELD).tobytes(), "little") for f in fields]


def unpack(total: int, n_filters: int, n_tallies: int) -> np.ndarray:
    """Counts by (outcome, order, step) of a sum of packed integers."""
    shape = (4 + n_tallies, math.factorial(n_filters), n_filters)
    return np.frombuffer(total.to_bytes(math.prod(shape) * FIELD.itemsize, "little"), dtype=FIELD).reshape(shape).astype(np.int64)


def audit(rows: DataFrame, filters: list[str], tallies: list[str], part: Column) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <tally>_lost ..., shapley) for every part, order and step.

    ``filters`` and ``tallies`` name boolean columns of ``rows``; null counts as
    false.  A filter column is true where the row fails.  A null part is the
    empty one.  At most six filters, as every order is listed.  Repeated rows
    count each; no rows give no parts.  Other columns are ignored.
    """
    k, t = len(filters), len(tallies)
    if not 1 <= k <= 6 or t > 6:
        raise ValueError("one to six filters and at most six tallies")
    mask = sum((F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int") * (1 << i) for i, c in enumerate([*filters, *tallies])), F.lit(0))
    masks = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sums, salt = packed_masks(k, t), {}, TaskContext.get().partitionId() % SALTS

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([salt] * len(sums), pa.int64()),
                                               pa.array([_dump(v) for v in sums.values()], pa.binary())], names=["part", "salt", "packed"])
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            both = names.indices.to_numpy().astype(np.int64) << (k + t) | batch.column(1).to_numpy()
            for key, n in zip(*(x.tolist() for x in np.unique(both, return_counts=True)), strict=True):
                name = names.dictionary[key >> (k + t)].as_py()
                sums[name] = sums.get(name, 0) + n * packed[key & ((1 << (k + t)) - 1)]
                if len(sums) > HELD_PARTS:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    orders, _ = outcome_fields(k, t)
    names = np.array(["".join(filters[i] for i in o) for o in orders])
    columns = ["kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in tallies], "shapley"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = unpack(_load(value.as_buffer().to_pybytes()), k, t)
                shapley = np.array([counts[1][orders == i].sum() for i in range(k)])[orders]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * orders.size, pa.string()), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))),
                     *[pa.array(c.ravel()) for c in [*counts, shapley]]], names=["part", "filter_order", "step", *columns])

    sums = summed(masks.mapInArrow(count, "part string, salt long, packed binary"), _load, _dump)
    return sums.mapInArrow(report, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def _load(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def _dump(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "little")


def text_filters(text: Column) -> dict[str, Column]:
    """What fails: A under 200 words, B under half of them distinct, C over 3 % capitals, D a symbol.  Null texts are empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(found) < 200, "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
            "C": 100 * capitals > 3 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def document_masks(docs: DataFrame, labels: DataFrame, tallies: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, <tally> ...) for every row of ``docs``.

    E fails where a row of a smaller id has the same text, be it removed or
    not; texts are compared by SHA-256, null as empty.  A row without an id
    neither fails E nor makes another fail.  Rows that repeat an id are judged
    alike.  ``tallies`` are conditions on ``labels``; repeated labels of an id
    count if any of them holds, and an id without labels has none.
    """
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(part_col).cast("string").alias("part"),
                       F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("digest"),
                       *[c.alias(n) for n, c in text_filters(F.col(text_col)).items()])
    seen = stored(seen.withColumn("digest", F.unhex("digest")), "flags")
    copies = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in tallies.items()])
    out = seen.join(copies, "digest", "left").join(marks, "doc_id", "left")
    return out.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
                      *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in tallies])
