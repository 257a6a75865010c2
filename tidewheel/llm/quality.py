"""Document quality from statistics of whole texts, by random Fourier features.

Cosines of random projections of the standardised statistics approximate a
Gaussian kernel.  Ridge scores follow from normal equations, which tasks sum
per fold, so that all labelled documents are learned from and every fold's
left-out model costs one subtraction.  Scores of left-out documents calibrate
the model by an isotonic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._store import small_side, stored
from tidewheel.llm._sums import SALTS, summed
from tidewheel.llm._words import RangeHash, chunks, text_bytes, words

FEATURES = 256                                 # cosines
FOLDS = 4
RIDGES = tuple(10.0 ** k for k in range(-3, 4))
WIDTHS = (0.5, 1.0, 2.0)                       # kernel widths, times the root of the number of statistics
SEED = 20
BINS = 4096                                    # of raw scores from -0.5 to 1.5, for the isotonic curve
CLIP = 6.0                                     # standard deviations

STATISTICS = ("words", "chars", "word_length", "word_spread", "longest", "short", "distinct", "top", "echo", "capitals", "digits", "stops",
              "marks", "symbols", "bars", "spaces", "wide", "lines", "same_lines", "entropy")

_KIND = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*@^~=+<>_\\", b"|", b" \t\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _KIND[list(_bytes)] = _k


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text; null and empty texts have zeros.  Memory follows the longest text."""
    out = np.zeros((len(column), len(STATISTICS)))
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        raw, at, n = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], hi - lo
        size = np.diff(at)
        text = np.repeat(np.arange(n), size)
        cells = np.bincount(text * 256 + raw, minlength=n * 256).reshape(n, 256)
        kinds = np.zeros((n, 9))
        np.add.at(kinds.T, _KIND, cells.T)
        share = kinds / np.maximum(size, 1)[:, None]
        p = cells / np.maximum(size, 1)[:, None]
        entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
        ends = np.unique(np.concatenate([np.flatnonzero(raw == 0x0A), at[1:][size > 0] - 1]))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        owner = np.searchsorted(at, starts, side="right") - 1
        line_n, _, line_distinct = _runs(owner, RangeHash(raw)(starts, ends + (raw[ends] != 0x0A) if len(ends) else ends), n)
        some = out[lo:hi]
        some[:, 1] = np.log1p(size)
        some[:, 9:17] = share[:, 1:]
        some[:, 17] = np.log1p(size / np.maximum(line_n, 1))
        some[:, 18] = (line_n - line_distinct) / np.maximum(line_n, 1)
        some[:, 19] = entropy
    for w in words(column):
        some, length = out[w.first:w.first + w.count], (w.end - w.start).astype(float)
        n = np.maximum(w.per_text, 1)
        mean = np.bincount(w.text, weights=length, minlength=w.count) / n
        _, most, distinct = _runs(w.text, w.hash, w.count)
        longest = np.zeros(w.count)
        np.maximum.at(longest, w.text, length)
        again = (w.text[1:] == w.text[:-1]) & (w.hash[1:] == w.hash[:-1])
        some[:, 0] = np.log1p(w.per_text)
        some[:, 2] = mean
        some[:, 3] = np.sqrt(np.maximum(np.bincount(w.text, weights=length * length, minlength=w.count) / n - mean * mean, 0))
        some[:, 4] = np.log1p(longest)
        some[:, 5] = np.bincount(w.text, weights=length <= 3, minlength=w.count) / n
        some[:, 6] = distinct / n
        some[:, 7] = most / n
        some[:, 8] = np.bincount(w.text[1:][again], minlength=w.count) / n
    return out


def _runs(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner: values, the most equal ones, distinct ones."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(fresh)
    most = np.zeros(n)
    np.maximum.at(most, owner[first], np.diff(np.append(first, len(h))))
    return np.bincount(owner, minlength=n), most, np.bincount(owner[first], minlength=n)


@dataclass
class Projection:
    """Standardisation and random directions; ``width`` scales the kernel."""

    mean: np.ndarray
    spread: np.ndarray
    width: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        directions = rng.standard_normal((d, FEATURES)) / (self.width * np.sqrt(d))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phase), np.ones(len(x))])


@dataclass
class Quality:
    """A projection, ridge weights and the isotonic curve from raw scores to probabilities."""

    projection: Projection
    weights: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(x), 0.5)
        return np.interp(self.projection(x) @ self.weights, self.raw, self.level)


def isotonic(at: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, level) of the non-decreasing curve nearest the shares ``positive / total`` at sorted positions.

    Neighbouring blocks are pooled while they fall.  Levels are kept off 0 and 1 by half a case of each class per block.
    """
    blocks: list[list[float]] = []
    for x, n, p in zip(at.tolist(), total.tolist(), positive.tolist(), strict=True):
        blocks.append([x * n, n, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / np.maximum(b[:, 1], 1), np.maximum.accumulate((b[:, 2] + 0.5) / (b[:, 1] + 1)) if len(b) else b[:, 0]


def _matrix_load(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64)


def _matrix_dump(value: np.ndarray) -> bytes:
    return value.tobytes()


def _values(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, len(STATISTICS))


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row of ``docs``, stored: the statistics of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(base.mapInArrow(run, "doc_id long, x array<double>"), "statistics")


def learn(rows: DataFrame, labels: DataFrame, label: Column, *, id_col: str = "doc_id") -> Quality:
    """Fit on the rows of ``with_statistics`` that have a label, all of them.

    Repeated labels of an id count as the largest; null ids and null labels are
    left out; labels above 0 are positive.  Rows that repeat an id are learned
    from each.  Without labels every score is 0.5; with one class only, scores
    are near its value.  Sums leave a task per fold, (FEATURES + 1)^2 numbers
    whatever the rows; the driver gets one such table per fold and width, and
    at most BINS bins.
    """
    truth = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((label > 0).cast("double")).alias("y"))
    truth = stored(truth.filter("y is not null"), "truth")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(FOLDS))
    taught = stored(rows.join(small_side(truth), "doc_id").select(fold.cast("int").alias("fold"), "y", "x"), "taught")
    d = len(STATISTICS)
    each = [F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(f"c{k}") for k in range(d) for v in [F.col("x")[k]]]
    got = taught.agg(F.count("*").alias("n"), *each).first()
    if not got["n"]:
        return Quality(Projection(np.zeros(d), np.ones(d), 1.0), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, spread = (np.array([got[f"c{k}"][i] for k in range(d)]) for i in ("m", "s"))
    spread = np.where(spread > 1e-9, spread, 1.0)
    projections = [Projection(mean, spread, w) for w in WIDTHS]
    side = FEATURES + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            group, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _values(batch.column(2))
            for lo in range(0, len(y), 2048):
                for k, p in enumerate(projections):
                    z = np.column_stack([p(x[lo:lo + 2048]), y[lo:lo + 2048]])
                    for f in np.unique(group[lo:lo + 2048]).tolist():
                        some = z[group[lo:lo + 2048] == f]
                        held[f"{k} {f}"] = held.get(f"{k} {f}", 0) + some.T @ some
        salt = TaskContext.get().partitionId() % SALTS
        for name, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([salt], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["part", "salt", "packed"])

    tables = {r["part"]: _matrix_load(bytes(r["packed"])).reshape(side, side)
              for r in summed(taught.mapInArrow(sums, "part string, salt long, packed binary"), _matrix_load, _matrix_dump).collect()}
    best, chosen, models = np.inf, 0, []
    for k in range(len(WIDTHS)):
        folds = {f: tables[f"{k} {f}"] for f in range(FOLDS) if f"{k} {f}" in tables}
        whole = sum(folds.values())
        for ridge in RIDGES:
            left_out = {f: _ridge(whole - m, ridge) for f, m in folds.items()}
            loss = sum(float(np.append(-w, 1) @ folds[f] @ np.append(-w, 1)) for f, w in left_out.items())
            if loss < best * (1 - 1e-9):
                best, chosen, models = loss, k, [_ridge(whole, ridge), left_out]
    projection, (weights, left_out) = projections[chosen], models
    low, high = -0.5, 1.5

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, z = batch.column(0).to_numpy(), projection(_values(batch.column(2)))
            raw = np.zeros(len(group))
            for f, w in left_out.items():
                raw[group == f] = z[group == f] @ w
            cell = np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "y"])
    cells = (taught.mapInArrow(raw_scores, "cell long, y double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
             .orderBy("cell").collect())
    at = low + (np.array([r["cell"] for r in cells]) + 0.5) * (high - low) / BINS
    return Quality(projection, weights, *isotonic(at, np.array([r["n"] for r in cells]), np.array([r["p"] for r in cells])))


def _ridge(table: np.ndarray, ridge: float) -> np.ndarray:
    """Weights from a table of products of (features, 1, y); the intercept is not shrunk."""
    a = table[:-1, :-1].copy()
    a[np.arange(FEATURES), np.arange(FEATURES)] += ridge
    a[FEATURES, FEATURES] += 1e-9
    return np.linalg.solve(a, table[:-1, -1])


def score(rows: DataFrame, model: Quality, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``with_statistics``, without a shuffle; null and empty texts have a score like any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model(_values(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])
    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
