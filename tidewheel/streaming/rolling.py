"""Streaming rolling mean / deviation with per-symbol state, and warm start.

Rows of a symbol must arrive in (date, time) order across micro-batches; inside
a micro-batch they are sorted.  NULL rules equal the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from tidewheel.names import DATE, KEYS, ROLLING_ROWS, SYMBOL, TIME, rolling_diff, rolling_std
from tidewheel.sources.panel import history_tail
from tidewheel.streaming.replay import use_rocksdb

BLOCK = 64  # rows of a key that are read and written together


def _output(df: DataFrame, cols: list[str], rows: int, carry: list[str]) -> StructType:
    keep = [df.schema[c] for c in [*KEYS, *carry]]
    return StructType(keep + [StructField(n(c, rows), DoubleType()) for n in (rolling_diff, rolling_std) for c in cols])


def _frame(key, parts: list[pd.DataFrame], cols: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pd.concat(parts).sort_values([DATE, TIME], kind="stable")
    return pdf, pdf[cols].to_numpy(dtype=np.float64, na_value=np.nan)


def _result(pdf: pd.DataFrame, x: np.ndarray, mean: np.ndarray, std: np.ndarray, cols: list[str], rows: int,
            carry: list[str]) -> pd.DataFrame:
    out = {k: pdf[k].to_numpy() for k in [*KEYS, *carry]}
    for i, c in enumerate(cols):
        out[rolling_diff(c, rows)] = x[:, i] - mean[:, i]
    for i, c in enumerate(cols):
        out[rolling_std(c, rows)] = std[:, i]
    frame = pd.DataFrame(out)
    return frame.astype(object).where(frame.notna(), None)


class Ring:
    """The last rows of a key, in numpy blocks of ``BLOCK`` rows under their block number.

    A batch reads the blocks it asks for and writes those it adds rows to, not
    the whole window; blocks that no later window reaches are removed.
    """

    def __init__(self, handle: StatefulProcessorHandle, k: int, rows: int) -> None:
        self.blocks = handle.getMapState("blocks", StructType([StructField("block", LongType())]), StructType([StructField("rows", BinaryType())]))
        self.k, self.rows = k, rows

    def _block(self, b: int) -> np.ndarray:
        return np.frombuffer(bytes(self.blocks.getValue((b,))[0])).reshape(-1, self.k)

    def load(self, lo: int, hi: int) -> np.ndarray:
        """Rows ``lo`` to ``hi`` of all that ever came, as far as they are kept."""
        if hi <= lo:
            return np.zeros((0, self.k))
        first = lo // BLOCK
        return np.vstack([self._block(b) for b in range(first, (hi - 1) // BLOCK + 1)])[lo - first * BLOCK:hi - first * BLOCK]

    def append(self, seen: int, x: np.ndarray) -> None:
        first = seen // BLOCK
        open_rows = np.vstack([self.load(first * BLOCK, seen), x])
        # Of a batch longer than the window only the blocks that later windows reach are kept.
        keep = max(0, seen + len(x) - self.rows) // BLOCK
        for b in range(max(first, keep), (seen + len(x) - 1) // BLOCK + 1):
            at = (b - first) * BLOCK
            self.blocks.updateValue((b,), (open_rows[at:at + BLOCK].tobytes(),))
        for b in range(max(0, seen - self.rows) // BLOCK, min(keep, first + 1)):
            if self.blocks.containsKey((b,)):
                self.blocks.removeKey((b,))


class _Rolling(StatefulProcessor):
    def __init__(self, cols: list[str], rows: int, carry: list[str] = ()) -> None:
        self.cols, self.rows, self.carry = cols, rows, list(carry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = Ring(handle, len(self.cols), self.rows)
        self.sums = handle.getValueState("sums", StructType([StructField("seen", LongType()), StructField("sums", BinaryType())]))

    def _push(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._push(_frame(key, [initialState], self.cols)[1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf, x = _frame(key, list(rows), self.cols)
        mean, std = self._push(x)
        yield _result(pdf, x, mean, std, self.cols, self.rows, self.carry)

    def close(self) -> None:
        pass


class BufferedRolling(_Rolling):
    """Recomputes every window from the rows themselves."""

    def _push(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, t = int(self.sums.get()[0]) if self.sums.exists() else 0, self.rows
        past = np.vstack([self.ring.load(max(0, seen - t + 1), seen), x])
        mean, std = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
        for lo in range(0, len(past) - t + 1, BLOCK):
            # A missing value anywhere in the window makes both statistics missing.
            view = np.lib.stride_tricks.sliding_window_view(past[lo:lo + BLOCK + t - 1], t, axis=0)
            at = len(x) - (len(past) - t + 1) + lo
            mean[at:at + len(view)], std[at:at + len(view)] = view.mean(axis=-1), view.std(axis=-1, ddof=1)
        self.ring.append(seen, x)
        self.sums.update((seen + len(x), b""))
        return mean, std


class RunningRolling(_Rolling):
    """Running sums of the window: work per row does not depend on the window.

    A batch is one pass of cumulated differences between the rows that enter
    and those that leave.  Sums are of distances from a centre and are rebuilt from
    the ring, around its mean, once per full turn, which bounds drift.
    """

    def _push(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, t, n = len(self.cols), self.rows, len(x)
        if self.sums.exists():
            seen, packed = self.sums.get()
            seen, (centre, s, q, miss) = int(seen), np.frombuffer(bytes(packed)).reshape(4, k)
        else:
            seen, (centre, s, q, miss) = 0, np.zeros((4, k))
        # A window without values has empty sums, so the next value may be the centre.
        centre = np.where(miss > min(seen, t) - 0.5, np.nan_to_num(x[np.isfinite(x).argmax(axis=0), np.arange(k)]), centre)
        kept = self.ring.load(max(0, seen - t), min(seen, max(0, seen + n - t)))
        early = max(0, n - len(kept) - max(0, n - t))  # rows that come before any leaves
        leaving = np.vstack([np.broadcast_to(centre, (early, k)), kept, x[:max(0, n - t)]])
        there, gone = ~np.isnan(x), ~np.isnan(leaving)
        come, go = np.where(there, x - centre, 0.0), np.where(gone, leaving - centre, 0.0)
        total, squares = s + np.cumsum(come - go, axis=0), q + np.cumsum(come * come - go * go, axis=0)
        missing = miss + np.cumsum(gone.astype(float) - there, axis=0)
        full = (missing < 0.5) & (seen + 1 + np.arange(n) >= t)[:, None]
        mean = np.where(full, centre + total / t, np.nan)
        std = np.where(full, np.sqrt(np.maximum(squares - total * total / t, 0.0) / max(t - 1, 1)), np.nan) if t > 1 else np.full(x.shape, np.nan)
        self.ring.append(seen, x)
        s, q, miss = (v[-1] for v in (total, squares, missing))
        if (seen + n) // t > seen // t:
            held = self.ring.load(max(0, seen + n - t), seen + n)
            some = ~np.isnan(held)
            centre = np.where(some.any(axis=0), np.where(some, held, 0.0).sum(axis=0) / np.maximum(some.sum(axis=0), 1), centre)
            away = np.where(some, held - centre, 0.0)
            s, q, miss = away.sum(axis=0), (away * away).sum(axis=0), np.isnan(held).sum(axis=0).astype(float)
        self.sums.update((seen + n, np.stack([centre, s, q, miss]).tobytes()))
        return mean, std


ENGINES = {"buffered": BufferedRolling, "running": RunningRolling}


def rolling_stream(stream: DataFrame, cols: list[str], rows: int = ROLLING_ROWS, engine: str = "running",
                   history: DataFrame | None = None, carry: list[str] = ()) -> DataFrame:
    """Streaming twin of ``rolling_features``: keys, ``carry`` columns passed
    through, and the engineered columns.

    ``history`` is a batch panel whose last ``rows`` rows per symbol warm the
    state up.
    """
    carry = list(carry)
    use_rocksdb(stream.sparkSession)
    warm = None
    if history is not None:
        warm = history_tail(history.select(*KEYS, *cols), rows).groupBy(SYMBOL)
    inputs = list(dict.fromkeys([*KEYS, *carry, *cols]))
    return stream.select(*inputs).groupBy(SYMBOL).transformWithStateInPandas(
        statefulProcessor=ENGINES[engine](cols, rows, carry), outputStructType=_output(stream, cols, rows, carry),
        outputMode="Append", timeMode="None", initialState=warm)
