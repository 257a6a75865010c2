"""Trailing per-symbol calibration as a stateful operator.

Predictions wait until their labels arrive with the next date, then join the
symbol's daily history.  The history is cut by date distance, which equals the
batch rule of "last present dates" on a calendar without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tidewheel.names import DATE, KEYS, SYMBOL, TIME
from tidewheel.operators.ensemble import ALPHA_RANGE, LOOKBACK_DATES, MIN_HISTORY_ROWS, RIDGE
from tidewheel.streaming.replay import use_rocksdb


def calibration_events(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """One feed of predictions (kind 1) and labels (kind 0, due the next date)."""
    p = preds.select(*KEYS, F.lit(1).alias("kind"), F.col(DATE).alias("due"), "w", "pred", F.lit(None).cast("double").alias("y"))
    y = labels.select(*KEYS, F.lit(0).alias("kind"), (F.col(DATE) + 1).alias("due"), F.lit(None).cast("double").alias("w"),
                      F.lit(None).cast("double").alias("pred"), "y")
    return p.unionByName(y)


class TrailingCalibrator(StatefulProcessor):
    """State per symbol: daily sums, and predictions that wait for labels.

    Both are tables in numpy, so a symbol's state is read and written once a
    micro-batch and its rows are matched at once.  Dates before the lookback
    go, waiting rows included: a label that comes later could not count any more.
    """

    def __init__(self, lookback: int, min_rows: int, ridge: float) -> None:
        self.lookback, self.min_rows, self.ridge = lookback, min_rows, ridge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kept", StructType([StructField("days", BinaryType()), StructField("waiting", BinaryType())]))

    def _kept(self) -> tuple[np.ndarray, np.ndarray]:
        """(date, rows, sum w p y, sum w p^2) per date, and (date, time, weight, prediction) of waiting rows."""
        days, waiting = self.state.get() if self.state.exists() else (b"", b"")
        return np.frombuffer(bytes(days)).reshape(-1, 4), np.frombuffer(bytes(waiting)).reshape(-1, 4)

    def _match(self, held: np.ndarray, since: np.ndarray, labels: np.ndarray, due: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each held row whether a label came after it, and which: the first due, of that the last repeated one."""
        if not len(held) or not len(labels):
            return np.zeros(len(held), dtype=bool), np.zeros(len(held), dtype=np.int64)
        dates, times = np.concatenate([held[:, :2], labels[:, :2]]).astype(np.int64).T
        _, step = np.unique((dates << 32) + times, return_inverse=True)
        moments, rank = np.unique(np.concatenate([since, due]), return_inverse=True)
        place = step.ravel() * len(moments) + rank.ravel()
        mine, theirs = place[:len(held)], place[len(held):]
        order = np.argsort(theirs, kind="stable")
        order = order[np.append(theirs[order][1:] != theirs[order][:-1], True)]
        at = np.searchsorted(theirs[order], mine, side="right")
        found = order[np.minimum(at, len(order) - 1)]
        return (at < len(order)) & (theirs[found] // len(moments) == mine // len(moments)), found

    def _alphas(self, dates: np.ndarray, day: np.ndarray, learned: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The factor of each date from the sums (n, py, pp) of earlier days, learned by then."""
        at = dates[:, None]
        counts = (learned <= at) & (day < at) & (day >= at - self.lookback)
        n, py, pp = (np.where(counts, v, 0.0).sum(axis=1) for v in sums.T)
        alpha = np.clip((py / (pp + 1e-12) + self.ridge) / (1.0 + self.ridge), *ALPHA_RANGE)
        return np.where((n < self.min_rows) | (pp <= 0), 1.0, alpha)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = np.concatenate([np.column_stack([pdf[c].to_numpy(float) for c in (DATE, TIME, "w", "pred", "y", "due", "kind")]) for pdf in rows])
        is_label = table[:, 6] == 0
        days, waiting = self._kept()
        labels, new = table[is_label], table[~is_label]
        held = np.concatenate([waiting, new[:, :4]])
        since = np.concatenate([np.full(len(waiting), -np.inf), new[:, 5]])
        known, which = self._match(held, since, labels, labels[:, 5])
        w, p, y = held[known, 2], held[known, 3], labels[which[known], 4] if len(labels) else np.zeros(0)
        day = np.concatenate([days[:, 0], held[known, 0]])
        learned = np.concatenate([np.full(len(days), -np.inf), labels[which[known], 5] if len(labels) else np.zeros(0)])
        sums = np.concatenate([days[:, 1:], np.column_stack([np.ones(len(w)), w * p * y, w * p * p])])
        left = held[~known]
        if len(new):
            dates, spot = np.unique(new[:, 5], return_inverse=True)
            alpha = self._alphas(dates, day, learned, sums)[spot.ravel()]
            yield pd.DataFrame({SYMBOL: key[0], DATE: new[:, 0].astype(np.int32), TIME: new[:, 1].astype(np.int32), "alpha": alpha, "pred": new[:, 3] * alpha})
            fresh, left = day >= dates[-1] - self.lookback, left[left[:, 0] >= dates[-1] - self.lookback]
            day, sums = day[fresh], sums[fresh]
        kept, spot = np.unique(day, return_inverse=True)
        total = np.zeros((len(kept), 3))
        np.add.at(total, spot.ravel(), sums)
        self.state.update((np.column_stack([kept, total]).tobytes(), np.ascontiguousarray(left).tobytes()))
        if not len(new):
            yield pd.DataFrame([], columns=[*KEYS, "alpha", "pred"])

    def close(self) -> None:
        pass


def calibrate_stream(events: DataFrame, lookback: int = LOOKBACK_DATES, min_rows: int = MIN_HISTORY_ROWS,
                     ridge: float = RIDGE) -> DataFrame:
    """Calibrated predictions from a stream of ``calibration_events``."""
    use_rocksdb(events.sparkSession)
    schema = StructType([events.schema[SYMBOL], StructField(DATE, IntegerType()), StructField(TIME, IntegerType()),
                         StructField("alpha", DoubleType()), StructField("pred", DoubleType())])
    return events.groupBy(SYMBOL).transformWithStateInPandas(
        statefulProcessor=TrailingCalibrator(lookback, min_rows, ridge), outputStructType=schema,
        outputMode="Append", timeMode="None")
