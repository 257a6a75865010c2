"""Exponential forgetting as a scan of affine maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 32  # ranks summed directly; powers of the factor stay in range


def decayed_sums(df: DataFrame, keys: list[str], rank: str, value: str, factor: float, n_ranks: int) -> DataFrame:
    """``df`` with ``value`` replaced by s(r) = value(r) + factor * s(r - 1), per key.

    One row per key and rank 0..n_ranks - 1 (missing ranks count 0 where
    others of their span are there).  Maps s -> factor * s + v compose, so spans
    of ranks are reduced to one map each, those are scanned the same way, and
    what a span starts with is joined back: no group holds more than ``SPAN``
    rows per key, whatever the calendar's length.
    """
    if not 0 < factor <= 1:
        raise ValueError("the factor lies in (0, 1]")
    span, at, carry = (f"_{name}_{n_ranks}" for name in ("span", "at", "carry"))  # every level has its own names
    rows = df.withColumns({span: F.floor(F.col(rank) / SPAN).cast("long"), at: F.col(rank) % SPAN})
    w = Window.partitionBy(*keys, span).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)

    def power(e: Column) -> Column:
        return F.pow(F.lit(float(factor)), e)

    inner = power(F.col(at)) * F.sum(F.col(value) * power(-F.col(at))).over(w)
    if n_ranks <= SPAN:
        return rows.withColumn(value, inner).drop(span, at)
    ends = rows.groupBy(*keys, span).agg(F.sum(F.col(value) * power(SPAN - 1 - F.col(at))).alias(carry))
    before = decayed_sums(ends, keys, span, carry, factor ** SPAN, -(-n_ranks // SPAN)).withColumn(span, F.col(span) + 1)
    return (rows.withColumn(value, inner).join(before, [*keys, span], "left")
            .withColumn(value, F.col(value) + power(F.col(at) + 1) * F.coalesce(carry, F.lit(0.0))).drop(span, at, carry))
