"""Exact linear-interpolated quantiles by repeated histograms.

``percentile`` keeps every distinct value of a column in one task.  Here each
pass counts values in equal slices of the bracket that must hold the wanted
rank and narrows the bracket to one slice; values leave the executors only as
slice counts, until the bracket holds a few thousand values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewheel.functions.scalars import finite

SLICES = 1024
SMALL = 4096


def _slice(c: str, lo: float, hi: float) -> Column:
    """Which of the equal slices of [lo, hi] a value lies in; a range too small to divide has its least value and the rest."""
    width = (hi / 2 - lo / 2) / SLICES
    if width < 1e-300:
        return (F.col(c) > F.lit(lo)).cast("int")
    return F.least(F.floor((F.col(c).cast("double") / 2 - lo / 2) / width), F.lit(SLICES - 1)).cast("int")


def order_statistics(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Values at the given 0-based ranks of each column (NULLs ignored)."""
    found: dict[tuple[str, int], float] = {}
    cols = list(wanted)
    lim = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    # Open bracket: (column, lo, hi, values below lo) -> ranks searched in it.
    open_: dict[tuple[str, float, float, int], list[int]] = {}
    for i, c in enumerate(cols):
        if lim[f"lo_{i}"] is not None:
            open_[(c, lim[f"lo_{i}"], lim[f"hi_{i}"], 0)] = sorted(set(wanted[c]))
    while open_:
        keys = list(open_)
        for k in [k for k in keys if k[1] == k[2]]:
            found.update({(k[0], r): k[1] for r in open_.pop(k)})
        keys = list(open_)
        if not keys:
            break
        probes = F.array(*[
            F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.struct(
                F.lit(i).alias("b"),
                _slice(c, lo, hi).alias("s"),
                F.col(c).cast("double").alias("v")))
            for i, (c, lo, hi, _) in enumerate(keys)])
        # Equal values are counted before they meet in a slice.
        slices = (df.select(F.explode(F.filter(probes, lambda p: p.isNotNull())).alias("p"))
                  .groupBy("p.b", "p.s").agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi"))
                  .orderBy("b", "s").collect())
        nxt: dict[tuple[str, float, float, int], list[int]] = {}
        sizes: dict[tuple[str, float, float], int] = {}
        of_bracket: dict[int, list[Row]] = {}
        for row in slices:
            of_bracket.setdefault(row["b"], []).append(row)
        for i, key in enumerate(keys):
            c, _, _, below = key
            ranks = open_[key]
            for row in of_bracket.get(i, []):
                sizes[(c, row["lo"], row["hi"])] = row["n"]
                inside = [r for r in ranks if below <= r < below + row["n"]]
                if inside:
                    nxt[(c, row["lo"], row["hi"], below)] = inside
                below += row["n"]
        small = {k: v for k, v in nxt.items() if k[1] < k[2]}
        ready = [k for k in small if sizes[(k[0], k[1], k[2])] <= SMALL]
        if ready and sum(sizes[(k[0], k[1], k[2])] for k in ready) <= 16 * SMALL:
            picks = F.array(*[F.when((F.col(c) >= lo) & (F.col(c) <= hi),
                                     F.struct(F.lit(i).alias("b"), F.col(c).cast("double").alias("v")))
                              for i, (c, lo, hi, _) in enumerate(ready)])
            values: dict[int, list[float]] = {}
            for r in df.select(F.explode(F.filter(picks, lambda p: p.isNotNull())).alias("p")).select("p.b", "p.v").collect():
                values.setdefault(r["b"], []).append(r["v"])
            for i, k in enumerate(ready):
                ordered = sorted(values[i])
                found.update({(k[0], r): ordered[r - k[3]] for r in nxt.pop(k)})
        open_ = nxt
    return found


def exact_quantiles(df: DataFrame, probs: dict[str, Iterable[float]]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles {column: [value per probability]}; NaN and infinities count as missing."""
    cols = list(probs)
    df = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    counts = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
    spots: dict[str, list[tuple[int, int, float]]] = {}
    wanted: dict[str, list[int]] = {}
    for i, c in enumerate(cols):
        n = counts[f"n_{i}"]
        if not n:
            continue
        spots[c] = []
        for p in probs[c]:
            at = p * (n - 1)
            lo = min(int(math.floor(at)), n - 1)
            spots[c].append((lo, min(lo + 1, n - 1), at - lo))
        wanted[c] = [r for s in spots[c] for r in s[:2]]
    values = order_statistics(df, wanted) if wanted else {}
    return {
        c: [values[(c, lo)] + (values[(c, hi)] - values[(c, lo)]) * f for lo, hi, f in spots[c]]
        if c in spots else [None for _ in probs[c]]
        for c in cols
    }


def quantile_bucket(c: Column, cuts: list[float]) -> Column:
    """1 + how many cut points lie at or below the value (NULL stays NULL)."""
    steps = sum(((c >= F.lit(q)).cast("int") for q in cuts), F.lit(1))
    return F.when(c.isNotNull(), steps)
