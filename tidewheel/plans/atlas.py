"""Column atlas: one row of forensic statistics per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scalars import zero_fill
from tidewheel.names import KEYS, STEPS_PER_DAY
from tidewheel.operators.diagnostics import ranked_report
from tidewheel.operators.forensics import (ALPHA_BAND, NOWCAST_BAND, SMA_ROWS, acf_summary, deconvolve, lag_curves,
                                           lead_lag_summary)
from tidewheel.operators.moments import column_stats
from tidewheel.operators.shifts import day_first_difference
from tidewheel.operators.structure import intraday_share, market_share, overnight_continuity
from tidewheel.sources.panel import complete_series


def atlas(panel: DataFrame, cols: list[str], steps_per_day: int = STEPS_PER_DAY, max_shift: int = 48,
          max_lag: int = 200, alpha: tuple[int, int] = ALPHA_BAND, nowcast: tuple[int, int] = NOWCAST_BAND,
          lam: float = 0.5, min_series: int = 31, min_pairs: int = 30,
          tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(atlas, curves) over the complete series of the panel."""
    whole = complete_series(panel, steps_per_day)
    signal = deconvolve(whole, "responder_8", SMA_ROWS, lam, steps_per_day).select(*KEYS, F.col("signal").alias("_signal"))
    rows = whole.join(signal, KEYS).withColumn("_r8", zero_fill("responder_8"))
    rows = rows.withColumns({"_d8": day_first_difference("_r8"), "_r6": zero_fill("responder_6")}).drop("_r8")
    curves = lag_curves(rows, cols, ["_signal", "_d8", "_r6"], max_shift, max_lag, steps_per_day).persist()

    def enough(kind: str) -> DataFrame:
        return curves.where((F.col("kind") == kind) & (F.col("n_series") >= min_series))

    n_valid = (curves.where((F.col("kind") == "acf") & (F.col("lag") == 0))
               .select("feature", F.col("n_series").alias("n_valid_series")))
    r6 = (enough("ll:_r6").where(F.col("lag") == 0).select("feature", F.col("corr").alias("corr_target_t0")))
    d8 = lead_lag_summary(enough("ll:_d8"), "_d8", alpha, nowcast).select("feature", F.col("alpha_score").alias("alpha_score_d8"))
    parts = [column_stats(whole, cols).select("feature", "null_rate"), n_valid, acf_summary(curves),
             overnight_continuity(whole, cols, min_pairs).select("feature", "continuity"),
             market_share(whole, cols), intraday_share(whole, cols),
             lead_lag_summary(enough("ll:_signal"), "_signal", alpha, nowcast), d8, r6]
    out = reduce(lambda a, b: a.join(b, "feature", "left"), parts)
    if tags is not None:
        out = out.join(tags, "feature", "left")
    return out, curves


# ---- fixed values: report section -> (score, rows) ------------------------
SECTIONS = {"alpha": ("alpha_score", 25), "nowcast": ("nowcast_score", 15), "market": ("market_share", 15)}
# ---------------------------------------------------------------------------


def report(table: DataFrame) -> DataFrame:
    """Report sections in long form: (section, position, feature, score)."""
    feats = table.where(F.col("feature").startswith("feature_")).persist()  # one row per column
    parts = [ranked_report(feats, score, n).select(F.lit(section).alias("section"), "position", "feature",
                                                   F.col(score).alias("score"))
             for section, (score, n) in SECTIONS.items()]
    sma = feats.where((F.col("ramp_linearity_r2") > 0.97) & F.col("cutoff_005").between(1, 300))
    parts.append(ranked_report(sma, "cutoff_005", 100).select(
        F.lit("sma_like").alias("section"), "position", "feature", F.col("cutoff_005").cast("double").alias("score")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def markdown(report_rows: DataFrame) -> str:
    """The (bounded) report as a Markdown table."""
    lines = ["| section | # | column | score |", "|---|---|---|---|"]
    for r in report_rows.orderBy("section", "position").toLocalIterator():
        score = "—" if r["score"] is None else f"{r['score']:.4f}"
        lines.append(f"| {r['section']} | {r['position']} | {r['feature']} | {score} |")
    return "\n".join(lines)
