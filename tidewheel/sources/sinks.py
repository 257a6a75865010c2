"""Writing panels, streams of predictions and metric tables."""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.names import DATE, KEYS, TIME, SYMBOL

ROWS_PER_FILE = 2_000_000


def write_by_date(df: DataFrame, path: str, files_per_date: int | None = None, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Date-partitioned parquet, zstd, rows sorted inside each file.

    A date gets as many files as its counted rows need at about
    ``rows_per_file`` each, or ``files_per_date``; a task writes one file.  Rows
    are dealt by a hash of their whole key, so a date that one symbol holds is
    split too.  Rows of the same key stay together, a null date is a date.
    """
    daily = df.groupBy(DATE).count().orderBy(DATE).collect()
    parts = [files_per_date or -(-r["count"] // rows_per_file) for r in daily]
    first = list(accumulate(parts, initial=0))
    # One row per date: the calendar, not the data.
    files = df.sparkSession.createDataFrame([(r[DATE], f, n) for r, f, n in zip(daily, first, parts, strict=False)],
                                            StructType([df.schema[DATE], *StructType.fromDDL("_first int, _files int")]))
    files = files.withColumnRenamed(DATE, "_date")
    placed = df.join(files, F.col(DATE).eqNullSafe(F.col("_date")), "left")
    number = (F.col("_first") + F.pmod(F.xxhash64(*KEYS), F.col("_files"))).cast("int")
    (placed.repartitionById(max(1, first[-1]), number).drop("_date", "_first", "_files")
       .sortWithinPartitions(DATE, SYMBOL, TIME)
       .write.mode(mode).partitionBy(DATE).option("compression", "zstd").parquet(path))


def write_blocks(df: DataFrame, path: str, blocks: dict[str, list[str]], files_per_date: int | None = None) -> None:
    """A pool whose columns are grouped in named blocks, plus the block table."""
    cols = [c for block in blocks.values() for c in block]
    write_by_date(df.select(*KEYS, *[c for c in ("weight", "responder_6") if c in df.columns], *cols),
                  f"{path}/rows", files_per_date)
    pairs = [(b, i, c) for b, cs in blocks.items() for i, c in enumerate(cs)]
    (df.sparkSession.createDataFrame(pairs, "block string, position int, column string")
       .coalesce(1).write.mode("overwrite").json(f"{path}/blocks"))


def append_stream(preds: DataFrame, path: str) -> None:
    """Add prediction streams to the long table partitioned by stream."""
    preds.write.mode("append").partitionBy("stream").parquet(path)


def finished_streams(spark, path: str) -> set[str]:
    """Streams already written: a rerun skips these."""
    try:
        rows = spark.read.parquet(path).select("stream").distinct().collect()
    except AnalysisException:  # no table yet
        return set()
    return {r["stream"] for r in rows}


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small metric table as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
