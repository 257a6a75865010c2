"""Tables in the shared folder, which cut lineage and survive a lost executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import scratch_path


BATCH_ROWS = 1000   # whole texts that travel to a Python worker together


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches, which hold 10,000 rows unless told otherwise, to ``BATCH_ROWS``.

    A batch of texts lies in the JVM, in the worker and in its answer at once,
    for every core of an executor.  A smaller setting is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_BYTES = 64 << 20


def small_side(table: DataFrame, width: Column | int = 64) -> DataFrame:
    """``table`` (stored), marked for broadcast if its rows, of ``width`` bytes each, sum to SMALL_BYTES at most; else left to a shuffle join."""
    size = table.count() * width if isinstance(width, int) else table.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(table) if size <= SMALL_BYTES else table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
