"""Session helpers: a shared scratch folder and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Wide panels make projections whose generated method is longer than HotSpot
# compiles; below this limit Spark splits them into compilable pieces instead.
RECOMMENDED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A session builder with the settings this library runs best with."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def _shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with the machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{_shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
