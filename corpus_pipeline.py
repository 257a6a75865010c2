"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are
written as Parquet and reread as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm._store import bounded_batches, stored
from tidewheel.llm.decontaminate import without_benchmark
from tidewheel.llm.line_dedup import without_repeated_lines
from tidewheel.llm.minhash_dedup import without_near_duplicates
from tidewheel.llm.packing import pack
from tidewheel.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts score as texts without words; null and repeated ids
    are judged row by row.  An empty table stays empty.
    """
    bounded_batches(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["quality", "toxic"], target="toxic")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within two edits of an earlier one go, and documents of which nothing is left.

    Null and empty texts have no lines and stay as they are.  An empty table stays empty.
    """
    bounded_batches(spark)
    return without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles, the smallest id stays.

    Documents without words are linked with nothing.  An empty table stays empty.
    """
    bounded_batches(spark)
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    bounded_batches(spark)
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids; a null text is empty."""
    bounded_batches(spark)
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Trained scores, edit distances and sketches have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
