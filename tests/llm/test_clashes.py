"""Filtering operators on tables with clashing column names, missing values and nothing at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm._store import bounded_batches, free_name
from tidewheel.llm.decontaminate import without_benchmark
from tidewheel.llm.line_dedup import without_repeated_lines
from tidewheel.llm.minhash_dedup import without_near_duplicates

NAMES = ["held_by", "HELD_BY_", "cut_of", "cut_lines", "text_left", "known_as", "row", "id", "key", "__id", "n", "count"]
LINE = "a line of some length that comes back in another document"
ITEM = "which of the seven rivers of that valley is the one that never reaches the sea at all"
TEXTS = [(1, LINE + "\nfirst of its own kind"), (2, LINE + "\nsecond of its own kind"), (3, "one two three four five six seven eight"),
         (4, "one two three four five six seven eight"), (5, ITEM), (6, None), (7, ""), (None, "no id here"), (3, "one two three four five six seven eight")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, len(t or ""), *range(len(NAMES))) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))


def ids(df):
    return sorted((r["doc_id"] or 0) for r in df.collect())


def test_clashing_names(spark, docs):
    spark.conf.set("spark.sql.caseSensitive", "false")
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = {"benchmark": without_benchmark(docs, benchmark), "near": without_near_duplicates(docs), "lines": without_repeated_lines(docs)}
    assert all(df.columns == docs.columns for df in found.values())
    assert ids(found["benchmark"]) == [0, 1, 2, 3, 3, 4, 6, 7]
    assert ids(found["near"]) == [0, 1, 2, 3, 5, 6, 7]
    assert {r["doc_id"]: r["text"] for r in found["lines"].collect()}[2] == "second of its own kind"


def test_free_name(docs):
    assert free_name(docs, "held_by") == "held_by__" and free_name(docs, "other") == "other"


def test_stages_on_nothing(spark, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before, after in (("10000", "1000"), ("0", "1000"), ("50", "50")):
        spark.conf.set(key, before)
        assert bounded_batches(spark).conf.get(key) == after
    spark.conf.set(key, "1000")


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "b c d e f g", 1), (1, "x y z u v w", 2), (1, "b c d e f g", 0)], "doc_id long, text string, other int")
    assert [r["other"] for r in without_near_duplicates(docs.orderBy(F.rand())).collect()] == [0]
