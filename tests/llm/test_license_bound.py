"""License units that cannot reach a template are left out before their terms are written, and none that can."""

import collections
import math
import random

from pyspark.sql import functions as F
from tidewheel.llm import licenses


def test_only_units_that_may_reach_are_weighed(spark, monkeypatch):
    prose = " ".join(f"word{k}" for k in range(300))
    texts = ["Released under the MIT License.", f"{prose} the MIT license {prose}", f"{prose}\nReleased under the MIT License.", None, "",
             "Released under the MIT License."]
    files = spark.createDataFrame([(k % 5, "p", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    kept = {}

    def recorded(df, label, *rest, store=licenses.stored):
        kept[label] = store(df, label, *rest)
        return kept[label]

    monkeypatch.setattr(licenses, "stored", recorded)
    got = {(r.doc_id, r.own_license, r.cosine) for r in licenses.scan(files, id_col="doc_id", path=F.col("path")).collect()}
    assert got == {(0, "MIT", 1.0), (1, None, None), (2, "MIT", 1.0), (3, None, None), (4, None, None)}
    assert not kept["unit-terms"].filter(F.col("term").startswith("word")).count()


def test_bound_and_counts(spark):
    draw = random.Random(4)
    idf = {"a": 1.5, "b": 3.0, "c": 7.0}
    rows = [(k, [draw.choice("abcdefgh") for _ in range(draw.randrange(1, 12))]) for k in range(300)]
    table = spark.createDataFrame(rows, "id long, words array<string>").select("id", licenses.term_counts(F.col("words")).alias("c"))
    got = {r.id: r for r in table.select("id", "c", licenses.may_reach(F.col("c"), idf, 0.8).alias("may")).collect()}
    for k, words in rows:
        n = collections.Counter(words)
        assert {t.term: t.tf for t in got[k].c} == n
        inside, outside = (sum((n[w] * idf.get(w, 1.0)) ** 2 for w in n if (w in idf) == side) for side in (True, False))
        assert got[k].may == (math.sqrt(inside / (inside + outside)) >= 0.8 - 1e-6)
