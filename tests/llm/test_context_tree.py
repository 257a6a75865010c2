"""The context tree over running text, against a plain recursion."""

import collections
import functools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidewheel.llm import lm_score

TEXTS = [(0, "ab cd  ab CD\tab"), (1, "ab cd ef cd ab"), (2, "xy zz xy zz"), (3, None), (4, ""), (5, "cd ab unseen cd"), (6, "ab cd"), (7, "zz cd"), (8, "xyz\nxyz ab cd")]
LEARNT = {0, 1, 2, 4, 8}


def running(text, depth):
    """(context bytes, byte) of a text: lower-cased words, a space after each, an end mark."""
    data = b"".join(w.encode().lower() + b" " for w in (text or "").split()) + b"\n"
    padded = b" " * depth + data
    return [(padded[i:i + depth], data[i]) for i in range(len(data))]


def plain(texts, learnt, depth):
    seen, every = collections.Counter(), set()
    for i, t in texts:
        every.update(running(t, depth))
        if i in learnt:
            seen.update(running(t, depth))

    @functools.cache
    def counts(context, k, prefix):
        n = [0, 0]
        for (c, b), m in seen.items():
            if c.endswith(context) and b >> (8 - k) == prefix:
                n[(b >> (7 - k)) & 1] += m
        return n

    @functools.cache
    def weigh(context, k, prefix):
        n = counts(context, k, prefix)
        kt = lm_score.kt_log(np.array([float(n[0])]), np.array([float(n[1])]))[0]
        if len(context) == depth:
            return kt, 1.0
        longer = {c[depth - len(context) - 1:] for c, _ in every if c.endswith(context)}
        mixed = np.logaddexp(kt, sum(weigh(c, k, prefix)[0] for c in longer)) - math.log(2)
        return mixed, math.exp(kt - math.log(2) - mixed)

    def byte(context, b):
        out = 0.0
        for k in range(8):
            prefix, bit, p, rest, last = b >> (8 - k), (b >> (7 - k)) & 1, 0.0, 1.0, 0.5
            for d in range(depth + 1):
                part = context[depth - d:]
                n = counts(part, k, prefix)
                if d and not sum(n):
                    break
                last, own = (n[bit] + 0.5) / (sum(n) + 1), weigh(part, k, prefix)[1]
                p, rest = p + rest * own * last, rest * (1 - own)
            out += math.log10(p + rest * last)
        return out
    return {i: sum(byte(c, b) for c, b in running(t, depth)) for i, t in texts}


@pytest.mark.parametrize(("depth", "hot"), [(2, 10**6), (3, 0), (5, 10**6), (6, 0)])
def test_contexts_reach_over_words(spark, monkeypatch, depth, hot):
    for name, value in (("HOT_WORDS", hot), ("HOT_GRAMS", hot), ("PART_GRAMS", 20), ("BLOCK_GRAMS", 7), ("SLICE", 5)):
        monkeypatch.setattr(lm_score, name, value)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id").isin(*LEARNT), depth=depth).collect()}
    want = plain(TEXTS, LEARNT, depth)
    for i, t in TEXTS:
        assert math.isclose(got[i].score, want[i], rel_tol=1e-9), (i, t)
        assert got[i].n_bytes == len(running(t, depth))
    assert got[6].score > got[7].score + 0.5  # "cd" follows "ab" in what was learnt, never "zz"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(docs, F.lit(None).cast("boolean")).collect()}
    assert math.isclose(got[1], 32 * math.log10(0.5)) and math.isclose(got[2], 8 * math.log10(0.5))


def test_a_task_keeps_its_frequent_grams(monkeypatch):
    """Grams that come in every piece are passed on once, at the end; the sums of all are whole."""
    monkeypatch.setattr(lm_score, "HELD_GRAMS", 100)
    rng, held, out, want = np.random.default_rng(6), lm_score._Held(), [], collections.Counter()
    for piece in range(30):
        key = np.concatenate([np.arange(40), 1000 + 60 * piece + np.arange(60)])
        n, c = np.where(key < 40, 5, 1), rng.integers(0, 2, len(key))
        for k, a, b in zip(key.tolist(), n.tolist(), c.tolist(), strict=True):
            want[k, "n"] += a
            want[k, "c"] += b
        out += held.add(key, n, c)
    out += held.flush()
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    got = collections.Counter()
    for k, a, b in rows:
        got[k, "n"] += a
        got[k, "c"] += b
    assert got == want and len(rows) == 40 + 30 * 60


def test_counts_travel_in_pieces(spark, monkeypatch):
    """Tasks pass sums on by the piece, not a row for each key; they are whole however often a task passes on."""
    for name, value in (("HELD_GRAMS", 5), ("RAW_GRAMS", 9), ("SLICE", 4), ("PART_TEXT", 7)):
        monkeypatch.setattr(lm_score, name, value)
    docs = spark.createDataFrame([(i, t, i in LEARNT) for i, t in TEXTS], "doc_id long, text string, train boolean").repartition(3)
    counted = lm_score.text_counts(docs, 3)
    assert "Aggregate" not in counted._jdf.queryExecution().executedPlan().toString()
    rows = counted.collect()
    assert len({(r.word, r.key) for r in rows}) == len(rows)
    every, learnt, ends, words = collections.Counter(), collections.Counter(), [0, 0], collections.Counter()
    for i, t in TEXTS:
        found = [int.from_bytes(c + bytes([b]), "big") for c, b in running(t, 3)]
        every.update(found)
        words.update((t or "").lower().split())
        ends[0] += 1
        if i in LEARNT:
            learnt.update(found)
            ends[1] += 1
    assert {r.key: (r.n, r.c) for r in rows if not r.word} == {k: (n, learnt[k]) for k, n in every.items()}
    assert sorted(r.n for r in rows if r.word) == sorted([ends[0], *words.values()])
    assert [(r.n, r.c) for r in rows if r.word and r.key == int(lm_score.NO_WORD[0])] == [tuple(ends)]


def test_values_are_found_in_place():
    """An open table finds all its keys and no other, -1 (which marks free places unless it is a key) included."""
    rng = np.random.default_rng(3)
    key = np.unique(np.concatenate([rng.integers(-2**63, 2**63 - 1, 3000), np.arange(-40, 900), np.arange(500) << 40]))
    rng.shuffle(key)
    absent = np.setdiff1d(np.concatenate([rng.integers(-2**63, 2**63 - 1, 3000), np.arange(-60, 2000)]), key)
    for keys in (key, key[key != -1], key[:1], key[:0]):
        table, value = lm_score._Lookup(keys, np.arange(len(keys)) + 0.5, np.arange(len(keys)) * 2.0), np.arange(len(keys))
        one, two = table(keys)
        assert np.array_equal(one, value + 0.5) and np.array_equal(two, value * 2.0)
        assert all(np.isnan(x).all() for x in table(np.setdiff1d(np.append(absent, -1), keys)))


def test_estimates_of_large_counts():
    n = np.array([0.0, 1.0, 2.0**14 - 1, 2.0**14, 2.0**14 + 1, 3e9])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1.0) - math.log(math.pi) for a in n for b in n]
    assert np.allclose(lm_score.kt_log(np.repeat(n, 6), np.tile(n, 6)), want, rtol=1e-9, atol=1e-9)
