"""Toxicity by a classifier chain of linear models over the words of whole texts.

Categories are predicted one after another; each model sees, beside the words,
the probabilities of the earlier categories.  While training, those come from
models that did not see the row (out of fold), as at prediction time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm._words import NOT_LETTERS, Words, long_lists, release, words

MIN_DOCUMENTS = 5      # a word counts if so many documents of the sample have it
CHI_SQUARE = 20        # and if it goes with the category so clearly: a long text would else gather the noise of all others
L1 = 2e-4              # absolute penalty on word weights
STEPS = 200


@dataclass
class Model:
    """A linear model: sorted word hashes, their weights, weights of earlier categories, intercept."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def scores(self, text: np.ndarray, h: np.ndarray, count: int, earlier: np.ndarray) -> np.ndarray:
        """Log odds of ``count`` texts; (text, h) holds each word of a text once."""
        out = np.full(count, self.intercept) + earlier @ self.earlier
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out += np.bincount(text[hit], weights=self.weights[at[hit]], minlength=count)
        return out


@dataclass
class Chain:
    categories: list[str]
    models: list[Model]

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([m.words for m in self.models]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _distinct(w: Words, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of each text once; only those ``among``, if given."""
    text, h = w.text, w.hash
    if among is not None:
        at = np.minimum(np.searchsorted(among, h), max(0, len(among) - 1))
        hit = among[at] == h if len(among) else np.zeros(len(h), dtype=bool)
        text, h = text[hit], h[hit]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[fresh], h[fresh]


def _word_lists(docs: DataFrame) -> DataFrame:
    """(id, truth ..., words) from (id, truth ..., text)."""
    *kept, _ = docs.schema.fields
    schema = T.StructType([*kept, T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(batch.num_columns - 1), NOT_LETTERS):
                text, h = _distinct(w)
                part = batch.slice(w.first, w.count)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(len(kept))], long_lists(h, np.bincount(text, minlength=w.count))],
                    names=[f.name for f in schema.fields])
    return docs.mapInArrow(run, schema)


def _fit(text: np.ndarray, word: np.ndarray, size: int, earlier: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Penalised logistic regression by adaptive proximal gradients; ``word`` counts from 0 to ``size``."""
    sel = use[text]
    where = np.cumsum(use) - 1
    text, word, earlier, y = where[text[sel]], word[sel], earlier[use], y[use]
    n = len(y)
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return np.zeros(size), np.zeros(earlier.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    has = np.bincount(word, minlength=size)
    both = np.bincount(word, weights=y[text], minlength=size)
    chance = has * y.mean()
    spread = np.maximum(chance * (1 - y.mean()) * (1 - has / n), 1e-12)
    chosen = np.flatnonzero((both - chance) ** 2 / spread >= CHI_SQUARE)
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    sel = place[word] >= 0
    text, word, full_size, size = text[sel], place[word[sel]], size, len(chosen)
    # Each class weighs half; a word's step shrinks with the gradients it has had.
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, v, b = np.zeros(size), np.zeros(earlier.shape[1]), 0.0
    grad2, gv, gb = np.full(size, 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(text, weights=w[word], minlength=n) + earlier @ v + b
        r = weight * (_sigmoid(z) - y)
        g = np.bincount(word, weights=r[text], minlength=size)
        grad2 += g * g
        rate = 0.5 / np.sqrt(grad2)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        d = earlier.T @ r
        gv += d * d
        v = v - 0.5 / np.sqrt(gv) * d
        gb += r.sum() ** 2
        b -= 0.5 / np.sqrt(gb) * r.sum()
    out = np.zeros(full_size)
    out[chosen] = w
    return out, v, float(b)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id",
              text_col: str = "text", folds: int = 3, max_rows: int = 20_000) -> Chain:
    """Fit the chain on about ``max_rows`` labelled documents, drawn by a hash of the id when there are more.

    Only their distinct words reach the driver.  Repeated labels of an id count
    as the largest; null ids are left out, and a null label leaves its row out
    of that category only.  Values above 0 are positive.  Null texts count as
    empty.  Without two classes a category gets the share of positives.
    """
    truth = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *[F.max((F.col(c) > 0).cast("double")).alias(f"y{k}") for k, c in enumerate(categories)])
    million = 1_000_000
    part = min(million, int(million * max_rows / max(truth.count(), 1)) + 1)
    drawn = truth.filter(F.pmod(F.xxhash64("id"), F.lit(million)) < part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = texts.join(F.broadcast(drawn), "id").withColumn("fold", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)))
    got = _word_lists(picked.select("id", "fold", *[f"y{k}" for k in range(len(categories))], "text")).toArrow()
    n = got.num_rows
    lists = got.column("words").combine_chunks()
    got = got.drop_columns("words")
    h = np.asarray(lists.flatten()).view(np.uint64) if n else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.asarray(lists.offsets))) if n else np.zeros(0, np.int32)
    # Only words of several documents are numbered: most words of a corpus are of one.
    ordered = np.sort(h)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
    seen = ordered[starts[np.diff(np.append(starts, len(h))) >= min(MIN_DOCUMENTS, max(1, n // 20))]]
    del ordered, starts
    word = np.searchsorted(seen, h)
    keep = seen[np.minimum(word, len(seen) - 1)] == h if len(seen) else np.zeros(len(h), dtype=bool)
    word, text = word[keep], text[keep].astype(np.int64)
    del h, lists, keep
    release()
    fold = got.column("fold").to_numpy() if n else np.zeros(0)
    earlier, models = np.zeros((n, 0)), []
    for k in range(len(categories)):
        y = got.column(f"y{k}").to_numpy(zero_copy_only=False).astype(float) if n else np.zeros(0)
        known = ~np.isnan(y)
        w, v, b = _fit(text, word, len(seen), earlier, np.nan_to_num(y), known)
        some = w != 0
        models.append(Model(seen[some], w[some], v, b))
        held = np.zeros(n)
        for f in range(folds if k + 1 < len(categories) else 0):
            ww, vv, bb = _fit(text, word, len(seen), earlier, np.nan_to_num(y), known & (fold != f))
            m = Model(seen, ww, vv, bb)
            out = fold == f
            held[out] = _sigmoid(m.scores(text, seen[word], n, earlier))[out]
        earlier = np.column_stack([earlier, held])
    return Chain(list(categories), models)


def _chain_scores(column: pa.Array, chain: Chain, among: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), len(chain.models)))
    for w in words(column, NOT_LETTERS):
        text, h = _distinct(w, among)
        for k, m in enumerate(chain.models):
            rows = slice(w.first, w.first + w.count)
            out[rows, k] = _sigmoid(m.scores(text, h, w.count, out[rows, :k]))
    return out


def flagged(docs: DataFrame, labels: DataFrame, categories: list[str], *, target: str, threshold: float = 0.5,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> ..., <target>) for every row of ``docs``, repeated and null ids included.

    Whole texts are scored in place, without a shuffle; a null or empty text
    gets the probability of a text without words.
    """
    chain = fit_chain(docs, labels, categories, id_col=id_col, text_col=text_col)
    among, at = chain.vocabulary(), categories.index(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chain_scores(batch.column(1), chain, among)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, k]) for k in range(len(categories))], pa.array(p[:, at] >= threshold)],
                names=["doc_id", *[f"p_{c}" for c in categories], target])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + f", {target} boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, categories: list[str], *, target: str, threshold: float = 0.5,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all its columns, whose probability of ``target`` is below ``threshold``."""
    chain = fit_chain(docs, labels, categories, id_col=id_col, text_col=text_col)
    among, at, place = chain.vocabulary(), categories.index(target), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chain_scores(batch.column(place).cast(pa.string()), chain, among)
            yield batch.filter(pa.array(p[:, at] < threshold))
    return docs.mapInArrow(run, docs.schema)
