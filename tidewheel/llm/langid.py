"""Language identification of mixed text: script ranges, word scores and Viterbi.

A word's script leaves the languages that use it; its trigrams score those.
The best path over the words of a text, with a penalty for each switch, labels
spans, and a text's language is the one with the most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._words import NOT_LETTERS, Words, text_bytes, words

BUCKETS = 1 << 16
SWITCH = 12.0          # cost of a change of language between two words, in nats
SEGMENT = 256          # words that the forward pass takes in step
MIN_SHARE = 0.001      # a language uses a script if so much of its letters are in it

# First code point, one past the last, script number.
SCRIPTS = [(0x41, 0x5B, 1), (0x61, 0x7B, 1), (0xC0, 0x250, 1), (0x370, 0x400, 2), (0x400, 0x530, 3), (0x530, 0x590, 4), (0x590, 0x600, 5),
           (0x600, 0x780, 6), (0x900, 0x980, 7), (0x980, 0xE00, 8), (0xE00, 0xE80, 9), (0x10A0, 0x1100, 10), (0x1100, 0x1200, 11),
           (0x1E00, 0x1F00, 1), (0x1F00, 0x2000, 2), (0x3040, 0x3100, 12), (0x3400, 0xA000, 13), (0xAC00, 0xD7B0, 11), (0x20000, 0x32000, 13)]
N_SCRIPTS = 14
_FIRST = np.array(sorted(a for a, _, _ in SCRIPTS))
_LAST = np.array([b for _, b, _ in sorted(SCRIPTS)])
_SCRIPT = np.array([s for _, _, s in sorted(SCRIPTS)])


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray      # (BUCKETS, languages): log probability of a trigram
    uses: np.ndarray       # (scripts, languages): whether a language uses a script


def _scripts(w: Words) -> np.ndarray:
    """Script of each word by its first letter, 0 if unknown."""
    b = np.concatenate([w.lowered, np.zeros(4, np.uint8)]).astype(np.int64)
    a, x, y, z = (b[w.start + k] for k in range(4))
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | x & 63, np.where(
        a < 0xF0, (a & 15) << 12 | (x & 63) << 6 | y & 63, (a & 7) << 18 | (x & 63) << 12 | (y & 63) << 6 | z & 63)))
    at = np.searchsorted(_FIRST, point, side="right") - 1
    return np.where((at >= 0) & (point < _LAST[np.maximum(at, 0)]), _SCRIPT[np.maximum(at, 0)], 0)


def _trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word's run, buckets): byte trigrams of every word with a border at both ends, one per byte."""
    size = w.end - w.start
    run = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(run, size) + np.repeat(w.start, size)
    low = np.concatenate([w.lowered, [0]]).astype(np.uint32)
    left = np.where(at > np.repeat(w.start, size), low[np.maximum(at - 1, 0)], 0)
    right = np.where(at + 1 < np.repeat(w.end, size), low[at + 1], 0)
    code = (left << np.uint32(16) | low[at] << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    return run, (code >> np.uint32(16)).astype(np.int64)


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_rows: int = 5_000) -> Model:
    """Trigram and script counts of about ``max_rows`` documents per language, drawn by a hash of the text when there are more.

    Rows with null text or language teach nothing.  The model has one row per
    bucket, script and language, which bounds what reaches the driver.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    million = 1_000_000
    take = F.lit(False)
    for name in names:
        share = min(million, int(million * max_rows / sizes[name]) + 1)
        take = take | ((F.col("lang") == name) & (F.pmod(F.xxhash64("text"), F.lit(million)) < share))
    number = {name: k for k, name in enumerate(names)}
    width = BUCKETS + N_SCRIPTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((max(1, len(names)), width), dtype=np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for w in words(batch.column(1), NOT_LETTERS):
                if not len(w.start):
                    continue
                size = w.end - w.start
                _, bucket = _trigrams(w)
                owner = lang[w.first + w.text]
                total += np.bincount(np.repeat(owner, size) * width + bucket, minlength=total.size).reshape(total.shape)
                total += np.bincount(owner * width + BUCKETS + _scripts(w), weights=size, minlength=total.size).reshape(total.shape).astype(np.int64)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(at.astype(np.int64)), pa.array(total[k, at])], names=["k", "at", "n"])

    got = known.filter(take).mapInArrow(count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((max(1, len(names)), width))
    if names and got.num_rows:
        total[got.column("k").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    grams, scripts = total[:len(names), :BUCKETS] + 0.05, total[:len(names), BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(names, np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32), (share >= MIN_SHARE).T)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """(words, languages): log probabilities, languages that don't use a word's script being out of the question."""
    run, bucket = _trigrams(w)
    out = np.zeros((len(w.start), len(model.languages)))
    if not len(w.start):
        return out
    for k in range(len(model.languages)):
        out[:, k] = np.add.reduceat(model.score[bucket, k].astype(np.float64), run)
    script = _scripts(w)
    uses = model.uses[script]
    out = np.where(uses | ~uses.any(axis=1, keepdims=True), out, out.max(axis=1, keepdims=True) - 200.0)
    out[script == 0] = 0.0
    return out


def best_paths(scores: np.ndarray, per_text: np.ndarray, penalty: float) -> np.ndarray:
    """State of each word on its text's best path.

    Texts are cut into segments that all advance together, from every possible
    state before them; the segments of a text are then chained.
    """
    n_words, k = scores.shape
    if not n_words:
        return np.zeros(0, dtype=np.int64)
    if k == 1:
        return np.zeros(n_words, dtype=np.int64)
    first_word = np.cumsum(per_text) - per_text
    n_seg = -(-per_text // SEGMENT)
    owner = np.repeat(np.arange(len(per_text)), n_seg)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    start = first_word[owner] + index * SEGMENT
    size = np.minimum(SEGMENT, first_word[owner] + per_text[owner] - start)
    steps, s = int(size.max()), len(owner)
    value = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(s, axis=0)
    from_best = np.zeros((steps, s, k), dtype=np.int16)
    switched = np.zeros((steps, s, k, k), dtype=bool)
    padded = np.concatenate([scores, np.zeros((1, k))])
    for t in range(steps):
        best = value.max(axis=2)
        from_best[t] = value.argmax(axis=2)
        other = best - penalty
        live = size > t
        switched[t] = (other[:, :, None] > value) & live[:, None, None]
        value = np.where(switched[t], other[:, :, None], value) + padded[np.where(live, start + t, n_words)][:, None, :]
    # Chain the segments of each text; before the first word every state is free.
    came = np.zeros((s, k), dtype=np.int64)
    reach = np.zeros((len(per_text), k))
    first_seg = np.cumsum(n_seg) - n_seg
    for i in range(int(n_seg.max())):
        texts = np.flatnonzero(n_seg > i)
        seg = first_seg[texts] + i
        total = reach[texts][:, :, None] + value[seg]
        came[seg] = total.argmax(axis=1)
        reach[texts] = total.max(axis=1)
    state, before = np.zeros(s, dtype=np.int64), np.zeros(s, dtype=np.int64)
    at_end = reach.argmax(axis=1)
    for i in range(int(n_seg.max()) - 1, -1, -1):
        texts = np.flatnonzero(n_seg > i)
        seg = first_seg[texts] + i
        state[seg] = at_end[texts]
        before[seg] = came[seg, at_end[texts]]
        at_end[texts] = before[seg]
    out = np.zeros(n_words, dtype=np.int64)
    every = np.arange(s)
    for t in range(steps - 1, -1, -1):
        live = size > t
        out[start[live] + t] = state[live]
        turn = switched[t, every, before, state]
        state = np.where(turn, from_best[t, every, before], state)
    return out


def label(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row of ``docs``.

    ``spans`` are (start, stop, lang) in UTF-8 bytes of the whole text, from
    the first to the last word of each run; ``score`` is the share of the
    text's letters that the predicted language has.  ``und`` with score 0 if
    the text is null, empty or without letters, or nothing was learned.
    Repeated and null ids are labelled row by row; ties go to the first
    language by name.
    """
    names = [*model.languages, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), NOT_LETTERS):
                path = best_paths(word_scores(w, model), w.per_text, penalty) if model.languages else np.zeros(len(w.start), np.int64)
                k = max(1, len(model.languages))
                weight = np.where(_scripts(w) > 0, w.end - w.start, 1e-6)
                mass = np.bincount(w.text * k + path, weights=weight, minlength=w.count * k).reshape(w.count, k)
                total = mass.sum(axis=1)
                pred = np.where(total > 0, mass.argmax(axis=1), len(model.languages)) if model.languages else np.zeros(w.count, np.int64)
                score = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1e-12), 0.0)
                # Words of other bytes only may hold no letter at all.
                for i in np.flatnonzero((total > 0) & (total < 0.5)):
                    if not any(c.isalpha() for c in batch.column(1)[w.first + int(i)].as_py()):
                        pred[i] = len(model.languages)
                if not model.languages:
                    score[:] = 0.0
                score = np.where(pred == len(model.languages), 0.0, np.minimum(score, 1.0))
                turn = np.ones(len(path), dtype=bool)
                turn[1:] = (path[1:] != path[:-1]) | (w.text[1:] != w.text[:-1])
                lo = np.flatnonzero(turn)
                hi = np.concatenate([lo[1:], [len(path)]])[:len(lo)] - 1
                begins = text_bytes(batch.column(1).slice(w.first, w.count))[1]
                offset = begins[:-1] - begins[0]
                spans = pa.StructArray.from_arrays(
                    [pa.array(w.start[lo] - offset[w.text[lo]]), pa.array(w.end[hi] - offset[w.text[lo]]),
                     pa.array([names[p] for p in path[lo]] if model.languages else ["und"] * len(lo), pa.string())], names=["start", "stop", "lang"])
                ends = np.searchsorted(w.text[lo], np.arange(w.count + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.count), pa.array([names[p] for p in pred], pa.string()), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(ends), spans)], names=["doc_id", "lang_pred", "score", "spans"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, stop: long, lang: string>>")
