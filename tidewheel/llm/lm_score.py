"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text runs through: its words, each ended by a space, and an end mark.  Each
byte is eight binary decisions; a decision's node has a context tree over the
bytes before it in the text, across spaces and into earlier words, and every
depth's Krichevsky-Trofimov estimate is mixed by the weights of the tree.
Counts come from all training texts, are rolled up from the deepest contexts,
and predictions are handed down again; no step holds the model in one place.
A byte's code length follows from it and the bytes before it, so it is computed
once per distinct gram; frequent grams are looked up in place, others joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._store import stored
from tidewheel.llm._words import RangeHash, Words, mix, words

DEPTH = 6                # context bytes
HOT_WORDS = 500_000      # at most so many frequent words are sent to all tasks
HOT_GRAMS = 2_000_000    # the same for grams
HELD_WORDS = 100_000     # distinct words that a task counts before it passes them on
HELD_GRAMS = 1_000_000   # grams likewise
RAW_GRAMS = 1 << 21      # grams that are sorted together before they are counted
PART_TEXT = 1 << 23      # bytes of text whose counts are summed up together
PIECE_KEYS = 1 << 16     # keys that travel to the JVM together
LEAST_PARTS = 8
JOINED = 3               # depths up to here are joined; deeper ones lie within groups of contexts of so many bytes
PART_GRAMS = 500_000     # grams of a group of contexts
BLOCK_GRAMS = 50_000     # grams of whole contexts that are weighed together
SLICE = 1 << 18          # bytes of running text whose grams are made together
GROUP_WORDS = 100_000    # words whose contexts are looked up together
SPACE, END = 0x20, 0x0A  # neither stands in a word
PAD = 7                  # bytes before a gram's own in a word of 64 bits
BITS = range(8)
NO_WORD = RangeHash(np.zeros(0, np.uint8))(np.zeros(1, np.int64), np.zeros(1, np.int64)).view(np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    y = x + 8.0
    steps = np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(steps)


_OF_COUNTS = {more: _log_gamma(np.arange(1 << 14) + more) for more in (0.5, 1.0)}


def _log_gamma_above(count: np.ndarray, more: float) -> np.ndarray:
    """``_log_gamma(count + more)`` of whole counts, the small ones by table."""
    known = _OF_COUNTS[more]
    out = known[np.minimum(count, len(known) - 1).astype(np.int64)]
    large = np.flatnonzero(count >= len(known))
    out[large] = _log_gamma(count[large] + more)
    return out


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimate gives to a sequence of so many zeros and ones."""
    return _log_gamma_above(zeros, 0.5) + _log_gamma_above(ones, 0.5) - _log_gamma_above(zeros + ones, 1.0) - np.log(np.pi)


def _run(data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begin of each word) of words in a row: each ended by a space, an empty one the end mark and what no context sees behind.

    Seven spaces stand first, behind each end mark and, if words stand ``alone``, behind each word.
    """
    size = end - start
    out = size + 1 + np.where((size == 0) | alone, PAD, 0)
    first = np.cumsum(out) - out + PAD
    run = np.full(int(out.sum()) + PAD, SPACE, dtype=np.uint8)
    word = size > 0
    run[_within(first[word], (first + size)[word], len(run))] = data[_within(start[word], end[word], len(data))]
    run[first[~word]] = END
    return run, first


def _within(start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Which places lie in one of these ranges, which do not overlap."""
    step = np.zeros(length + 1, dtype=np.int8)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def _keys(run: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """The grams of places ``lo`` to ``hi``: the byte itself lowest, the bytes before it above."""
    wide = np.ndarray(hi - lo, dtype=">u8", buffer=run, offset=lo - PAD, strides=(1,))
    return (wide & np.uint64(_mask(depth))).view(np.int64)


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) of every byte of words that stand alone.

    Words lie in ``data`` from ``at[k]`` to ``at[k + 1]``; an empty one is the end mark.
    """
    run, first = _run(data, at[:-1], at[1:], alone=True)
    size = np.diff(at) + 1
    place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return np.repeat(np.arange(len(size)), size), _keys(run, PAD, len(run), depth)[place - PAD] if len(size) else np.zeros(0, np.int64)


def text_grams(w: Words, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(how many, grams) of the texts, in order, in pieces of about SLICE bytes: every byte of each running text, contexts reaching over words."""
    ends = np.cumsum(w.per_text)
    start, end = np.insert(w.start, ends, 0), np.insert(w.end, ends, 0)  # an empty word ends each text
    run, first = _run(w.lowered, start, end, alone=False)
    last = first[ends + np.arange(w.count)]
    begin = np.concatenate([[PAD], last[:-1] + PAD + 1])
    for lo in range(PAD, len(run), SLICE):
        hi = min(lo + SLICE, len(run))
        many = np.maximum(np.minimum(last + 1, hi) - np.maximum(begin, lo), 0)
        real = np.ones(hi - lo, dtype=bool)
        behind = (last[:, None] + np.arange(1, PAD + 1)).ravel() - lo
        real[behind[(behind >= 0) & (behind < hi - lo)]] = False
        yield many, _keys(run, lo, hi, depth)[real]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = column.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of whole-numbered values of each."""
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    return key[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


class _Held:
    """Sums per gram, or word, that a task keeps before it passes them on."""

    def __init__(self, most: int | None = None) -> None:
        self.most = HELD_GRAMS if most is None else most
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, n, c))
        self.size += len(key)
        if self.size > 2 * self.most:
            self._merge()
            if self.size > self.most:
                # The more frequent half stays: its grams come again, the others seldom do.
                key, n, c = self.parts[0]
                stay = n > np.partition(n, self.size - self.most // 2)[self.size - self.most // 2]
                self.parts, self.size = [(key[stay], n[stay], c[stay])], int(stay.sum())
                yield from self._passed(key[~stay], n[~stay], c[~stay])

    def _merge(self) -> None:
        columns = [np.concatenate([p[k] for p in self.parts]) for k in range(3)]
        self.parts.clear()
        self.parts.append(_sums(*columns))
        self.size = len(self.parts[0][0])

    @staticmethod
    def _passed(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "n", "c"])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            yield from self._passed(*self.parts[0])
        self.parts, self.size = [], 0


def _dealt(sums: pa.RecordBatch, word: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """Sums dealt out by a hash of their key: a row for each part, which holds keys and counts as bytes."""
    columns = [x.to_numpy() for x in sums.columns]
    part = mix(columns[0].view(np.uint64)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(at))
    packed = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), parts, [None, pa.py_buffer(at * 8), pa.py_buffer(x[order])]).take(pa.array(full)).cast(pa.binary()) for x in columns]
    out = pa.RecordBatch.from_arrays([pa.array(np.full(len(full), word)), pa.array(full, pa.int32()), *packed], names=["word", "part", "key", "n", "c"])
    step = max(1, PIECE_KEYS * len(full) // max(1, len(order)))
    for lo in range(0, len(full), step):
        yield out.slice(lo, step)


def text_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(word, key, n, c) from (text, train): occurrences in all texts and in those to learn from.

    Rows of words bear the word's hash, the empty word's for the ends of texts;
    the others are bytes after their contexts.  A task passes its sums on in
    pieces dealt out by key, so that neither its rows nor its keys are handled
    one by one on their way.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: _Held(HELD_WORDS), False: _Held()}
        raw, filled = np.empty(RAW_GRAMS, dtype=np.int64), 0

        def add(word: bool, *sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for b in held[word].add(*sums):
                yield from _dealt(b, word, parts)

        def marked(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Key and counts from keys whose lowest bit tells what is learnt from."""
            mark.sort()
            starts = np.flatnonzero(np.concatenate([[True], (mark[1:] ^ mark[:-1]) > 1]))
            return mark[starts] >> 1, np.diff(starts, append=len(mark)), np.add.reduceat(mark & 1, starts)

        for batch in batches:
            train = np.array(batch.column(1).to_pylist(), dtype=bool)
            if batch.num_rows:
                yield from add(True, NO_WORD, np.array([batch.num_rows]), np.array([train.sum()], dtype=np.int64))
            for w in words(batch.column(0)):
                if len(w.hash):
                    order = np.argsort(w.hash)
                    h = w.hash[order]
                    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    taught = train[w.first + w.text[order]].astype(np.int64)
                    yield from add(True, h[starts].view(np.int64), np.diff(starts, append=len(h)), np.add.reduceat(taught, starts))
                for many, key in text_grams(w, depth):
                    key = key << 1 | np.repeat(train[w.first:w.first + w.count], many)
                    if filled and filled + len(key) > len(raw):
                        yield from add(False, *marked(raw[:filled]))
                        filled = 0
                    if len(key) > len(raw):
                        yield from add(False, *marked(key))
                    else:
                        raw[filled:filled + len(key)] = key
                        filled += len(key)
        if filled:
            yield from add(False, *marked(raw[:filled]))
        for word, sums in held.items():
            for b in sums.flush():
                yield from _dealt(b, word, parts)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pieces)
        for word in (True, False):
            mine = table.filter(pc.equal(table.column("word"), word))
            key, *sums = _sums(*(np.frombuffer(b"".join(x.as_buffer() for x in mine.column(k)), dtype=np.int64) for k in ("key", "n", "c")))
            for lo in range(0, len(key), 100_000):
                some = [pa.array(x[lo:lo + 100_000]) for x in (key, *sums)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), word)), *some], names=["word", "key", "n", "c"])

    pieces = pa.schema([("word", pa.bool_()), ("key", pa.binary()), ("n", pa.binary()), ("c", pa.binary())])
    dealt = docs.select("text", "train").mapInArrow(run, "word boolean, part int, key binary, n binary, c binary")
    return dealt.repartitionById(parts, "part").drop("part").mapInArrow(together, "word boolean, key long, n long, c long")


def _word_gram_counts(counts: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            word, key = grams(*_trimmed(batch.column(0)), depth)
            for b in held.add(key, *(batch.column(k).to_numpy()[word] for k in (1, 2))):
                yield from pieces(b)
        for b in held.flush():
            yield from pieces(b)

    def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, b.num_rows, 100_000):
            yield b.slice(lo, 100_000)
    partial = counts.select("word", "n", "c").mapInArrow(run, "gram long, n long, c long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("c").cast("double").alias("c"))


def _trimmed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = _binary(column)
    return data[at[0]:at[-1]], at - at[0]


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by gram, cut where the context changes."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        context = table.column("gram").to_numpy() >> 8
        cut = int(np.searchsorted(context, context[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _nodes(gram: np.ndarray, c: np.ndarray, below: list[np.ndarray] | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(f, kt, own, seen) of the sorted grams of whole contexts of one depth, for each of the eight bits.

    ``below`` holds the log probabilities of the subtrees below, None at the
    deepest; ``f`` those of this depth's, each node's value standing in the row
    of its least byte.  ``kt`` is the estimate of the bit, ``own`` this depth's
    share of the mixture and ``seen`` whether the node has counts.
    """
    f = []
    kt, own, seen = (np.ones((len(gram), 8)) for _ in range(3))
    for k in BITS:
        node, child = gram >> (8 - k), gram >> (7 - k)
        new, split = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (node, child))
        starts, inside = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(c, starts)
        # The child that begins a node, and the rest of it.
        mine = np.add.reduceat(c, np.flatnonzero(split))[np.cumsum(split) - 1]
        first = mine[starts]
        estimate = kt_log(first, total - first)
        value = estimate
        if below is not None:
            value = np.logaddexp(estimate, np.add.reduceat(below[k], starts)) - np.log(2)
            own[:, k] = np.exp(np.minimum(estimate - np.log(2) - value, 0.0))[inside]
        at = np.zeros(len(gram))
        at[starts] = value
        f.append(at)
        kt[:, k] = (mine + 0.5) / (total[inside] + 1.0)
        seen[:, k] = (total > 0)[inside]
    return f, kt, own, seen


def _lists(*parts: np.ndarray) -> list[pa.Array]:
    return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64())) for x in parts]


def _level(rows: DataFrame, deepest: bool) -> DataFrame:
    """(gram, f0-f7, kt, own, seen) of one depth from (gram, c[, g0-g7])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_contexts(batches):
            gram, c = table.column("gram").to_numpy(), table.column("c").to_numpy()
            f, *shares = _nodes(gram, c, None if deepest else [table.column(f"g{k}").to_numpy() for k in BITS])
            yield pa.RecordBatch.from_arrays([pa.array(gram), *[pa.array(x) for x in f], *_lists(*shares)], names=["gram", *[f"f{k}" for k in BITS], "kt", "own", "seen"])
    schema = "gram long, " + ", ".join(f"f{k} double" for k in BITS) + ", kt array<double>, own array<double>, seen array<double>"
    sorted_rows = rows.withColumn("context", F.shiftright("gram", 8)).repartition("context").sortWithinPartitions("gram").drop("context")
    return sorted_rows.mapInArrow(run, schema)


def _mask(depth: int) -> int:
    """The bits of a gram with so many bytes of context."""
    return (1 << 8 * (depth + 1)) - 1


def _blocks(gram: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole contexts of JOINED bytes, about BLOCK_GRAMS at a time."""
    context = (gram & _mask(JOINED)) >> 8
    order = np.argsort(context, kind="stable")
    gram, c, context = gram[order], c[order], context[order]
    lo = 0
    while lo < len(gram):
        hi = int(np.searchsorted(context, context[min(lo + BLOCK_GRAMS, len(gram)) - 1], side="right"))
        at = np.argsort(gram[lo:hi])
        yield gram[lo:hi][at], c[lo:hi][at]
        lo = hi


def _climb(gram: np.ndarray, c: np.ndarray, depth: int, keep: bool) -> tuple[list[tuple], tuple]:
    """The levels below JOINED, deepest first, as (kt, own, seen, row above), and (gram, c, below) of depth JOINED."""
    levels, below = [], None
    for d in range(depth, JOINED, -1):
        f, *shares = _nodes(gram, c, below)
        gram, up = np.unique(gram & _mask(d - 1), return_inverse=True)
        c = np.bincount(up, weights=c, minlength=len(gram))
        below = [np.bincount(up, weights=x, minlength=len(gram)) for x in f]
        if keep:
            levels.append((*shares, up))
    return levels, (gram, c, below)


def _rolled_up(rows: DataFrame, depth: int) -> DataFrame:
    """(gram, c, g0-g7) of depth JOINED from (part, gram, c) of the deepest."""
    def up(table: pa.Table) -> pa.Table:
        out = []
        for gram, c in _blocks(table.column("gram").to_numpy(), table.column("c").to_numpy()):
            _, (above, total, below) = _climb(gram, c, depth, keep=False)
            out.append(pa.table({"gram": above, "c": total, **{f"g{k}": below[k] for k in BITS}}))
        return pa.concat_tables(out)
    return rows.groupBy("part").applyInArrow(up, "gram long, c double, " + ", ".join(f"g{k} double" for k in BITS))


def _handed_down(rows: DataFrame, state: DataFrame, depth: int) -> DataFrame:
    """(gram, logp) of the deepest grams from those and the state of depth JOINED, both with their part."""
    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if not left.num_rows:
            return pa.table({"gram": pa.array([], pa.int64()), "logp": pa.array([], pa.float64())})
        known = right.column("gram").to_numpy()
        order = np.argsort(known)
        given = [_matrix(right.column(x).combine_chunks()) for x in ("acc", "rem", "last")]
        for gram, c in _blocks(left.column("gram").to_numpy(), left.column("c").to_numpy()):
            levels, (above, _, _) = _climb(gram, c, depth, keep=True)
            at = order[np.searchsorted(known, above, sorter=order)]
            acc, rem, last = (x[at] for x in given)
            for kt, own, seen, up in reversed(levels):
                acc, rem, last = _taken(kt, own, seen, acc[up], rem[up], last[up])
            out.append(pa.table({"gram": gram, "logp": np.log10(acc + rem * last).sum(axis=1)}))
        return pa.concat_tables(out)
    return rows.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(down, "gram long, logp double")


def _taken(kt: np.ndarray, own: np.ndarray, seen: np.ndarray, acc: np.ndarray, rem: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """A depth takes its share of what is still to give."""
    new = seen > 0
    return acc + rem * np.where(new, own * kt, last), np.where(new, rem * (1 - own), 0.0), np.where(new, kt, last)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, 8)


def _down(levels: list[DataFrame]) -> DataFrame:
    """(gram, acc, rem, last) of the deepest of these levels: what is given to the byte's bits so far, what is still to give, the last estimate.

    From the root down: each depth takes its share of what is still to give.  A
    node never seen leaves the rest to the estimate of the depth above it.
    """
    schema = "gram long, acc array<double>, rem array<double>, last array<double>"

    def _state(gram: pa.Array, *parts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([gram, *_lists(*parts)], names=["gram", "acc", "rem", "last"])

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kt, own = _matrix(b.column(1)), _matrix(b.column(2))
            yield _state(b.column(0), own * kt, 1 - own, kt)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _state(b.column(0), *_taken(*(_matrix(b.column(k)) for k in range(1, 7))))

    state = levels[0].select("gram", "kt", "own").mapInArrow(root, schema)
    for d in range(1, len(levels)):
        above = stored(state, f"state-{d}").withColumnRenamed("gram", "above")
        here = levels[d].select("gram", "kt", "own", "seen").withColumn("above", F.col("gram").bitwiseAND(F.lit(_mask(d - 1))))
        state = here.join(above, "above").select("gram", "kt", "own", "seen", "acc", "rem", "last").mapInArrow(step, schema)
    return state


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, logp) from stored (gram, n, c): log10 probability of the byte after its context, by the tree of all counts ``c``."""
    if not 0 <= depth <= 6:
        raise ValueError("a gram holds up to six bytes of context")
    top, deep = min(depth, JOINED), None
    rows = counts.select("gram", "c")
    if depth > JOINED:
        parts = max(1, -(-counts.count() // PART_GRAMS))
        part = F.pmod(F.xxhash64(F.shiftright(F.col("gram").bitwiseAND(F.lit(_mask(JOINED))), 8)), F.lit(parts)).alias("part")
        deep = rows.select(part, "gram", "c")
        rows = stored(_rolled_up(deep, depth), f"rolled-{JOINED}")
    levels: list[DataFrame] = []
    for d in range(top, -1, -1):
        level = stored(_level(rows, d == depth), f"level-{d}")
        levels.insert(0, level)
        if d:
            kept = F.col("gram").bitwiseAND(F.lit(_mask(d - 1))).alias("gram")
            rows = level.join(rows.select("gram", "c"), "gram").groupBy(kept).agg(F.sum("c").alias("c"), *[F.sum(f"f{k}").alias(f"g{k}") for k in BITS])
            rows = stored(rows, f"rolled-{d - 1}")
    state = _down(levels)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b.column(1)) + _matrix(b.column(2)) * _matrix(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.log10(p).sum(axis=1))], names=["gram", "logp"])

    if deep is None:
        logp = state.mapInArrow(total, "gram long, logp double")
    else:
        logp = _handed_down(deep, stored(state, "state").select(part, "gram", "acc", "rem", "last"), depth)
    return counts.select("gram", "n").join(stored(logp, "predictions"), "gram")


def word_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, n, c, logp): log10 probability of each distinct word standing alone, by the tree of all training words."""
    logp = stored(gram_scores(stored(_word_gram_counts(counts, depth), "grams"), depth), "word-grams").select("gram", "logp")
    groups = -(-counts.count() // GROUP_WORDS)
    grouped = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(max(1, groups))))

    def distinct(table: pa.Table) -> pa.Table:
        _, key = grams(*_trimmed(table.column("word").combine_chunks()), depth)
        key = np.unique(key)
        return pa.table({"part": pa.array(np.full(len(key), table.column("part")[0].as_py(), dtype=np.int64)), "gram": pa.array(key)})

    wanted = grouped.groupBy("part").applyInArrow(distinct, "part long, gram long")
    found = wanted.join(logp, "gram").select("part", "gram", "logp")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value = right.column("gram").to_numpy(), right.column("logp").to_numpy()
        order = np.argsort(key)
        word, gram = grams(*_trimmed(left.column("word").combine_chunks()), depth)
        per = np.bincount(word, weights=value[order][np.searchsorted(key[order], gram)], minlength=left.num_rows)
        return left.select(["word", "n", "c"]).append_column("logp", pa.array(per))
    return grouped.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(add, "word binary, n long, c long, logp double")


class _Lookup:
    """Values by whole-numbered key, in an open table at most half full; keys given first are found first."""

    def __init__(self, key: np.ndarray, *values: np.ndarray) -> None:
        bits = max(4, int(2 * len(key)).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        # What stands in free places is no key; their values are NaN, so whoever asks for it finds nothing either.
        self._free = next(x for x in range(-1, -len(key) - 2, -1) if not (key == x).any())
        self._key = np.full(1 << bits, self._free, dtype=np.int64)
        at, left = self._home(key), np.arange(len(key))
        while len(left):
            can = left[self._key[at[left]] == self._free][::-1]
            self._key[at[can]] = key[can]  # the last of equal places is kept
            left = left[self._key[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self._last
        self._values = [np.full(1 << bits, np.nan) for _ in values]
        for mine, value in zip(self._values, values, strict=True):
            mine[at] = value

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def __call__(self, key: np.ndarray) -> list[np.ndarray]:
        """The values of these keys, NaN where there is none."""
        at = self._home(key)
        there = self._key[at]
        off = np.flatnonzero(there != key)
        there = there[off]
        while len(off):
            off = off[there != self._free]
            at[off] = (at[off] + 1) & self._last
            there = self._key[at[off]]
            wrong = there != key[off]
            off, there = off[wrong], there[wrong]
        return [v[at] for v in self._values]


def _hot_from(table: DataFrame, most: int) -> int:
    """The power of two of occurrences from which on rows are frequent: at most so many, and 64 if none are."""
    sizes = {r["b"]: r["count"] for r in table.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()}
    hot_from, held = 64, 0
    for b in sorted(sizes, reverse=True):
        held += sizes[b]
        if held > most:
            break
        hot_from = b
    return hot_from


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of ``docs``.

    The model and the counts come from all rows where ``train`` holds (null
    counts as not).  ``base_score`` is the smoothed unigram log10 probability of
    the tokens, ``score`` the tree's.  ``n_bytes`` are those coded: words, a
    border after each, and the end.  Frequent words, at most HOT_WORDS by
    a power-of-two threshold on their occurrences, are looked up in place; the
    others are joined, and none of those is frequent enough to skew the join.
    The same goes for grams, at most HOT_GRAMS.

    A null or empty text is the end mark alone; rows with null or repeated ids
    are scored one by one.  With nothing to learn from, counts are zero and
    every bit has probability one half.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    seen = stored(text_counts(base, depth), "counts")
    counts = seen.filter("word").select(F.col("key").alias("h"), "n", "c")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.sum((F.col("c") > 0).cast("long"))).first()
    tokens, distinct = int(total[0]), int(total[1] or 0)
    floor = tokens + 0.5 * (distinct + 1)
    table = counts.select("h", "n", F.log10((F.col("c") + 0.5) / floor).alias("base"), (F.col("c") > 0).cast("double").alias("known"))
    grams_seen = seen.filter(~F.col("word")).select(F.col("key").alias("gram"), "n", F.col("c").cast("double").alias("c"))
    tree = stored(gram_scores(grams_seen, depth), "gram-scores")
    is_hot, hot_gram = (F.floor(F.log2("n")) >= _hot_from(t, most) for t, most in ((table, HOT_WORDS), (tree, HOT_GRAMS)))

    def most_frequent(t: pa.Table) -> list[np.ndarray]:
        n, *columns = (t.column(k).to_numpy() for k in range(t.num_columns))
        order = np.argsort(-n)
        return [x[order] for x in columns]
    sent = docs.sparkSession.sparkContext.broadcast((_Lookup(*most_frequent(table.filter(is_hot).select("n", "h", "base", "known").toArrow())),
                                                     _Lookup(*most_frequent(tree.filter(hot_gram).select("n", "gram", "logp").toArrow()))))
    end = table.filter(F.col("h") == int(NO_WORD[0])).first()
    end_base, end_known = (end["base"], end["known"]) if end else (0.0, 0.0)

    def lists(values: np.ndarray, owner: np.ndarray, count: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word, of_gram = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for w in words(batch.column(1)):
                wanted = w.hash.view(np.int64)
                values = of_word(wanted)
                hit = ~np.isnan(values[0])
                sums = [np.bincount(w.text[hit], weights=v[hit], minlength=w.count) for v in values]
                size, total, cold = np.zeros(w.count, np.int64), np.zeros(w.count), []
                for many, key in text_grams(w, depth):
                    value, = of_gram(key)
                    rest = np.flatnonzero(np.isnan(value))
                    value[rest] = 0.0
                    text = np.repeat(np.arange(w.count), many)
                    size += many
                    total += np.bincount(text, weights=value, minlength=w.count)
                    cold.append((key[rest], text[rest]))
                part = batch.slice(w.first, w.count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + w.count)), part.column(0), part.column(2), pa.array(w.per_text.astype(np.int64) + 1), pa.array(size),
                     pa.array(sums[1] + end_known), pa.array(sums[0] + end_base), pa.array(total),
                     lists(wanted[~hit], w.text[~hit], w.count), lists(*(np.concatenate([c[k] for c in cold]) for k in (0, 1)), w.count)],
                    names=["row", "doc_id", "train", "n_tokens", "n_bytes", "known", "base", "logp", "rare", "cold"])
                row += w.count

    seen = stored(base.mapInArrow(run, "row long, doc_id long, train boolean, n_tokens long, n_bytes long, known double, base double, logp double, rare array<long>, cold array<long>"), "scored")
    sent.unpersist()
    more = (seen.select("row", F.explode("rare").alias("h")).join(table.filter(~is_hot).drop("n"), "h").groupBy("row")
            .agg(F.sum("base").alias("b"), F.sum("known").alias("k")))
    deeper = (seen.select("row", F.explode("cold").alias("gram")).join(tree.filter(~hot_gram).drop("n"), "gram").groupBy("row")
              .agg(F.sum("logp").alias("l")))
    out = seen.drop("rare", "cold").join(more, "row", "left").join(deeper, "row", "left")
    scored = F.col("logp") + F.coalesce("l", F.lit(0.0))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), scored.alias("score"),
        "n_bytes", (-scored * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))
