"""Packing documents into sequences by cutting-stock column generation.

The rest of each document beyond whole sequences falls into a length class.  A
linear program over patterns (which classes share a sequence) is solved on the
histogram of classes; new patterns are priced by a knapsack dynamic program.
Rounded down, the patterns are dealt to documents by their rank in the class,
and the few documents left over are laid end to end and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._bpe import WordTokens
from tidewheel.llm._store import small_side, stored

GAP = 2e-3      # the linear program is solved to this share above its lower bound
ROUNDS = 60    # and with at most so many knapsacks
_loaded: dict[str, WordTokens] = {}


def class_length(n: np.ndarray) -> np.ndarray:
    """Lengths rounded up to multiples of 4, 8 or 16, so that classes stay few."""
    n = np.asarray(n, dtype=np.int64)
    step = np.select([n <= 64, n <= 256], [4, 8], 16)
    return -(-n // step) * step


def best_patterns(lengths: np.ndarray, values: np.ndarray, capacity: int, most: int = 40) -> np.ndarray:
    """The most valuable filling of ``capacity`` with each length in turn, best first: counts per length.

    One knapsack dynamic program over all capacities prices them all.
    """
    unit = int(np.gcd.reduce(np.append(lengths, capacity)))
    sizes, room = lengths // unit, capacity // unit
    worth, pick = np.zeros(room + 1), np.full(room + 1, -1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        if fits[c]:
            got = worth[c - sizes[:fits[c]]] + values[:fits[c]]
            k = int(got.argmax())
            if got[k] > worth[c] + 1e-12:
                worth[c], pick[c] = got[k], k
    out = []
    for k in np.argsort(-(values + worth[room - sizes]), kind="stable")[:most]:
        counts, c = np.zeros(len(lengths), dtype=np.int64), room - int(sizes[k])
        counts[k] += 1
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                counts[pick[c]] += 1
                c -= int(sizes[pick[c]])
        out.append(counts)
    return np.array(out)


def _random_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, n: int) -> np.ndarray:
    """Fillings drawn by how often lengths occur, the last item of each as long as fits: first columns of the master."""
    draw = np.random.default_rng(7)
    sizes, share = lengths, np.cumsum(demand / demand.sum())
    out = np.zeros((n, len(lengths)), dtype=np.int64)
    for row in out:
        room = capacity
        while True:
            fit = int(np.searchsorted(sizes, room, side="right"))
            if not fit:
                break
            k = min(fit - 1, int(np.searchsorted(share, draw.random() * share[fit - 1])))
            k = fit - 1 if sizes[k] + sizes[0] > room else k
            row[k] += 1
            room -= sizes[k]
    return np.unique(out, axis=0)


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times), for ascending lengths: the basis of the linear program's solution and how often each pattern is used (fractions).

    The master takes the column of least reduced cost among those known; when
    none is left, the knapsack prices new ones, at the duals and at duals drawn
    half way towards those of the material bound.  It ends within GAP of a lower
    bound, or after ROUNDS knapsacks.
    """
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    inverse, times = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    material = lengths / capacity
    bound = float(material @ demand)
    pool = _random_patterns(lengths, demand, capacity, 6 * m).astype(float)
    pivots = rounds = 0
    while times.sum() > (1 + GAP) * bound and pivots < 60 * m:
        duals = inverse.sum(axis=0)
        values = pool @ duals
        column = pool[values.argmax()]
        if column @ duals <= 1 + 1e-7:
            if rounds == ROUNDS:
                break
            rounds += 1
            calm = best_patterns(lengths, np.maximum(0.5 * material + 0.5 * duals, 0), capacity)
            found = np.vstack([calm, best_patterns(lengths, duals, capacity)]).astype(float)
            column = found[(found @ duals).argmax()]
            if column @ duals <= 1 + GAP:
                break
            pool = np.unique(np.vstack([pool, found]), axis=0)
        enter = inverse @ column
        ratio = np.where(enter > 1e-9, times / np.where(enter > 1e-9, enter, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivots += 1
        if pivots % 100:
            pivot = inverse[out] / enter[out]
            inverse = inverse - np.outer(enter, pivot)
            inverse[out] = pivot
            times = times - ratio[out] * enter
            times[out] = ratio[out]
        else:  # against the drift of the updates
            inverse = np.linalg.inv(basis)
            times = inverse @ demand
        times = np.maximum(times, 0)
    return np.rint(basis).astype(np.int64).T, times


def rounded(patterns: np.ndarray, times: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Whole times per pattern: rounded down, then one more of each, largest fraction first, while documents last."""
    whole = np.floor(times + 1e-9).astype(np.int64)
    left = demand - whole @ patterns
    for p in np.argsort(whole - times, kind="stable"):
        if times[p] > whole[p] and (patterns[p] <= left).all():
            whole[p] += 1
            left -= patterns[p]
    return whole


class Plan:
    """Where the document of a given class and rank goes."""

    def __init__(self, classes: np.ndarray, demand: np.ndarray, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        keys, first, base, per = [], [], [], []
        used = np.zeros(len(classes), dtype=np.int64)
        if len(classes):
            patterns, times = cutting_stock(classes, demand, capacity)
            for pattern, n in zip(patterns, rounded(patterns, times, demand), strict=True):
                if not n:
                    continue
                for k in np.flatnonzero(pattern):
                    keys.append((int(classes[k]) << 44) + int(used[k]))
                    first.append(int(used[k]))
                    base.append(self.sequences)
                    per.append(int(pattern[k]))
                    used[k] += n * pattern[k]
                self.sequences += int(n)
        # The end of a class's dealt ranks: what follows is left over.
        for k, c in enumerate(classes):
            keys.append((int(c) << 44) + int(used[k]))
            first.append(0)
            base.append(-1)
            per.append(1)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.first, self.base, self.per = (np.array(x, dtype=np.int64)[order] for x in (keys, first, base, per))

    def place(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sequence of each document, -1 if left over."""
        at = np.searchsorted(self.keys, (cls << 44) + rank, side="right") - 1
        return np.where(self.base[at] < 0, -1, self.base[at] + (rank - self.first[at]) // self.per[at])


def _loader(path: str) -> WordTokens:
    """One tokenizer per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def _tokens(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per document: its ids, and its place within its partition and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = _loader(path), TaskContext.get().partitionId()
        seen = np.zeros(class_length(capacity) + 1, dtype=np.int64)
        row = whole = 0
        for batch in batches:
            texts, size, lo = [], 0, 0
            column = batch.column(1)
            for k in range(len(column)):
                texts.append(column[k].as_py() or "")
                size += len(texts[-1])
                if size < 1 << 20 and k + 1 < len(column):
                    continue
                ids = [x + int(end_id).to_bytes(model.dtype.itemsize, "little") for x in model.encode(texts)]
                n = np.array([len(x) // model.dtype.itemsize for x in ids], dtype=np.int64)
                cls = class_length(n % capacity)
                rank = np.zeros(len(n), dtype=np.int64)
                for i, c in enumerate(cls):
                    rank[i] = seen[c]
                    seen[c] += 1
                full = n // capacity
                before = whole + np.cumsum(full) - full
                whole += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(n)), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(np.arange(row, row + len(n))),
                     pa.array(n), pa.array(cls), pa.array(rank), pa.array(before), pa.array(ids, pa.binary()),
                     pa.array(np.full(len(n), model.dtype.itemsize, dtype=np.int32))],
                    names=["doc_id", "part", "row", "n", "cls", "rank", "full_before", "ids", "width"])
                row += len(n)
                texts, size, lo = [], 0, k + 1
    return docs.mapInArrow(run, "doc_id long, part long, row long, n long, cls long, rank long, full_before long, ids binary, width int")


def cuts(total: int, capacity: int) -> np.ndarray:
    """Where the run of left-over documents is cut: whole sequences, and powers of two for its end."""
    at = list(range(0, total, capacity))
    if total % capacity:
        place, rest = at[-1], total % capacity
        while rest:
            part = 1 << (rest.bit_length() - 1)
            place, rest = place + part, rest - part
            at.append(place)
        return np.array(at, dtype=np.int64)
    return np.array([*at, total], dtype=np.int64)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents.

    A document is its ids and ``end_id``.  Whole sequences are cut off its
    front; the rest shares a sequence by the plan, uncut, or is left over and
    cut where sequences end.  ``ids`` holds a piece's ids as little-endian
    32-bit integers.  Offsets of a sequence have no gap and start at 0.

    Every row is packed, those with null or repeated ids too; a null or empty
    text is ``end_id`` alone.  Other columns are ignored; an empty table gives
    an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = stored(_tokens(base, tokenizer, end_id, capacity), "tokens", compression="zstd")
    narrow = tokens.select("part", "row", "n", "cls", "rank", "full_before")
    counts = narrow.filter("cls > 0").groupBy("part", "cls").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = stored(counts.select("part", "cls", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shares")
    # At most as many rows as there are length classes.
    demand = shares.groupBy("cls").agg(F.sum("n").alias("n")).orderBy("cls").toPandas()
    plan = Plan(demand["cls"].to_numpy(dtype=np.int64), demand["n"].to_numpy(dtype=np.int64), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row, tail, cls, rank = (batch.column(k).to_numpy() for k in range(5))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(plan.place(cls, rank))],
                                             names=["part", "row", "tail", "sequence_id"])
    ranked = narrow.join(small_side(shares.select("part", "cls", "first")), ["part", "cls"])
    placed = ranked.select("part", "row", (F.col("n") % capacity).alias("tail"), "cls", (F.col("first") + F.col("rank")).alias("rank"))
    placed = stored(placed.mapInArrow(place, "part long, row long, tail long, sequence_id long"), "placed")

    inside = Window.partitionBy("sequence_id").orderBy("part", "row").rowsBetween(Window.unboundedPreceding, -1)
    dealt = placed.filter("sequence_id >= 0").select(
        "part", "row", F.col("tail").alias("length"), "sequence_id", F.coalesce(F.sum("tail").over(inside), F.lit(0)).alias("offset"))
    # Rounding leaves less than one copy of each pattern, whatever the number of documents, so one task can number them.
    rest = placed.filter("sequence_id < 0")
    total = int(rest.agg(F.coalesce(F.sum("tail"), F.lit(0))).first()[0])
    bounds, first = cuts(total, capacity), plan.sequences
    running = Window.orderBy("part", "row").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.select("part", "row", "tail", F.coalesce(F.sum("tail").over(running), F.lit(0)).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row, tail, at = (batch.column(k).to_numpy() for k in range(4))
            lo = np.searchsorted(bounds, at, side="right") - 1
            hi = np.searchsorted(bounds, at + tail, side="left")
            doc = np.repeat(np.arange(len(at)), hi - lo)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[doc]
            begin, end = np.maximum(at[doc], bounds[seq]), np.minimum(at[doc] + tail[doc], bounds[seq + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (part[doc], row[doc], begin - at[doc], end - begin, seq + first, begin - bounds[seq])],
                names=["part", "row", "skip", "length", "sequence_id", "offset"])
    pieces = rest.mapInArrow(cut, "part long, row long, skip long, length long, sequence_id long, offset long")
    pieces = pieces.union(dealt.select("part", "row", F.lit(0).cast("long").alias("skip"), "length", "sequence_id", "offset"))
    tails = pieces.groupBy("part", "row").agg(F.collect_list(F.struct("skip", "length", "sequence_id", "offset")).alias("pieces"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            got: list[list] = [[] for _ in names]
            held = 0
            for r in range(batch.num_rows):
                doc, part, n, full_before, data, width, tail = (batch.column(k)[r].as_py() for k in range(7))
                full = n // capacity
                spans = [(k * capacity, capacity, ((part + 1) << 40) + full_before + k, 0) for k in range(full)]
                spans += [(full * capacity + p["skip"], p["length"], p["sequence_id"], p["offset"]) for p in tail or []]
                ids = np.frombuffer(data, dtype=f"<u{width}").astype("<u4")
                for start, length, sequence, offset in spans:
                    for out, x in zip(got, (doc, start, length, n, sequence, offset, ids[start:start + length].tobytes()), strict=True):
                        out.append(x)
                    held += length
                if held > 1 << 20 or r + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in got[:-1]], pa.array(got[-1], pa.binary())], names=names)
                    got, held = [[] for _ in names], 0
    whole = tokens.select("part", "row", "doc_id", "n", "full_before", "ids", "width").join(tails, ["part", "row"], "left")
    return whole.select("doc_id", "part", "n", "full_before", "ids", "width", "pieces").mapInArrow(
        emit, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
