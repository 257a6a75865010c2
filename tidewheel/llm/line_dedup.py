"""Line deduplication by a segment-partition edit join.

A line of length l is split into threshold + 1 segments; a line within the
threshold must hold one of them unchanged near its place.  Distinct lines index
their segments and probe the substrings that lengths and positions allow; lines
that meet are verified with a banded, bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._graph import bucket_links
from tidewheel.llm._groups import in_blocks, sorted_groups
from tidewheel.llm._store import free_name, small_side, stored
from tidewheel.llm._words import RangeHash, mix

MIN_CHARS = 15        # shorter lines are never duplicates
MAX_EDITS = 2
BLOCK = 128           # lines of a bucket that one task compares with as many others

_BLANK = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint32)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offset of each."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, dtype=np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _lines(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, end) of every line, blanks trimmed at both ends."""
    breaks = np.flatnonzero(points == 10)
    owner = np.searchsorted(at, breaks, side="right") - 1
    n = len(at) - 1
    start = np.concatenate([at[:-1], breaks + 1])
    end = np.concatenate([at[1:], breaks])
    text = np.concatenate([np.arange(n), owner])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    # A line ends where the next one of its text starts, less the break.
    last = np.ones(len(text), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    end = np.where(last, at[text + 1], np.concatenate([start[1:] - 1, [0]]))
    number = np.arange(len(text)) - np.searchsorted(text, text)
    solid = ~np.isin(points, _BLANK)
    seen = np.concatenate([[0], np.cumsum(solid)])
    spots = np.flatnonzero(solid)
    lo, hi = seen[start], seen[end]
    some = hi > lo
    start = np.where(some, spots[np.minimum(lo, max(0, len(spots) - 1))] if len(spots) else start, start)
    end = np.where(some, spots[np.maximum(hi - 1, 0)] + 1 if len(spots) else start, start)
    return text, number, start, end


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the ``edits`` + 1 nearly equal segments of a line."""
    parts = edits + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, indexed: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line to look up among lines of ``indexed`` characters.

    A shared segment is kept only where the edits before it and after it can
    both stay within their share of the threshold.
    """
    more = length - indexed
    out = []
    for i, (p, n) in enumerate(segments(indexed, edits)):
        left, right = i, edits - i
        lo = max(p - left, p + more - right, 0)
        hi = min(p + left, p + more + right, length - n)
        out += [(i, q, n) for q in range(lo, hi + 1)]
    return out


def _keys(ranges: RangeHash, start: np.ndarray, size: np.ndarray, edits: int, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): every segment and probe of the lines, by their place in ``start``; ``probes`` for all lines at once.

    Lines of under ``least`` characters are not indexed.
    """
    parts, line_parts, key_parts = edits + 1, [], []
    for more in range(edits + 1):
        indexed = size - more
        short, longer = np.divmod(indexed, parts)
        for i in range(parts):
            extra = np.maximum(0, i - (parts - longer))
            p, n = i * short + extra, short + (i >= parts - longer)
            left, right = i, edits - i
            lo = np.maximum(np.maximum(p - left, p + more - right), 0)
            hi = np.minimum(np.minimum(p + left, p + more + right), size - n)
            for off in range(2 * edits + 1):
                here = np.flatnonzero((lo + off <= hi) & (indexed >= least))
                if not len(here):
                    break
                at = start[here] + lo[here] + off
                key_parts.append(mix(ranges(at, at + n[here]) + (indexed[here] * 64 + i).astype(np.uint64)))
                line_parts.append(here)
    if not line_parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line, key = np.concatenate(line_parts), np.concatenate(key_parts)
    order = np.argsort(line, kind="stable")
    return line[order], key[order]


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``.

    A pair's state is one word per error count, with a bit for each of the
    2 * edits + 1 diagonals of the band; all pairs advance together over what
    lies between their common prefix and suffix, until none can still match.
    """
    pa_, at = _code_points(a)
    pb, bt = _code_points(b)
    la, lb = np.diff(at), np.diff(bt)
    out = np.zeros(len(a), dtype=bool)
    at, bt = at[:-1].copy(), bt[:-1].copy()
    for k in np.flatnonzero(np.abs(la - lb) <= edits):
        x, y, m = pa_[at[k]:at[k] + la[k]], pb[bt[k]:bt[k] + lb[k]], min(la[k], lb[k])
        differ = x[:m] != y[:m]
        head = int(differ.argmax()) if differ.any() else m
        differ = (x[len(x) - (m - head):] != y[len(y) - (m - head):])[::-1]
        tail = int(differ.argmax()) if differ.any() else m - head
        at[k], bt[k], la[k], lb[k] = at[k] + head, bt[k] + head, la[k] - head - tail, lb[k] - head - tail
    near = np.flatnonzero(np.abs(la - lb) <= edits)
    order = near[np.argsort(la[near], kind="stable")]
    width, all_bits = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 4096 and (hi - lo) * int(la[order[hi]]) < 1 << 21 and la[order[hi]] <= 2 * la[order[lo]] + 16:
            hi += 1
        some = order[lo:hi]
        lo = hi
        n = int(la[some].max()) if len(some) else 0
        # Padded so that positions beyond a line never match.
        A = np.full((len(some), n + 1), 0xFFFFFFFF, dtype=np.uint32)
        B = np.full((len(some), n + 3 * edits + 2), 0xFFFFFFFE, dtype=np.uint32)
        for r, k in enumerate(some):
            A[r, :la[k]] = pa_[at[k]:at[k] + la[k]]
            B[r, edits:edits + lb[k]] = pb[bt[k]:bt[k] + lb[k]]
        end = lb[some] - la[some] + edits
        # Per position of a: where the band matches, and bits that stand for characters of b (bit k for i + 1 + k - edits of them).
        matches, inside = np.zeros((2, n, len(some)), dtype=np.uint32)
        for k in range(width):
            matches |= (A[:, :n] == B[:, k:k + n]).T.astype(np.uint32) << np.uint32(k)
            place = np.arange(n, dtype=np.int64)[:, None] + (1 + k - edits)
            inside |= ((place >= 0) & (place <= lb[some])).astype(np.uint32) << np.uint32(k)
        ends = np.searchsorted(la[some], np.arange(n + 2))
        state = [np.full(len(some), 1 << edits, dtype=np.uint32)]
        for _ in range(edits):
            state.append(state[-1] | (state[-1] << np.uint32(1)) & np.uint32(all_bits))
        done = np.zeros(len(some), dtype=bool)
        done[la[some] == 0] = (state[edits][la[some] == 0] >> end[la[some] == 0].astype(np.uint32) & 1) > 0
        for i in range(n):
            equal, ok = matches[i], inside[i]
            new = [state[0] & equal & ok]
            for d in range(1, edits + 1):
                moved = (state[d] & equal) | state[d - 1] | (state[d - 1] >> np.uint32(1)) | (new[d - 1] << np.uint32(1))
                new.append(moved & ok)
            state = new
            if not state[edits].any():
                break
            first, last = ends[i + 1], ends[i + 2]
            if first < last:
                done[first:last] = (state[edits][first:last] >> end[first:last].astype(np.uint32) & 1) > 0
        out[some] = done
    return out


def _batches(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    texts, lo, total = [], 0, 0
    for k, v in enumerate(batch.column(1)):
        t = v.as_py() or ""
        if texts and total + len(t) > size:
            yield lo, texts
            texts, lo, total = [], k, 0
        texts.append(t)
        total += len(t)
    if texts:
        yield lo, texts


def _verified(pairs: DataFrame, edits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield batch.select([0, 1]).filter(pa.array(near))
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS,
                   min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, n_chars, rep_doc_id, rep_line_no): one row per line that repeats an earlier one.

    Lines are split at line feeds and trimmed.  Lines of at least ``min_chars``
    characters are duplicates when their edit distance is at most ``edits``;
    classes are connected through such links.  The first line of a class, by (doc_id, line_no), is not
    reported.  Documents without id, and null or empty texts, report nothing.
    Rows that repeat an id and a text are one document; different texts of one id
    count their lines each on its own.  Any other columns are
    ignored; an empty table gives an empty result.
    """
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, texts in _batches(batch):
                points, at = _code_points(texts)
                text, number, start, end = _lines(points, at)
                long = end - start >= min_chars
                text, number, start, end = text[long], number[long], start[long], end[long]
                ranges = RangeHash(points)
                h1 = ranges(start, end)
                h2 = RangeHash(points ^ np.uint32(0x2A5F13))(start, end)
                line, key = _keys(ranges, start, end - start, edits, min_chars)
                counts = np.bincount(line, minlength=len(start))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + text]), pa.array(number.astype(np.int32)), pa.array((end - start).astype(np.int64)),
                     pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)))],
                    names=["doc_id", "line_no", "n_chars", "h1", "h2", "keys"])

    seen = stored(base.mapInArrow(split, "doc_id long, line_no int, n_chars long, h1 long, h2 long, keys array<long>"), "lines")
    place = F.struct("doc_id", "line_no")
    classes = stored(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.min_by("keys", place).alias("keys")), "distinct-lines")
    rows = classes.select(F.col("h1").alias("node"), F.explode("keys").alias("key"))
    firsts = classes.select("h1", "first.doc_id", "first.line_no")

    def line_texts(nodes: DataFrame) -> DataFrame:
        wanted = stored(firsts.join(nodes, "h1").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1")).alias("wanted")), "wanted")
        found = base.join(small_side(wanted, F.lit(32) + 24 * F.size("wanted")), "doc_id").select("doc_id", "text", "wanted")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def checked(hashes: list[int], lines: list[str]) -> pa.RecordBatch:
                # Another text of the same id may have another line in that place.
                points, at = _code_points(lines)
                same = pa.array(RangeHash(points)(at[:-1], at[1:]).view(np.int64) == np.array(hashes, dtype=np.int64))
                return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(lines, pa.string())], names=["h1", "line"]).filter(same)

            for batch in batches:
                hashes, found, total = [], [], 0
                for text, want in zip(batch.column(1), batch.column(2), strict=True):
                    lines = (text.as_py() or "").split("\n")
                    for w in want.as_py():
                        if w["line_no"] < len(lines):
                            hashes.append(w["h1"])
                            found.append(lines[w["line_no"]].strip(" \t\n\v\f\r"))
                            total += len(found[-1])
                            if total > 1 << 20:
                                yield checked(hashes, found)
                                hashes, found, total = [], [], 0
                if found:
                    yield checked(hashes, found)

        return stored(found.mapInArrow(fetch, "h1 long, line string").distinct(), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        texts = line_texts(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct())
        both = (pairs.join(texts.select(F.col("h1").alias("a"), F.col("line").alias("ta")), "a")
                .join(texts.select(F.col("h1").alias("b"), F.col("line").alias("tb")), "b"))
        return _verified(both, edits).distinct()

    def compare(split: DataFrame) -> DataFrame:
        texts = line_texts(split.select(F.col("node").alias("h1")).distinct()).withColumnRenamed("h1", "node")
        sizes = split.groupBy("key").agg(F.count("*").alias("n"))
        posted = in_blocks(split.join(texts, "node"), sizes, ["key"], "node", BLOCK).select("key", "i", "j", "mine", "node", "line")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Pairs of several groups are verified together; places count rows over those groups.
            ids: list[np.ndarray] = []
            lines: list[str] = []
            pairs: list[np.ndarray] = []

            def linked() -> pa.RecordBatch:
                every, p = np.concatenate(ids), np.concatenate(pairs, axis=1)
                p = p[:, within([lines[k] for k in p[0]], [lines[k] for k in p[1]], edits)]
                label = every.copy()
                while True:
                    new = label.copy()
                    np.minimum.at(new, p[0], label[p[1]])
                    np.minimum.at(new, p[1], label[p[0]])
                    if (new == label).all():
                        break
                    label = new
                some = label != every
                return pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(label[some])], names=["a", "b"])

            for g in sorted_groups(batches, 3):
                side, own = g.column(3).to_numpy(), g.column(5).to_pylist()
                a, b = np.triu_indices(len(own), 1)
                if g.column(1)[0].as_py() != g.column(2)[0].as_py():
                    a, b = a[side[a] != side[b]], b[side[a] != side[b]]
                size = np.array([len(x) for x in own])
                close = np.abs(size[a] - size[b]) <= edits
                pairs.append(np.stack([a[close], b[close]]) + len(lines))
                ids.append(g.column(4).to_numpy())
                lines += own
                if sum(x.shape[1] for x in pairs) > 16384:
                    yield linked()
                    ids, lines, pairs = [], [], []
            if ids:
                yield linked()
        return stored(posted.mapInArrow(run, "a long, b long").distinct(), "more-links")

    groups = bucket_links(rows, verify, compare)
    named = classes.select("h1", "h2", "first").join(groups.withColumnRenamed("node", "h1"), "h1", "left")
    # A line without links is a class of its own, by both its hashes.
    alone = F.col("component").isNull()
    named = named.withColumn("part", F.struct(F.coalesce("component", "h1").alias("c"), F.when(alone, F.col("h2")).otherwise(0).alias("d"), alone.alias("e")))
    named = stored(named.select("h1", "h2", "first", "part"), "named")
    reps = named.groupBy("part").agg(F.min("first").alias("rep"))
    named = named.join(reps, "part").select("h1", "h2", "rep")
    return (seen.drop("keys").distinct().join(named, ["h1", "h2"])
            .filter((F.col("rep.doc_id") != F.col("doc_id")) | (F.col("rep.line_no") != F.col("line_no")))
            .select("doc_id", "line_no", "n_chars", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.line_no").alias("rep_line_no")))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                           edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, all columns kept, with repeated lines cut from the texts and ``length_col`` counted anew.

    A document of which nothing but blanks is left is dropped, as all of it
    stands in earlier documents; one that never had text stays, and so does
    any document without a repeated line, unchanged.
    """
    key, gone, rest = (free_name(docs, n) for n in ("cut_of", "cut_lines", "text_left"))
    cut = (repeated_lines(docs, id_col=id_col, text_col=text_col, edits=edits, min_chars=min_chars)
           .groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone)))
    out = docs.join(cut, docs[id_col].cast("long") == F.col(key), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, k: ~F.array_contains(gone, k)), "\n")
    out = out.withColumn(rest, F.when(F.col(gone).isNotNull(), left).otherwise(F.col(text_col)))
    out = out.filter(F.col(gone).isNull() | F.col(rest).rlike(r"[^\x20\x09-\x0D]"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(rest).alias(c))
        elif c == length_col:
            cols.append(F.when(F.col(gone).isNotNull(), F.char_length(rest).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
