"""Alignment of two tokenizations of the same text by the byte ranges of their tokens.

Merging the sorted ends of A's and B's tokens gives their overlaps: every end
closes one overlap of an A token with a B token, and where both end, a link,
which also closes a group.  Merge-path diagonals cut a document's merging into
pieces of equal work: for the d-th merged end a binary search tells how many of
the first d ends are A's, without looking at other pieces.  Pieces are rows of
a table, so a long document is merged by many tasks; groups that reach over a
border are stitched afterwards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm._bpe import _byte_letters
from tidewheel.llm._store import stored

PIECE = 16_384           # merged ends of a piece
CHUNK = 1 << 18          # characters of text tokenised together, and bytes of ids merged together
CACHED_WORDS = 300_000   # words whose ids a worker remembers
HOT_PAIRS = 1_000_000    # at most so many frequent id pairs are sent to all tasks
HELD_PAIRS = 1_000_000   # pairs that a task counts before it passes them on
# ---- fixed value: how byte-level files split a text before merging ----------
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# -----------------------------------------------------------------------------


class ByteTokens:
    """Ids and bytes of a byte-level BPE file, special tokens being plain text.

    A file whose ids follow its merges is run by ranks, which gives the same
    ids several times faster; any other file goes through its own library.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        splitter = spec.get("pre_tokenizer") or {}
        plain = (splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer")
                 and merged == list(range(256, 256 + len(merged))) and not spec["model"].get("ignore_merges"))
        if plain:
            ranks = {self.bytes[k]: k for k in range(256 + len(merged))}
            self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            self.fast, self.library = None, Tokenizer.from_file(path)
            self.library.encode_special_tokens = True

    def encode(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Ids of a space and each text; none where they do not spell it."""
        kind = _dtype(len(self.bytes))
        for t in texts:
            t = " " + t
            if self.fast is not None:
                ids = self.fast.encode_ordinary(t)
                spelt = self.fast.decode_bytes(ids)
            else:
                ids = self.library.encode(t, add_special_tokens=False).ids
                spelt = b"".join([self.bytes[k] for k in ids])
            yield np.array(ids, dtype=kind) if spelt == t.encode() else None


class PieceTokens:
    """Ids and bytes of a SentencePiece model; it adds the space before a text itself.

    Where no piece goes on with a space, nothing is merged across a single
    space, so each distinct word is tokenised once per worker; texts with other
    runs of spaces go through the library whole.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.by_word = not any("▁" in n.lstrip("▁") for n in names)
        self.known: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> list[bytes | None]:
        each = self.model.encode(texts, num_threads=1)
        flat, kind = list(chain.from_iterable(each)), _dtype(len(self.bytes))
        data, step = np.array(flat, dtype=kind).tobytes(), kind.itemsize
        ends = list(accumulate(map(len, each), initial=0))
        out: list[bytes | None] = [data[i * step:j * step] for i, j in pairwise(ends)]
        if b"".join([self.bytes[k] for k in flat]) != "".join([" " + t for t in texts]).encode():
            for k, (t, ids) in enumerate(zip(texts, each, strict=True)):
                if b"".join([self.bytes[i] for i in ids]) != b" " + t.encode():
                    out[k] = None
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Ids of each text; none where they do not spell a space and the text."""
        kind, known = _dtype(len(self.bytes)), self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        split = [t.split(" ") if self.by_word else [""] for t in texts]
        whole = iter(self._ids([t for t, words in zip(texts, split, strict=True) if "" in words]))
        new = list({w for words in split for w in words}.difference(known, [""]))
        known.update(zip(new, self._ids(new), strict=True))
        for words in split:
            parts = [next(whole)] if "" in words else [known[w] for w in words]
            yield None if None in parts else np.frombuffer(b"".join(parts), dtype=kind)


@cache
def _tokens(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a_path), PieceTokens(b_path)


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` ends, merged with A first, are A's; all of ``at`` are searched at once."""
    lo, hi = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (lo < hi).any():
        i = (lo + hi) // 2
        j = at - i - 1
        go = lo < hi
        # Fewer than i + 1 of A's ends precede if B's last one taken lies before A's next.
        more = a[np.minimum(i, len(a) - 1)] <= b[np.clip(j, 0, len(b) - 1)]
        lo, hi = np.where(go & more, i + 1, lo), np.where(go & ~more, i, hi)
    return lo


def cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of ``size`` merged ends begin in A and B, the ends of both last; equal ends are not divided."""
    total = len(a) + len(b)
    at = np.arange(size, total, size)
    i = diagonals(a, b, at) if len(at) else at
    j = at - i
    split = (i > 0) & (j < len(b)) & (a[np.maximum(i, 1) - 1] == b[np.minimum(j, len(b) - 1)]) if len(at) else np.zeros(0, bool)
    j = j + split
    inside = (i + j > 0) & (i + j < total)
    i, j = i[inside], j[inside]
    return np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j, [len(b)]])


def _dtype(n: int) -> np.dtype:
    return np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")


def pieces(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = PIECE) -> DataFrame:
    """(row, doc_id, piece, n_pieces, a_start, b_start, a_after, b_after, a, b), stored: pieces of every row of ``docs``.

    ``a`` and ``b`` are the ids of A of a space and the text, and of B of the
    text.  ``start`` is the byte before a piece's first token, ``after`` the id
    that follows its last one (-1: none).  A null or empty text, and one whose
    tokens do not spell a space and the text, is one empty piece.  Rows that
    repeat an id, or have none, are kept apart by ``row``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta, tb = _tokens(a_path, b_path)
        la, lb = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (ta, tb))
        row = TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "piece", "n_pieces", "a_start", "b_start", "a_after", "b_after", "a", "b"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

        def cut(ids: list, texts: list) -> pa.RecordBatch:
            nonlocal row
            out: list[list] = [[] for _ in names]
            for doc, text, a, b in zip(ids, texts, ta.encode(texts), tb.encode(texts), strict=True):
                if not text or a is None or b is None:
                    a, b = np.zeros(0, _dtype(len(la))), np.zeros(0, _dtype(len(lb)))
                ea, eb = np.cumsum(la[a]), np.cumsum(lb[b])
                i, j = cuts(ea, eb, size)
                for p in range(len(i) - 1):
                    values = [row, doc, p, len(i) - 1, ea[i[p] - 1] if i[p] else 0, eb[j[p] - 1] if j[p] else 0,
                              a[i[p + 1]] if i[p + 1] < len(a) else -1, b[j[p + 1]] if j[p + 1] < len(b) else -1,
                              a[i[p]:i[p + 1]].tobytes(), b[j[p]:j[p + 1]].tobytes()]
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                row += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held > CHUNK or len(ids) >= 2048:
                    yield cut(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield cut(ids, texts)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "row long, doc_id long, piece int, n_pieces int, a_start long, b_start long, a_after int, b_after int, a binary, b binary"
    return stored(base.mapInArrow(run, schema), "pieces", "zstd")


class Merged:
    """The merging of a batch of pieces, each on its own; places count through the batch."""

    def __init__(self, batch: pa.RecordBatch, la: np.ndarray, lb: np.ndarray) -> None:
        col = dict(zip(batch.schema.names, batch.columns, strict=True))
        self.n = batch.num_rows
        self.a, self.na = _flat(col["a"], _dtype(len(la)))
        self.b, self.nb = _flat(col["b"], _dtype(len(lb)))
        self.piece_a, self.piece_b = np.repeat(np.arange(self.n), self.na), np.repeat(np.arange(self.n), self.nb)
        ea, wa = _ends(la[self.a], self.na, col["a_start"].to_numpy(), self.piece_a)
        eb, wb = _ends(lb[self.b], self.nb, col["b_start"].to_numpy(), self.piece_b)
        # Pieces are laid out one after another, so that no two of them share an end.
        low = np.minimum(col["a_start"].to_numpy(), col["b_start"].to_numpy())
        wide = np.maximum(wa, wb) - low + 1
        self.shift = np.cumsum(wide) - wide - low
        self.ea, self.eb = ea + self.shift[self.piece_a], eb + self.shift[self.piece_b]
        place = np.searchsorted(self.eb, self.ea)
        there = np.minimum(place, max(0, len(self.eb) - 1))
        self.hit = (self.eb[there] == self.ea) if len(self.eb) else np.zeros(len(self.ea), dtype=bool)
        self.link_a, self.link_b = np.flatnonzero(self.hit), there[self.hit]
        self.pair = self.a[self.link_a].astype(np.int64) * len(lb) + self.b[self.link_b]
        self.link_piece = self.piece_a[self.link_a]


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    wide = column.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], dtype=np.uint8)[at[0]:at[-1]] if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype=kind), np.diff(at) // kind.itemsize


def _ends(lengths: np.ndarray, counts: np.ndarray, start: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of each token in its document, last end of each piece)."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    first = np.cumsum(counts) - counts
    return sums[1:] - sums[first][piece] + start[piece], sums[first + counts] - sums[first] + start


def _lengths(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token; few numbers, which the driver sends to the tasks."""
    return tuple(np.array([len(x) for x in t.bytes], dtype=np.int64) for t in _tokens(a_path, b_path))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most about ``CHUNK`` bytes of ids together."""
    for batch in batches:
        size = sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) + 8 for c in ("a", "b")) if batch.num_rows else np.zeros(0, np.int64)
        part = (np.cumsum(size) - size) // CHUNK
        at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def overlaps(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id, a_id, b_id, last_byte, linked) per overlap of an A token with a B token, from ``pieces``.

    ``last_byte`` is where the overlap ends in a space and the text; ``linked`` says that both tokens end there.
    """
    la, lb = _lengths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            m = Merged(batch, la, lb)
            end = np.union1d(m.ea, m.eb)
            owner = np.empty(len(end), dtype=np.int64)
            owner[np.searchsorted(end, m.ea)] = m.piece_a
            owner[np.searchsorted(end, m.eb)] = m.piece_b
            ids = []
            for e, v, n, after in ((m.ea, m.a, m.na, "a_after"), (m.eb, m.b, m.nb, "b_after")):
                # A token that reaches over the border is the next piece's first.
                place, beyond = np.searchsorted(e, end), batch.column(after).to_numpy()[owner]
                inside = place < np.cumsum(n)[owner]
                here = v[np.minimum(place, len(v) - 1)].astype(np.int32) if len(v) else beyond
                ids.append(pa.array(np.where(inside, here, beyond).astype(np.int32)))
            owners = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(owners), batch.column("doc_id").take(owners), *ids, pa.array(end - m.shift[owner]), pa.array(np.isin(end, m.ea[m.hit]))],
                names=["row", "doc_id", "a_id", "b_id", "last_byte", "linked"])
    return parts.mapInArrow(run, "row long, doc_id long, a_id int, b_id int, last_byte long, linked boolean")


def pair_counts(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n, best), stored: how often a pair is linked in all of ``pieces``, and whether no pair of its B id is more often."""
    la, lb = _lengths(a_path, b_path)
    width = len(lb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
        for batch in _slices(batches):
            new, times = np.unique(Merged(batch, la, lb).pair, return_counts=True)
            pair, at = np.unique(np.concatenate([pair, new]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, times]), minlength=len(pair)).astype(np.int64)
            if len(pair) > HELD_PAIRS:
                yield out()
                pair, n = pair[:0], n[:0]
        yield out()
    counted = stored(parts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).select(
        F.floor(F.col("pair") / width).cast("int").alias("a_id"), F.pmod("pair", F.lit(width)).cast("int").alias("b_id"), "n"), "pairs")
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))
    return stored(counted.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _summaries(parts: DataFrame, counts: DataFrame, a_path: str, b_path: str, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(summaries of pieces, counts of the pairs left to a join); frequent pairs are looked up in place.

    At most ``hot_pairs`` pairs go to all tasks, by a power-of-two threshold on
    their counts, so a pair left to the join is none that could skew it.
    """
    la, lb = _lengths(a_path, b_path)
    width = len(lb)
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}
    hot_from, held = 64, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > hot_pairs:
            break
        hot_from = k
    is_hot = F.floor(F.log2("n")) >= hot_from
    pair = (F.col("a_id").cast("long") * width + F.col("b_id")).alias("pair")
    hot = counts.filter(is_hot).select(pair, "n", "best").toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    sent = parts.sparkSession.sparkContext.broadcast((hot.column("pair").to_numpy()[order], hot.column("n").to_numpy()[order],
                                                      hot.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)))
    names = ["row", "doc_id", "piece", "n_a", "n_b", "n_groups", "n_best", "count_sum", "digest", "closed", "head_a", "head_b", "middle", "tail_a", "tail_b", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, best = sent.value
        table = _decimals(max(len(la), len(lb)))
        for batch in _slices(batches):
            m = Merged(batch, la, lb)
            at = np.minimum(np.searchsorted(pairs, m.pair), max(0, len(pairs) - 1))
            known = pairs[at] == m.pair if len(pairs) else np.zeros(len(m.pair), dtype=bool)
            n_best, total = np.zeros(m.n, dtype=np.int64), np.zeros(m.n, dtype=np.int64)
            np.add.at(n_best, m.link_piece[known], best[at[known]])
            np.add.at(total, m.link_piece[known], times[at[known]])
            rare, per = m.pair[~known], np.bincount(m.link_piece[~known], minlength=m.n)
            groups = np.bincount(m.link_piece, minlength=m.n)
            digests, sides = _rendered(m, table, batch.column("n_pieces").to_numpy() == 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("piece"), pa.array(m.na.astype(np.int64)), pa.array(m.nb.astype(np.int64)), pa.array(groups),
                 pa.array(n_best), pa.array(total), pa.array(digests, pa.string()), pa.array(groups > 0), *[pa.array(c, pa.binary()) for c in sides],
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(rare))], names=names)
    schema = ("row long, doc_id long, piece int, n_a long, n_b long, n_groups long, n_best long, count_sum long, digest string, closed boolean, "
              "head_a binary, head_b binary, middle binary, tail_a binary, tail_b binary, rare array<long>")
    cold = counts.filter(~is_hot).select(pair, "n", F.col("best").cast("long").alias("best"))
    return stored(parts.mapInArrow(run, schema), "summaries", "zstd"), cold


def _decimals(n: int) -> np.ndarray:
    """Row 4 * k + s: the number k in decimal and a separator, padded with zero bytes."""
    digits = len(str(n))
    table = np.zeros((n, 4, digits + 1), dtype=np.uint8)
    k = np.arange(n)
    for place in range(digits):
        high = k // 10 ** place
        shown = (high > 0) | (place == 0)
        table[:, :, digits - 1 - place] = np.where(shown, 48 + high % 10, 0)[:, None]
    table[:, 1:, digits] = np.frombuffer(b",|;", dtype=np.uint8)
    return table.reshape(n * 4, digits + 1)


def _rendered(m: Merged, table: np.ndarray, whole: np.ndarray) -> tuple[list[str | None], list[list[bytes | None]]]:
    """(digest of each piece that is a whole document, parts of each other piece).

    Parts: the sides of its first group, its other whole groups, and the sides of what follows its last link.
    """
    before_a, hit_b = np.cumsum(m.hit) - m.hit, np.zeros(len(m.b), dtype=bool)
    hit_b[m.link_b] = True
    before_b = np.cumsum(hit_b) - hit_b
    # A piece opens a new group even where the one before it was left open.
    group = np.concatenate([2 * (before_a + m.piece_a), 2 * (before_b + m.piece_b) + 1])
    order = np.argsort(group, kind="stable")
    group, ids = group[order], np.concatenate([m.a, m.b]).astype(np.int64)[order]
    bounds = np.concatenate([[0], np.cumsum(m.na + m.nb)])
    sep = np.zeros(len(group), dtype=np.int64)
    sep[:-1] = np.where(group[1:] == group[:-1], 1, np.where((group[1:] >> 1) == (group[:-1] >> 1), 2, 3))
    cells = table[ids * 4 + sep]
    filled = cells != 0
    at = np.concatenate([[0], np.cumsum(np.count_nonzero(filled, axis=1))])
    data = cells[filled].tobytes()
    links = np.bincount(m.link_piece, minlength=m.n)
    first_group = np.cumsum(links) - links + np.arange(m.n)

    def part(lo: int, hi: int) -> bytes:
        return data[at[lo]:at[hi]].rstrip(b",|;") if hi > lo else b""
    digests, columns = [], [[] for _ in range(5)]
    for p in range(m.n):
        lo, hi = bounds[p], bounds[p + 1]
        if whole[p]:
            digests.append(hashlib.sha256(part(lo, hi)).hexdigest() if hi > lo else "")
            parts = [None] * 5
        else:
            digests.append(None)
            first, last = 2 * first_group[p], 2 * (first_group[p] + links[p])
            inner = lo + np.searchsorted(group[lo:hi], [first, first + 1, first + 2, last, last + 1])
            parts = [part(inner[0], inner[1]), part(inner[1], inner[2]), *([part(inner[2], inner[3]), part(inner[3], inner[4]), part(inner[4], hi)] if links[p] else [b""] * 3)]
        for column, v in zip(columns, parts, strict=True):
            column.append(v)
    return digests, columns


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = PIECE, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_overlaps, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    A link is an overlap whose two tokens end together, so links are as many as
    groups.  ``n_best`` counts links of which no other pair with their B id is
    linked more often in all rows; ``count_sum`` adds up how often their pairs
    are.  ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.  Rows without
    tokens (see ``pieces``) have zeros and an empty digest; rows that repeat an
    id or have none count each; other columns are ignored.
    """
    parts = pieces(docs, a_path, b_path, id_col=id_col, text_col=text_col, size=size)
    rows, cold = _summaries(parts, pair_counts(parts, a_path, b_path), a_path, b_path, hot_pairs)
    more = (rows.select("row", F.explode("rare").alias("pair")).join(cold, "pair").groupBy("row")
            .agg(F.sum("best").alias("more_best"), F.sum("n").alias("more_sum")))
    sorted_rows = rows.drop("rare").repartition("row").sortWithinPartitions("row", "piece")
    counted = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: tuple | None = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", *counted, "groups_sha256"])

        def close() -> None:
            row, doc, sums, digest, *_ = state
            done.append((row, doc, *sums, digest if isinstance(digest, str) else digest.hexdigest()))
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or state[0] != r["row"]:
                    if state is not None:
                        close()
                    state = (r["row"], r["doc_id"], [0] * len(counted), hashlib.sha256(), b"", b"", b"")
                row, doc, sums, digest, open_a, open_b, mark = state
                sums = [s + r[c] for s, c in zip(sums, counted, strict=True)]
                if r["digest"] is not None:
                    digest = r["digest"]
                else:
                    open_a, open_b = (b",".join(x for x in pair if x) for pair in ((open_a, r["head_a"]), (open_b, r["head_b"])))
                    if r["closed"]:
                        digest.update(mark + open_a + b"|" + open_b)
                        if r["middle"]:
                            digest.update(b";" + r["middle"])
                        open_a, open_b, mark = r["tail_a"], r["tail_b"], b";"
                state = (row, doc, sums, digest, open_a, open_b, mark)
            if len(done) >= 1024:
                yield out()
                done.clear()
        if state is not None:
            close()
        if done:
            yield out()
    whole = sorted_rows.mapInArrow(stitch, "row long, doc_id long, " + ", ".join(f"{c} long" for c in counted) + ", groups_sha256 string")
    out = whole.join(more, "row", "left")
    add = {"n_best": "more_best", "count_sum": "more_sum"}
    return out.select("doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_overlaps"), "n_groups", F.col("n_groups").alias("n_links"),
                      *[(F.col(c) + F.coalesce(v, F.lit(0))).alias(c) for c, v in add.items()], "groups_sha256")
