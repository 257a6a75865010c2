"""Token ids of whole texts, each distinct word being tokenised once per task."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

CACHED_WORDS = 1_000_000
ODD = "\x1c\x1d\x1e\x1f"
LONGEST = 40           # longer pieces go through the library
NONE = np.int32(1 << 30)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokens:
    """Ids of a byte-level BPE file with word ends, equal to the library's for every text.

    The file's normaliser and splitter treat white space as a border, so a text
    is the sequence of its words.  Words of printable ASCII and Latin-1 letters
    are merged many at a time in numpy; any other word goes through the
    library, and so does everything if the file is of another kind.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix")
        steps = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        norms = [p.get("type") for p in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = bool(self.suffix) and steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]
        self.wide = self.library.get_vocab_size() >= 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[str, bytes] = {}
        if not self.by_word:
            return
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.parts = regex.compile(self.split.pattern + r"|\n")
        self.simple = regex.compile(r"[\x21-\x7EÀ-ÿ\n]+")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab, letters = model["vocab"], _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._index(np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64))

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank."""
        size = 1 << max(4, (len(keys) * 16).bit_length())
        self.mask = np.int64(size - 1)
        self.table, self.rank = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        left, place, self.tries = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.tries += 1
            at = place[left]
            free = self.table[at] == -1
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(left), dtype=bool)
            take[first] = True
            take &= free
            self.table[at[take]], self.rank[at[take]] = keys[left[take]], left[take]
            left = left[~take]
            place[left] = (place[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) & self.mask

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        place, out = self._slot(keys), np.full(len(keys), NONE, dtype=np.int32)
        for _ in range(self.tries):
            hit = self.table[place] == keys
            out[hit] = self.rank[place[hit]]
            place = (place + 1) & self.mask
        return np.where((a < 0) | (b < 0), NONE, out)

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, the pair of least rank of every piece being merged in each round."""
        sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        out = [b""] * len(pieces)

        def finish(which: np.ndarray, cells: np.ndarray) -> None:
            solid = cells >= 0
            data = cells[solid].astype(self.dtype).tobytes()
            ends = (np.cumsum(solid.sum(axis=1)) * self.dtype.itemsize).tolist()
            begin = 0
            for i, end in zip(which.tolist(), ends, strict=True):
                out[i] = data[begin:end]
                begin = end

        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(order), 16384):
            some = order[lo:lo + 16384]
            width = int(sizes[some].max())
            # One spare column on the right stays empty.
            cells = np.full((len(some), width + 1), -1, dtype=np.int32)
            joined = np.frombuffer(b"".join([pieces[k] for k in some]), dtype=np.uint8)
            row = np.repeat(np.arange(len(some)), sizes[some])
            ends = np.cumsum(sizes[some])
            col = np.arange(len(joined)) - np.repeat(ends - sizes[some], sizes[some])
            cells[row, col] = self.inner[joined]
            cells[np.arange(len(some)), sizes[some] - 1] = self.last[joined[ends - 1]]
            ranks = self._ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(some), width)
            while len(some):
                rows = np.arange(len(some))
                at = ranks.argmin(axis=1)
                best = ranks[rows, at]
                on = best < NONE
                if not on.all():
                    finish(some[~on], cells[~on])
                    some, cells, ranks, at, best = some[on], cells[on], ranks[on], at[on], best[on]
                    rows = rows[:len(some)]
                if not len(some):
                    break
                cells[rows, at] = self.made[best]
                keep = np.ones(cells.shape, dtype=bool)
                keep[rows, at + 1] = False
                cells = cells[keep].reshape(len(some), -1)
                if cells.shape[1] == 1:
                    finish(some, cells)
                    break
                keep = np.ones(ranks.shape, dtype=bool)
                keep[rows, at] = False
                ranks = ranks[keep].reshape(len(some), -1)
                right = at < ranks.shape[1]
                ranks[rows[right], at[right]] = self._ranks(cells[rows[right], at[right]], cells[rows[right], at[right] + 1])
                left = at > 0
                ranks[rows[left], at[left] - 1] = self._ranks(cells[rows[left], at[left] - 1], cells[rows[left], at[left]])
        return out

    def _learn(self, new: list[str]) -> None:
        """Add words to the cache."""
        joined = "\n".join(new)
        if not self.simple.fullmatch(joined) or any(s in joined for s in self.special):
            plain = [w for w in new if self.simple.fullmatch(w) and "\n" not in w and not any(s in w for s in self.special)]
            for w in set(new).difference(plain):
                self.cache[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
            new, joined = plain, "\n".join(plain)
        if not new:
            return
        flat = self.parts.findall(joined.lower())
        distinct = list(set(flat) - {"\n"})
        border = b"\xff" * self.dtype.itemsize
        ids = {"\n": border}
        fast = [p for p in distinct if len(p) <= LONGEST]
        ids.update(zip(fast, self._merged([p.encode() for p in fast]), strict=True))
        for p in distinct:
            if p not in ids:
                ids[p] = np.array(self.library.encode(p, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        data = b"".join([ids[p] for p in flat])
        borders = np.flatnonzero(np.frombuffer(data, dtype=self.dtype) == np.iinfo(self.dtype).max) * self.dtype.itemsize
        begin = 0
        for w, end in zip(new, [*borders.tolist(), len(data)], strict=True):
            self.cache[w] = data[begin:end]
            begin = end + self.dtype.itemsize

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian ids of each text, in ``dtype``."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        # Python splits at four control characters that the files take for letters of a word.
        whole = [not self.by_word or any(c in t for c in ODD) for t in texts]
        split = [[] if odd else t.split() for t, odd in zip(texts, whole, strict=True)]
        cache = self.cache
        new = {w for ws in split for w in ws}.difference(cache)
        if new:
            self._learn(list(new))
        for t, odd, ws in zip(texts, whole, split, strict=True):
            if odd:
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
            else:
                yield b"".join([cache[w] for w in ws])
