"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a re-parameterised
question keeps its template.  Windows of template tokens are hash-joined with
those of the benchmark, and a match counts when the values in the slots map
consistently from the benchmark item to the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._store import free_name, small_side, stored
from tidewheel.llm._words import RangeHash, chunks, mix, text_bytes

WINDOW = 5             # template tokens per window
LITERALS = 3           # of them, words that are not placeholders
COVERAGE = 0.6         # share of an item's windows a document must hold
CONSISTENCY = 0.8      # share of slot values that follow one mapping
BLOCK = 4_000_000      # benchmark windows looked up in one pass over the documents

# Units that make a placeholder when they follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l kl s sec secs min mins h hr hrs hour hours minute minutes second seconds "
         "day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents meter meters metre metres "
         "kilometer kilometers mile miles gram grams kilogram kilograms liter liters litre litres percent degree degrees kb mb gb tb "
         "hz khz mhz ghz w kw v j kj cal kcal mph kmh").split()

NUMBER, UNIT, NAME, VERBATIM = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65, 0x76657262617469))


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), dtype=np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    starts = ends - [len(u) for u in UNITS]
    return np.sort(RangeHash(joined)(starts, ends))


_UNIT_HASHES = _unit_hashes()


@dataclass
class Template:
    """Template tokens of texts ``first`` to ``first + count`` of a batch, in order."""

    first: int
    count: int
    text: np.ndarray
    token: np.ndarray      # hash of the literal word, or the placeholder
    value: np.ndarray      # hash of what stands there
    slot: np.ndarray       # whether it is a placeholder


def templates(column: pa.Array) -> Iterator[Template]:
    """Typed template tokens of whole texts.

    Tokens are runs of letters (any byte from 128 on counts as one, general
    punctuation aside) or numbers with their inner points and commas.  A unit
    is a unit word after a number.  A name is a capitalised word, not all
    capitals, inside a sentence; neighbouring names are one.
    """
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        raw = data[offsets[lo]:offsets[hi]]
        at = offsets[lo:hi + 1] - offsets[lo]
        n = len(raw)
        digit = (raw >= 48) & (raw <= 57)
        upper = (raw >= 65) & (raw <= 90)
        letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        if n > 2:
            mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80))
            for k in range(3):
                letter[mark + k] = False
            dot = np.flatnonzero(((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]) + 1
            edges = np.isin(dot, at) | np.isin(dot + 1, at)
            digit[dot[~edges]] = True
        kind = letter.astype(np.int8) + 2 * digit.astype(np.int8)
        change = np.ones(n + 1, dtype=bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[at] = True
        cuts = np.flatnonzero(change)
        start, end = cuts[:-1], cuts[1:]
        solid = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
        start, end = start[solid], end[solid]
        low = np.where(upper, raw + 32, raw).astype(np.uint8)
        value = RangeHash(low)(start, end)
        text = np.searchsorted(at, start, side="right") - 1
        number = kind[start] == 2
        after = np.zeros(len(start), dtype=bool)
        after[1:] = number[:-1] & (text[1:] == text[:-1])
        place = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
        unit = after & ~number & (_UNIT_HASHES[place] == value)
        # A sentence starts a text or follows . ! ? : or a line feed.
        stops = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(b".!?:\n", dtype=np.uint8)))])
        before = np.concatenate([[0], end[:-1]]) if len(end) else end
        opens = np.ones(len(start), dtype=bool)
        opens[1:] = (text[1:] != text[:-1]) | (stops[start[1:]] > stops[before[1:]])
        second = np.minimum(start + 1, max(0, n - 1))
        name = upper[start] & ~opens & (end - start > 1) & ~upper[second] if len(start) else opens
        token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
        same = np.zeros(len(start), dtype=bool)
        same[1:] = name[1:] & name[:-1] & (text[1:] == text[:-1])
        keep = ~same
        yield Template(lo, hi - lo, text[keep], token[keep], value[keep], (number | unit | name)[keep])


def _hashes(tokens: np.ndarray, at: np.ndarray, length: int, salt: np.uint64) -> np.ndarray:
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(length):
        h = h * step + tokens[at + k]
    return mix(h + np.uint64(length) + salt)


def windows(t: Template, size: int, lengths: list[int] | None = None, verbatim: bool = True) -> tuple[np.ndarray, ...]:
    """(text, position, length, hash, verbatim) of every window of one of ``lengths``.

    Without ``lengths``, as for items: windows of ``size``, and a shorter text is
    one window.  Windows of mostly placeholders have no template hash.  With
    ``verbatim`` windows are also hashed by what stands there, those of items
    only where a text has no template window.
    """
    n = len(t.token)
    first = np.searchsorted(t.text, np.arange(t.count))
    per = np.diff(np.concatenate([first, [n]]))
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    found = []
    for m in lengths or range(1, size + 1):
        at = np.arange(max(0, n - m + 1))
        at = at[t.text[at] == t.text[at + m - 1]] if len(at) else at
        if lengths is None:
            at = at[np.minimum(per[t.text[at]], size) == m]
        good = at[m - (slots[at + m] - slots[at]) >= min(LITERALS, m)]
        found.append((good, np.full(len(good), m), _hashes(t.token, good, m, np.uint64(0)), np.zeros(len(good), dtype=bool)))
        if verbatim:
            if lengths is None:
                has = np.zeros(t.count, dtype=bool)
                has[t.text[good]] = True
                at = at[~has[t.text[at]]]
            found.append((at, np.full(len(at), m), _hashes(t.value, at, m, VERBATIM), np.ones(len(at), dtype=bool)))
    at, length, h, same = (np.concatenate(x) for x in zip(*found, strict=True))
    return t.text[at], at - first[t.text[at]], length, h, same


def _hits(docs: DataFrame, size: int, among: np.ndarray | None, lengths: list[int] | None = None, verbatim: bool = True) -> DataFrame:
    """(id, pos, length, window, verbatim, slots): windows of every text, only those ``among`` if given.

    Slots are the values in order; none for verbatim windows, whose hash has them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in templates(batch.column(1)):
                text, pos, length, h, same = windows(t, size, lengths, verbatim)
                if among is not None:
                    place = np.minimum(np.searchsorted(among, h), len(among) - 1)
                    hit = among[place] == h
                    text, pos, length, h, same = text[hit], pos[hit], length[hit], h[hit], same[hit]
                first = np.searchsorted(t.text, np.arange(t.count))
                at = first[text] + pos if len(text) else pos
                slots = [t.value[a:a + (0 if s else m)][t.slot[a:a + (0 if s else m)]].view(np.int64) for a, m, s in zip(at, length, same, strict=True)]
                ids = batch.column(0).slice(t.first, t.count)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text)), pa.array(pos.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(h.view(np.int64)), pa.array(same),
                     pa.array(slots, pa.list_(pa.int64()))],
                    names=["id", "pos", "length", "window", "verbatim", "slots"])
    return docs.mapInArrow(run, "id long, pos long, length long, window long, verbatim boolean, slots array<long>")


def _runs(met: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, window, asked, slots, same): one hit per window of an item and place where it may stand.

    A hit's shift is its position less that of the item's window.  Shifts are
    dealt to cells as wide as the item, on two grids half a cell apart: two
    copies never share a cell by their own shifts, and a copy moved by
    insertions of up to half its length lies in one cell of either grid.  Of
    several hits of a window in a cell the one whose shift has most hits counts.
    """
    cell = [F.struct(F.lit(grid).alias("grid"), F.floor((F.col("shift") + half) / F.col("span")).alias("cell"))
            for grid, half in ((0, F.lit(0)), (1, F.floor(F.col("span") / 2)))]
    dealt = met.select("*", F.explode(F.array(*cell)).alias("run"))
    dealt = dealt.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "item_id", "run", "shift")))
    return (dealt.groupBy("doc_id", "item_id", "run", "place", "window")
            .agg(F.max_by(F.struct("asked", "slots"), F.struct("n", -F.col("shift"))).alias("b"), F.max(F.col("asked") == F.col("slots")).alias("same"))
            .select("doc_id", "item_id", "run", "window", "b.asked", "b.slots", "same"))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text: str = "text", size: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, consistency): items a document holds.

    ``n_windows`` counts an item's distinct template windows.  Each place where
    the item may stand in the document is judged by itself, and so is the
    document as a whole, for items whose parts are spread: ``n_matched`` are the
    windows there, and ``consistency`` the share of slot values that agree with
    the value their benchmark value has most often there (1 without slots).
    Windows that repeat the item's own values are enough when they cover the
    item and its slotted windows.  The best place that passes is reported.

    An item shorter than ``size`` is one window, looked for in all of a
    document.  An item of mostly placeholders ("What is 17 * 24?") must stand
    there with its own values; signs between words never count.

    The benchmark's window hashes go to the tasks in blocks of bounded size, one
    pass over the documents each; documents are not shuffled, only their hits.

    Null or empty texts and null ids match nothing; rows that repeat an id
    count together, and equal items match alike.  Empty tables give an empty
    result; other columns are ignored.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = stored(_hits(items, size, None).select(F.col("id").alias("item_id"), F.col("pos").alias("place"), "length", "window", "verbatim",
                                                   F.col("slots").alias("asked")), "benchmark")
    shape = asked.agg(F.sort_array(F.collect_set("length")).alias("lengths"), F.coalesce(F.max("verbatim"), F.lit(False)).alias("verbatim")).first()
    distinct = asked.select("window").distinct()
    blocks = -(-distinct.count() // BLOCK)
    hits = None
    for b in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).toArrow().column("window")
        found = stored(_hits(base, size, np.sort(part.to_numpy().view(np.uint64)), shape["lengths"], shape["verbatim"]), "hits")
        hits = found if hits is None else hits.union(found)
    hits = _hits(base.limit(0), size, None) if hits is None else hits
    hits = hits.select(F.col("id").alias("doc_id"), "pos", "window", "slots")
    slotted = F.when(F.size("asked") > 0, F.col("window"))
    total = asked.groupBy("item_id").agg(F.countDistinct("window").alias("n_windows"), F.countDistinct(slotted).alias("n_slotted"),
                                         F.max(F.col("place") + F.col("length")).alias("span"))
    wanted = asked.select("item_id", "place", "window", "asked").distinct().join(total.select("item_id", "span"), "item_id")
    met = stored(hits.join(wanted, "window").select("doc_id", "item_id", "span", "place", (F.col("pos") - F.col("place")).alias("shift"), "window", "asked", "slots"), "met")
    # In the document as a whole a window counts once for each set of values.
    whole = met.select("doc_id", "item_id", F.struct(F.lit(2).alias("grid"), F.lit(0).cast("long").alias("cell")).alias("run"), "window", "asked", "slots",
                       F.lit(False).alias("same")).distinct()
    by = ["doc_id", "item_id", "run"]
    held = _runs(met).union(whole)
    counted = (held.groupBy(by).agg(F.countDistinct("window").alias("n_matched"), F.countDistinct(F.when(F.col("same"), F.col("window"))).alias("n_same"),
                                    F.countDistinct(F.when(F.col("same"), slotted)).alias("n_same_slotted"))
               .join(total.drop("span"), "item_id").filter(F.col("n_matched") / F.col("n_windows") >= coverage))
    values = (held.select(*by, F.explode(F.arrays_zip("asked", "slots")).alias("s"))
              .groupBy(*by, F.col("s.asked").alias("asked"), F.col("s.slots").alias("slot")).agg(F.count("*").alias("n"))
              .groupBy(*by, "asked").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
              .groupBy(by).agg((F.sum("most") / F.sum("n")).alias("consistency")))
    judged = counted.join(values, by, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    own = (F.col("n_same") / F.col("n_windows") >= coverage) & (F.col("n_same_slotted") >= coverage * F.col("n_slotted"))
    verdicts = F.array(F.struct((F.col("consistency") >= consistency).alias("ok"), "n_matched", "consistency"),
                       F.struct(own.alias("ok"), F.col("n_same").alias("n_matched"), F.lit(1.0).alias("consistency")))
    passed = judged.select("doc_id", "item_id", "n_windows", F.explode(verdicts).alias("v")).filter("v.ok")
    best = passed.groupBy("doc_id", "item_id", "n_windows").agg(F.max(F.struct("v.n_matched", "v.consistency")).alias("b"))
    return best.select("doc_id", "item_id", "n_windows", "b.n_matched", (F.col("b.n_matched") / F.col("n_windows")).alias("coverage"), "b.consistency")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all its columns, that hold no item; rows without id stay."""
    key = free_name(docs, "held_by")
    found = matches(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(key)).distinct()
    found = stored(found, "contaminated")
    return docs.join(small_side(found), docs[id_col].cast("long") == F.col(key), "left_anti")
