"""Near-duplicate documents: one-permutation hashing with optimal densification.

One hash per shingle fills all bins of a signature; an empty bin borrows the
value of a bin that a hash of (bin, attempt) picks.  Bands of the signature are
bucket keys; each bucket contributes star-shaped candidate edges, and links are
confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._graph import bucket_links
from tidewheel.llm._groups import in_blocks, least_labels, overlaps, sorted_groups
from tidewheel.llm._store import free_name, small_side, stored
from tidewheel.llm._words import Words, long_lists, mix, shingles, words

BANDS = 48
MISS = 1e-3          # probability that a pair at the threshold shares no band
ATTEMPTS = 48
BLOCK = 256          # documents of a bucket that one task compares with as many others


def band_rows(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    """The most rows per band for which a pair at ``threshold`` is missed with at most ``miss``."""
    return max(1, math.floor(math.log(1 - miss ** (1 / bands)) / math.log(threshold)))


def signatures(text: np.ndarray, h: np.ndarray, count: int, bins: int) -> np.ndarray:
    """A (count, bins) array of bin minima, densified; rows without shingles are zero.

    ``text`` and ``h`` come sorted, and a bin is a range of the hash, so the
    first hash of each (text, bin) is its minimum.
    """
    out = np.zeros((count, bins), dtype=np.uint64)
    if not len(h):
        return out
    slot = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (slot[1:] != slot[:-1])
    out[text[first], slot[first]] = h[first]
    full = np.zeros((count, bins), dtype=bool)
    full[text[first], slot[first]] = True
    has = full.any(axis=1)
    row, col = np.nonzero(~full & has[:, None])
    base = out.copy()
    for t in range(1, ATTEMPTS + 1):
        if not len(row):
            break
        pick = (mix(col.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(t)) % np.uint64(bins)).astype(np.int64)
        hit = full[row, pick]
        out[row[hit], col[hit]] = base[row[hit], pick[hit]]
        row, col = row[~hit], col[~hit]
    # The same draw without trial and error: the filled bin with the least hash of (bin, filled bin).
    for r in np.unique(row):
        there = np.flatnonzero(full[r])
        holes = col[row == r]
        rank = mix(holes[:, None].astype(np.uint64) * np.uint64(1_000_003) + mix(there.astype(np.uint64))[None, :])
        out[r, holes] = base[r, there[rank.argmin(axis=1)]]
    return out


def _keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(sig), axis=0)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + sig[:, r:bands * rows:rows])
    return keys


def _sums(text: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """An order-free 64-bit fingerprint per text."""
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h, out=total[1:])
    at = np.searchsorted(text, np.arange(count + 1))
    return total[at[1:]] - total[at[:-1]]


def _describe(w: Words, size: int, bands: int, rows: int) -> list[pa.Array]:
    text, h = shingles(w, size)
    n = np.bincount(text, minlength=w.count).astype(np.int64)
    keys = np.zeros((w.count, bands), dtype=np.uint64)
    for lo in range(0, w.count, 256):
        a, b = np.searchsorted(text, [lo, min(w.count, lo + 256)])
        some = min(256, w.count - lo)
        keys[lo:lo + some] = _keys(signatures(text[a:b] - lo, h[a:b], some, bands * rows), bands, rows)
    return [pa.array(n), pa.array(_sums(text, h, w.count).view(np.int64)),
            pa.array(_sums(text, mix(h ^ np.uint64(0x5DEECE66D)), w.count).view(np.int64)),
            long_lists(keys.ravel(), np.full(w.count, bands))]


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, grams): the sorted distinct shingle hashes of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                text, h = shingles(w, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.count), long_lists(h, np.bincount(text, minlength=w.count))],
                    names=["doc_id", "grams"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``size``-word shingles, confirmed on full sets; the component
    is the smallest id reachable, which is the one kept.  Equal sets form one
    class, of which only the smallest id is compared.

    A null or blank text has no shingles and is linked with nothing.  A row
    without id is returned with a null component and kept.  Repeated rows of an
    id give repeated rows; if their texts differ, the id is linked with what
    any of them is linked with.  Only the two named columns are read.  An empty
    table gives an empty result.
    """
    rows = band_rows(percent / 100, bands)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.count), *_describe(w, size, bands, rows)],
                    names=["doc_id", "n_shingles", "f1", "f2", "keys"])

    seen = stored(base.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "signatures")
    full = seen.filter("doc_id is not null and n_shingles > 0")
    classes = stored(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    reps = classes.select(F.col("rep").alias("node"), F.explode("keys").alias("key"))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
        sets = stored(shingle_sets(base.join(small_side(wanted), "doc_id"), size), "sets")
        sets = sets.select("doc_id", "grams", F.size("grams").alias("n"))
        a = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"), F.col("n").alias("na"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"), F.col("n").alias("nb"))
        sizes = sets.select("doc_id", "n")
        fit = (pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("sa")), "a")
               .join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("sb")), "b")
               .filter(F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent).select("a", "b"))
        shared = F.size(F.array_intersect("ga", "gb"))
        return (fit.join(a, "a").join(b, "b").filter(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent)
                .select("a", "b").distinct())

    def compare(split: DataFrame) -> DataFrame:
        nodes = stored(split.select(F.col("node").alias("doc_id")).distinct(), "wanted")
        sets = stored(shingle_sets(base.join(small_side(nodes), "doc_id"), size).withColumnRenamed("doc_id", "node"), "sets")
        sizes = split.groupBy("key").agg(F.count("*").alias("n"))
        posted = in_blocks(split, sizes, ["key"], "node", BLOCK).join(sets, "node").select("key", "i", "j", "mine", "node", "grams")
        posted = posted.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in sorted_groups(batches, 3):
                ids, side = g.column(4).to_numpy(), g.column(3).to_numpy()
                flat = g.column(5).combine_chunks()
                grams = np.split(np.asarray(flat.flatten()), np.cumsum(pc.list_value_length(flat).to_numpy())[:-1])
                n, shared = np.array([len(x) for x in grams]), overlaps(grams)
                near = shared * 100 >= (n[:, None] + n[None, :] - shared) * percent
                if g.column(1)[0].as_py() != g.column(2)[0].as_py():
                    near &= side[:, None] != side[None, :]
                least = least_labels(near, ids)
                some = least != ids
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(least[some])], names=["a", "b"])
        return stored(posted.mapInArrow(run, "a long, b long").distinct(), "more-links")

    groups = bucket_links(reps, verify, compare)
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all its columns, that stand first in their component.

    Of rows that share an id the first in the order of their JSON stays; rows without id all stay.
    """
    key = free_name(docs, "known_as")
    same = docs[id_col].cast("long") == F.col(key)
    found = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, percent=percent), "near-duplicates")
    gone = stored(found.groupBy("doc_id").agg(F.min("kept").alias("kept")).filter("doc_id is not null and not kept").select(F.col("doc_id").alias(key)), "gone")
    out = docs.join(small_side(gone), same, "left_anti")
    repeated = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)), "repeated")
    if repeated.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = out.join(repeated, same, "left_semi").groupBy(F.col(id_col).alias(key)).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return out.join(repeated, same, "left_anti").union(one)
