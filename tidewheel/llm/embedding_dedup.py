"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by its nearest reference points, in order.  Inverted
lists hold ids and descriptions, without vectors; a pair that shares as many
points as pairs at the threshold do is a candidate, counted in the list of its
rarest shared point, once.  Vectors are fetched for candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._graph import components
from tidewheel.llm._groups import in_blocks, sorted_groups
from tidewheel.llm._store import stored
from tidewheel.llm._words import mix

RECALL = 0.998        # share of pairs at the threshold that must be candidates
TRIALS = 4000         # pairs drawn to find how many points they share
PREFIX = 24           # points that describe a vector; a quarter of the pivots at most, at first
PIVOTS = (32, 4096)   # at least and at most; between, twice the root of the number of vectors
APART = 0.6           # no two pivots from the sample have a greater cosine
LIST_BLOCK = 2048     # longer lists are compared block by block


def _parse(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as float arrays; None for those that link with nothing."""
    flat = column.flatten()  # leaves out null vectors
    whole = ~np.asarray(flat.is_null(), dtype=bool)
    x = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    end = np.cumsum(size)
    sound = np.concatenate([[0], np.cumsum(whole & np.isfinite(x))])
    some = np.concatenate([[0], np.cumsum(x != 0)])
    good = (size > 0) & (sound[end] - sound[end - size] == size) & (some[end] > some[end - size])
    return [x[e - n:e] if ok else None for ok, n, e in zip(good.tolist(), size.tolist(), end.tolist(), strict=True)]


def _packed(data: bytes) -> bytes:
    """The vector in single precision if that is the same."""
    x = np.frombuffer(data, dtype=np.float64)
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else data


def _unit(data: list[bytes], dims: int) -> np.ndarray:
    x = np.stack([np.frombuffer(d, dtype=np.float32 if len(d) == 4 * dims else np.float64).astype(np.float64) for d in data])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """(h1, h2, dims, rep, copies, data): equal vectors once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = _parse(batch.column(1))
            good = [k for k, v in enumerate(parsed) if v is not None]
            rows = [[], [], [], []]
            for k in good:
                v = parsed[k] + 0.0  # one zero
                bits = v.view(np.uint64)
                place = np.arange(1, len(bits) + 1, dtype=np.uint64)
                rows[0].append(int(np.bitwise_xor.reduce(mix(bits + place * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)))
                rows[1].append(int(np.add.reduce(mix(bits ^ mix(place))).view(np.int64)))
                rows[2].append(len(v))
                rows[3].append(v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good, pa.int64())), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                 pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], names=["vec_id", "h1", "h2", "dims", "data"])
    return vectors.mapInArrow(run, "vec_id long, h1 long, h2 long, dims long, data binary")


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Prefixes of one length as rows of a matrix."""
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(len(column), -1).astype(np.int64)


def pivots(reps: DataFrame, dims: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Reference points, and sampled vectors that are none.

    The points are a bounded sample of the vectors, thinned to lie apart, and
    random directions up to the least number.
    """
    want = int(min(PIVOTS[1], max(PIVOTS[0], 2 * n ** 0.5)))
    million = 1_000_000
    part = min(million, int(million * 4 * want / max(n, 1)) + 1)
    drawn = reps.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("rep"), F.lit(million)) < part)).select("rep", "data")
    found = sorted((r["rep"], bytes(r["data"])) for r in drawn.collect())
    points = others = np.zeros((0, dims))
    if found:
        chosen: list[np.ndarray] = []
        passed: list[np.ndarray] = []
        sample = _unit([d for _, d in found], dims)
        for v in sample:
            if len(chosen) < want and (not chosen or (np.stack(chosen) @ v).max() < APART):
                chosen.append(v)
            elif len(passed) < TRIALS:
                passed.append(v)
        points = np.stack(chosen)
        others = np.stack(passed) if passed else others
    if len(points) < PIVOTS[0]:
        more = np.random.default_rng(11).standard_normal((PIVOTS[0] - len(points), dims))
        points = np.vstack([points, more / np.linalg.norm(more, axis=1, keepdims=True)])
    return points, others


def shared_points(points: np.ndarray, others: np.ndarray, cosine: float) -> tuple[int, int]:
    """(prefix length, least number of shared points) that RECALL of the pairs at ``cosine`` reach.

    It must hold for random directions and for the data: ``others``, turned by
    the angle towards differences between them.  The prefix is made longer
    until two points are asked for, or it holds all of them.
    """
    rng = np.random.default_rng(12)
    cases = [(rng.standard_normal((TRIALS, points.shape[1])), rng.standard_normal((TRIALS, points.shape[1])))]
    if len(others) > 2:
        a, b, c = (others[rng.integers(len(others), size=TRIALS)] for _ in range(3))
        cases.append((a, b - c))
    turned = []
    for x, away in cases:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        away = away - (away * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        good = size[:, 0] > 1e-9
        if good.any():
            x, away = x[good], (away / np.maximum(size, 1e-9))[good]
            turned.append((x, cosine * x + max(0.0, 1 - cosine * cosine) ** 0.5 * away))
    length = min(len(points), max(1, min(PREFIX, len(points) // 4)))
    while True:
        least = length
        for pair in turned:
            shared = np.empty(len(pair[0]), dtype=np.int64)
            for lo in range(0, len(shared), 512):
                held = np.zeros((2, min(512, len(shared) - lo), len(points)), dtype=bool)
                for h, v in zip(held, pair, strict=True):
                    np.put_along_axis(h, nearest(v[lo:lo + 512], points, length), True, axis=1)
                shared[lo:lo + 512] = (held[0] & held[1]).sum(axis=1)
            least = min(least, int(np.sort(shared)[int((1 - RECALL) * len(shared))]))
        if least >= 2 or length == len(points):
            return length, max(1, least)
        length = min(len(points), length + max(2, length // 4))


def nearest(unit: np.ndarray, points: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest points of each vector, nearest first."""
    sims = -(unit @ points.T)
    some = np.argpartition(sims, length - 1, axis=1)[:, :length]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(sims, some, axis=1), axis=1, kind="stable"), axis=1)


def _candidates(lists: np.ndarray, one: np.ndarray, two: np.ndarray, key: int, shared: int) -> np.ndarray:
    """Which rows ``one`` share ``shared`` points with which rows ``two``, of which ``key`` is the rarest.

    Ranks are by rarity, so a pair that shares a lower one than ``key`` belongs
    to another list: such a point takes away more than all others add.  Points
    with few rows are counted pair by pair, others as a product of 0/1 rows.
    """
    width = lists.shape[1]
    sides = []
    for rows in (one, two):
        held = lists[rows].ravel()
        order = np.argsort(held, kind="stable")
        sides.append((held[order], order // width))
    (left, a), (right, b) = sides
    both = np.intersect1d(left, right)
    i, j, k, m = (np.searchsorted(x, both, end) for x in (left, right) for end in ("left", "right"))
    adds = np.where(both >= key, 1, -width).astype(np.float32)
    counts = np.zeros((len(one), len(two)), dtype=np.float32)
    many = (j - i) * (m - k) > max(1, counts.size >> 11)
    for at in np.flatnonzero(~many).tolist():
        counts[np.ix_(a[i[at]:j[at]], b[k[at]:m[at]])] += adds[at]
    some = np.flatnonzero(many)
    for lo in range(0, len(some), 1024):
        part = some[lo:lo + 1024]
        x, y = (np.zeros((n, len(part)), dtype=np.float32) for n in counts.shape)
        for c, at in enumerate(part.tolist()):
            x[a[i[at]:j[at]], c] = 1
            y[b[k[at]:m[at]], c] = adds[at]
        counts += x @ y.T
    out = counts >= shared
    if one is two:
        np.fill_diagonal(out, False)
    return out


def _sides(side: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with each other: all of a block, or one block's with another's."""
    if i == j:
        rows = np.arange(len(side))
        return rows, rows
    return np.flatnonzero(side == i), np.flatnonzero(side == j)


def _linked(unit: np.ndarray, one: np.ndarray, two: np.ndarray, candidates: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows among ``candidates`` whose cosine is at least ``cosine``."""
    if candidates.mean() > 0.05:
        a, b = np.nonzero(candidates & (unit[one] @ unit[two].T >= cosine))
        return one[a], two[b]
    a, b = np.nonzero(candidates)
    near = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), 1 << 15):
        some = slice(lo, lo + (1 << 15))
        near[some] = np.einsum("ij,ij->i", unit[one[a[some]]], unit[two[b[some]]]) >= cosine
    return one[a[near]], two[b[near]]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors are linked when they share enough of their nearest pivots and their
    cosine, in double precision, is at least ``cosine``; equal vectors are
    always linked, and only the smallest id of each class is indexed.
    ``shared_points`` finds how many of how many for the wanted recall.  Vectors
    that share m of L points share one of the L - m + 1 rarest of both, so only
    those lists hold a vector.  Pivots are a bounded sample; every vector is
    indexed.  Long lists are cut into blocks, and counts and local components
    leave a task instead of pairs.

    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, and so do vectors of different lengths with each other.
    A null id is returned unlinked, kept, with a null component; rows that
    repeat an id count as so many vectors.  Other columns are ignored; an
    empty table gives an empty result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    seen = stored(_classes(base.filter("vec_id is not null")), "vectors")
    reps = stored(seen.groupBy("h1", "h2", "dims").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("data", "vec_id").alias("data")), "reps")
    counts: DataFrame | None = None
    edges: DataFrame | None = None
    for row in reps.groupBy("dims").count().orderBy("dims").collect():
        dims, n = row["dims"], row["count"]
        points, others = pivots(reps, dims, n)
        length, shared = shared_points(points, others, cosine)

        def describe(batches: Iterator[pa.RecordBatch], points: np.ndarray = points, length: int = length, dims: int = dims) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    data = part.column(2).to_pylist()
                    prefix = nearest(_unit(data, dims), points, length).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(k) for k in range(2)], pa.array([_packed(d) for d in data], pa.binary()), pa.array(list(prefix), pa.list_(pa.int32()))],
                        names=["rep", "copies", "data", "prefix"])

        described = stored(reps.filter(F.col("dims") == dims).select("rep", "copies", "data").mapInArrow(
            describe, "rep long, copies long, data binary, prefix array<int>"), "described")
        # Pivots by rarity: at most PIVOTS[1] numbers.
        held = {r["pivot"]: r["n"] for r in described.select(F.explode("prefix").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        rank = np.empty(len(points), dtype=np.int64)
        rank[sorted(range(len(points)), key=lambda p: (held.get(p, 0), p))] = np.arange(len(points))
        ranks = F.lit(rank.tolist()).cast("array<int>")
        listed = described.select("rep", F.transform("prefix", lambda p: F.element_at(ranks, p + 1)).alias("prefix"))
        posted = listed.select(F.explode(F.slice(F.array_sort("prefix"), 1, length - shared + 1)).alias("pivot"), "rep", "prefix")
        posted = posted.withColumn("pivot", F.col("pivot").cast("long"))
        sizes = posted.groupBy("pivot").agg(F.count("*").alias("n")).filter("n > 1")
        posted = in_blocks(posted, sizes, ["pivot"], "rep", LIST_BLOCK).select("pivot", "i", "j", "mine", "rep", "prefix")

        def count(batches: Iterator[pa.RecordBatch], shared: int = shared) -> Iterator[pa.RecordBatch]:
            for g in sorted_groups(batches, 3):
                if g.num_rows < 2:
                    continue
                key, i, j = (g.column(k)[0].as_py() for k in range(3))
                one, two = _sides(g.column(3).to_numpy(), i, j)
                met = _candidates(_ranks(g.column(5)), one, two, key, shared)
                some = np.zeros(g.num_rows, dtype=bool)
                some[one[met.any(axis=1)]] = some[two[met.any(axis=0)]] = True
                if some.any():
                    yield from g.filter(pa.array(some)).combine_chunks().to_batches()

        group = ["pivot", "i", "j"]
        near = stored(posted.mapInArrow(count, "pivot long, i long, j long, mine long, rep long, prefix array<int>"), "candidates")
        fetched = near.join(described.select("rep", "copies", "data"), "rep").repartition(*group).sortWithinPartitions(*group)

        def compare(batches: Iterator[pa.RecordBatch], dims: int = dims, shared: int = shared) -> Iterator[pa.RecordBatch]:
            for g in sorted_groups(batches, 3):
                key, i, j = (g.column(k)[0].as_py() for k in range(3))
                ids, copies = g.column(4).to_numpy(), g.column(6).to_numpy().astype(np.float64)
                one, two = _sides(g.column(3).to_numpy(), i, j)
                met = _candidates(_ranks(g.column(5)), one, two, key, shared)
                a, b = _linked(_unit(g.column(7).to_pylist(), dims), one, two, met, cosine)
                if i != j:
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                linked, label = np.bincount(a, weights=copies[b], minlength=len(ids)), ids.copy()
                while True:
                    new = label.copy()
                    np.minimum.at(new, a, label[b])
                    if (new == label).all():
                        break
                    label = new
                some = linked > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(linked[some].astype(np.int64)), pa.array(label[some])], names=["rep", "linked", "least"])

        found = stored(fetched.select(*group, "mine", "rep", "prefix", "copies", "data").mapInArrow(compare, "rep long, linked long, least long"), "links")
        some_counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
        some_edges = found.filter("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
        counts = some_counts if counts is None else counts.union(some_counts)
        edges = some_edges if edges is None else edges.union(some_edges)
    named = reps.select("h1", "h2", "dims", "rep", "copies")
    if counts is None or edges is None:
        named = named.withColumn("linked", F.lit(0).cast("long")).withColumn("component", F.col("rep"))
    else:
        # An id of several different vectors joins their components.
        named = named.join(counts.groupBy("rep").agg(F.sum("linked").alias("linked")), "rep", "left").join(
            components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.select("h1", "h2", "dims", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                F.coalesce("component", "rep").alias("component_id")), "named")
    linked = seen.select("vec_id", "h1", "h2", "dims").join(named, ["h1", "h2", "dims"]).select("vec_id", "n_links", "component_id")

    def invalid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [i is None or v is None for i, v in zip(batch.column(0).to_pylist(), _parse(batch.column(1)), strict=True)]
            yield batch.select([0]).filter(pa.array(bad, pa.bool_()))
    alone = base.mapInArrow(invalid, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
