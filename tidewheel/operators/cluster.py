"""Agglomerative clustering of columns or symbols.

The distances are Spark aggregates; what is merged here on the driver is a
K x K matrix (columns, or symbols of the panel), not data.  Symbol profiles are
merged in rounds of Spark jobs until few clusters are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.names import SYMBOL
from tidewheel.operators.correlation import column_correlation, symbol_correlation
from tidewheel.operators.structure import symbol_profile
from tidewheel.session import pin, scratch_path

MAX_ITEMS = 4_000  # a matrix of this order and its pairs fit the driver easily
FEW = 1_000        # clusters of profiles that the driver merges to the end
BLOCK = 8_192      # clusters on either side of a task that compares two blocks
SLICE = 64         # rows of a block compared at once


def merge_order(dist: np.ndarray, method: str, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (kept cluster, absorbed cluster, height), lowest height first.

    ``complete`` takes the largest, ``average`` the size-weighted mean and
    ``ward`` the variance-growth distance between clusters.  ``sizes`` are the
    items of each cluster to begin with, one by default.
    """
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d)) if sizes is None else sizes.astype(float).copy()
    merges = []
    for _ in range(len(d) - 1):
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        h = d[i, j]
        merges.append((i, j, float(h)))
        if method == "complete":
            row = np.maximum(d[i], d[j])
        elif method == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "ward":
            total = size[i] + size[j] + size
            with np.errstate(invalid="ignore"):
                row = np.sqrt(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * h * h) / total)
            row[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        else:
            raise ValueError(f"unknown linkage {method}")
        size[i] += size[j]
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
    return merges


def cut(n: int, merges: list[tuple[int, int, float]], height: float | None = None, k: int | None = None) -> list[int]:
    """Labels 1.. in order of first member, cut at a height or into k clusters."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = n
    for i, j, h in sorted(merges, key=lambda m: m[2]):
        if (height is not None and h > height) or (k is not None and left <= k):
            break
        parent[root(j)] = root(i)
        left -= 1
    order: dict[int, int] = {}
    return [order.setdefault(root(x), len(order) + 1) for x in range(n)]


def feature_clusters(df: DataFrame, cols: list[str], threshold: float = 0.6) -> DataFrame:
    """(feature, cluster, medoid): |corr| clusters by complete linkage."""
    return clusters_from_matrix(df.sparkSession, cols, column_correlation(df, cols), threshold)


def clusters_from_matrix(spark, names: list[str], corr: np.ndarray, threshold: float) -> DataFrame:
    strength = np.abs(corr)
    labels = cut(len(names), merge_order(1.0 - strength, "complete"), height=1.0 - threshold)
    rows = []
    for lb in sorted(set(labels)):
        members = [i for i, x in enumerate(labels) if x == lb]
        medoid = members[int(np.argmax(strength[np.ix_(members, members)].sum(axis=0)))]
        rows += [(names[i], lb, i == medoid) for i in members]
    return spark.createDataFrame(rows, "feature string, cluster int, medoid boolean")


def _few(df: DataFrame) -> DataFrame:
    """The table itself, once it is known to have one row per item and few items."""
    n = df.select(SYMBOL).distinct().count()
    if n > MAX_ITEMS:
        raise ValueError(f"{n} symbols: pairwise linkage is limited to {MAX_ITEMS}; cluster groups of symbols instead")
    return df


def symbol_clusters(df: DataFrame, col: str, k: int = 3, min_obs: int = 501) -> DataFrame:
    """(symbol_id, cluster): average linkage on 1 - corr of a label."""
    symbols = sorted(r[0] for r in _few(df).select(SYMBOL).distinct().collect())
    at = {s: i for i, s in enumerate(symbols)}
    c = np.eye(len(symbols))
    for r in symbol_correlation(df, col, min_obs).collect():
        c[at[r["a"]], at[r["b"]]] = c[at[r["b"]], at[r["a"]]] = r["corr"] or 0.0
    labels = cut(len(symbols), merge_order(1.0 - c, "average"), k=k)
    return df.sparkSession.createDataFrame(list(zip(symbols, labels)), f"{SYMBOL} long, cluster int")


def _growth(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Squared Ward distances of clusters with centroids x, y and sizes n, m; the same from either side."""
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - y[None, :, c]) ** 2
    return d * (2.0 / (1.0 / n[:, None] + 1.0 / m[None, :]))


def _nearest(clusters: DataFrame, n: int, xs: list[str]) -> DataFrame:
    """(id, near, d2) of every cluster: its nearest other one, ties by the smaller id.

    Every block of clusters meets every block once, and both sides keep their
    best; no distance leaves a task.
    """
    parts = -(-n // BLOCK)
    sides = clusters.select("id", "size", *xs, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_p"))
    left = sides.withColumn("_q", F.explode(F.sequence("_p", F.lit(parts - 1))))
    right = sides.withColumnRenamed("_p", "_q").withColumn("_p", F.explode(F.sequence(F.lit(0), "_q")))

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        return ids[order], table.column("size").to_numpy()[order], np.column_stack([table.column(c).to_numpy() for c in xs])[order]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        (i, n, x), (j, m, y) = read(a), read(b)
        same = bool(len(i)) and np.array_equal(i, j)
        to, best = np.zeros(len(i), dtype=np.int64), np.full(len(i), np.inf)
        back, least = np.zeros(len(j), dtype=np.int64), np.full(len(j), np.inf)
        for k in range(0, len(i) if len(j) else 0, SLICE):
            d = _growth(x[k:k + SLICE], n[k:k + SLICE], y, m)
            rows = np.arange(len(d))
            if same:
                d[rows, rows + k] = np.inf
            at = d.argmin(axis=1)
            to[k:k + SLICE], best[k:k + SLICE] = j[at], d[rows, at]
            if not same:
                at = d.argmin(axis=0)
                low = d[at, np.arange(len(j))]
                closer = low < least
                back[closer], least[closer] = i[k + at[closer]], low[closer]
        found = pa.table({"id": np.concatenate([i, j]), "near": np.concatenate([to, back]), "d2": np.concatenate([best, least])})
        return found.filter(pa.array(np.isfinite(found.column("d2").to_numpy())))

    met = left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInArrow(compare, "id long, near long, d2 double")
    best = met.groupBy("id").agg(F.min(F.struct("d2", "near")).alias("_b"))
    return best.select("id", F.col("_b.near").alias("near"), F.col("_b.d2").alias("d2"))


def _ward_round(clusters: DataFrame, n: int, xs: list[str]) -> DataFrame:
    """(id, size, height, xs, absorbed): the clusters after all pairs of mutual nearest ones have merged.

    No later merge can come between such a pair, so rounds build the tree that
    one merge at a time would build.  A pair keeps its smaller id.
    """
    near = _nearest(clusters, n, xs)
    mutual = (near.groupBy(F.least("id", "near").alias("_lo"), F.greatest("id", "near").alias("_hi"))
              .agg(F.count(F.lit(1)).alias("_n"), F.max("d2").alias("_d2")).where("_n = 2")
              .select(F.explode(F.array("_lo", "_hi")).alias("id"), "_lo", "_d2"))
    return (clusters.drop("absorbed").join(mutual, "id", "left").groupBy(F.coalesce("_lo", "id").alias("_to"))
            .agg(F.sum("size").alias("size"), F.greatest(F.max("height"), F.coalesce(F.sqrt(F.max("_d2")), F.lit(0.0))).alias("height"),
                 *[F.when(F.count(F.lit(1)) == 1, F.max(c)).otherwise(F.sum(F.col("size") * F.col(c)) / F.sum("size")).alias(c) for c in xs],
                 F.when(F.count(F.lit(1)) == 2, F.max("id")).alias("absorbed"))
            .withColumnRenamed("_to", "id"))


def _stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back.

    A checkpoint keeps the size Spark estimates for its plan, and a join's is
    the product of its sides': in a loop the digits of that number double every
    round, until the driver has no room for it.  Files have their own size.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tops(edges: DataFrame) -> DataFrame:
    """(id, top) of every absorbed id: where its chain of (id, top) edges ends, by doubling."""
    while True:
        ahead = edges.select(F.col("id").alias("top"), F.col("top").alias("_next"))
        step = _stored(edges.join(ahead, "top", "left").select("id", F.coalesce("_next", "top").alias("top"), F.col("_next").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            return edges
        edges = step.select("id", "top")


def ward_labels(profiles: DataFrame, cols: list[str], k: int, few: int = FEW) -> DataFrame:
    """(symbol_id, cluster) by Ward linkage, cut into k clusters, numbered by their smallest symbol.

    Up to ``few`` profiles are merged on the driver.  Of more, equal ones are one
    cluster from the start and stay together, and rounds merge mutual nearest
    clusters until ``few`` are left.  Only these, their merges and the k - 1
    highest merges of the rounds reach the driver; the others give each symbol
    its cluster by joins.
    """
    spark = profiles.sparkSession
    xs = [f"_x{i}" for i in range(len(cols))]
    items = pin(profiles.select(F.col(SYMBOL).cast("long").alias(SYMBOL), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(cols, xs)]))
    if items.count() <= few:
        rows = sorted(items.collect(), key=lambda r: r[SYMBOL])
        x = np.array([[r[c] for c in xs] for r in rows], dtype=float).reshape(len(rows), len(xs))
        one = np.ones(len(rows))
        labels = cut(len(rows), merge_order(np.sqrt(_growth(x, one, x, one)), "ward"), k=k)
        return spark.createDataFrame([(r[SYMBOL], lb) for r, lb in zip(rows, labels)], f"{SYMBOL} long, cluster int")
    clusters = _stored(items.groupBy(*xs).agg(F.min(SYMBOL).alias("id"), F.count(F.lit(1)).cast("double").alias("size"))
                       .select("id", "size", F.lit(0.0).alias("height"), *xs, F.lit(None).cast("long").alias("absorbed")))
    owner = items.join(clusters.select("id", *xs), xs).select(SYMBOL, "id")
    left, done = clusters.count(), []
    while left > few:
        clusters = _stored(_ward_round(clusters, left, xs))
        done.append(clusters.where("absorbed IS NOT NULL").select(F.lit(len(done)).alias("round"), "id", "absorbed", "height"))
        left = clusters.count()
    rows = sorted(clusters.collect(), key=lambda r: r["id"])
    x, n = np.array([[r[c] for c in xs] for r in rows], dtype=float), np.array([r["size"] for r in rows])
    high = [r["height"] for r in rows]
    late = []
    for i, j, h in merge_order(np.sqrt(_growth(x, n, x, n)), "ward", n):
        high[i] = max(h, high[i], high[j])
        late.append((high[i], len(done) + len(late), i, j))
    early = None
    for merges in done:
        early = merges if early is None else early.unionByName(merges)
    top = [] if early is None else early.orderBy(F.desc("height"), F.desc("round"), F.desc("absorbed")).limit(k - 1).collect()
    # The k - 1 highest merges of all are undone; heights grow and rounds rise along the tree, so whatever lies above one is among them.
    undone = sorted([(h, r, None, j) for h, r, _, j in late] + [(t["height"], t["round"], t["absorbed"], None) for t in top],
                    key=lambda m: (m[0], m[1], m[2] or 0), reverse=True)[:k - 1]
    apart = {j for _, _, absorbed, j in undone if absorbed is None}
    kept = [(i, j, 0.0) for _, _, i, j in late if j not in apart]
    first: dict[int, int] = {}
    ends = [(r["id"], first.setdefault(lb, r["id"])) for r, lb in zip(rows, cut(len(rows), kept))]
    if early is not None:
        parted = [m[2] for m in undone if m[2] is not None]
        links = early.select(F.col("absorbed").alias("id"), F.col("id").alias("top"))
        owner = (owner.join(_tops(_stored(links.where(~F.col("id").isin(parted)) if parted else links)), "id", "left")
                 .select(SYMBOL, F.coalesce("top", "id").alias("id")))
    grouped = (owner.join(spark.createDataFrame(ends, "id long, _end long"), "id", "left")
               .select(SYMBOL, F.coalesce("_end", "id").alias("_end")))
    firsts = grouped.groupBy("_end").agg(F.min(SYMBOL).alias("_first"))  # one row per cluster
    numbered = firsts.select("_end", F.row_number().over(Window.orderBy("_first")).alias("cluster"))
    return grouped.join(numbered, "_end").select(SYMBOL, "cluster")


def profile_clusters(df: DataFrame, cols: list[str], k: int = 6) -> DataFrame:
    """(symbol_id, cluster): Ward linkage of standardised symbol profiles."""
    return ward_labels(symbol_profile(df, cols), cols, k)
