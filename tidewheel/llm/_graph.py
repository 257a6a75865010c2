"""Connected components, and links of nodes that share a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._store import small_side, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large and small stars: each round ties nodes to the least of
    their neighbourhood with one minimum per node, so a node of any degree is
    pre-aggregated and no neighbour list is ever gathered.  Each round is
    written to the shared folder.
    """
    e = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def bucket_links(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of nodes linked through buckets: (node, component).

    ``rows`` has (key, node); ``verify`` keeps the true links of candidate pairs
    (a, b).  Candidates are stars, from the least and from the greatest node of
    each bucket to its members, so their number follows the rows.  A bucket
    whose members still lie in several components is then compared as a whole:
    ``compare`` gets (key, node) of such buckets and returns, as (a, b), edges
    that connect whatever is linked inside each.  Nothing that shares a bucket
    is left undecided, and no pairs are expanded.
    """
    rows = rows.select("key", "node")
    ends = stored(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"), "buckets")
    met = stored(rows.join(small_side(ends), "key").distinct(), "met")
    stars = (met.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")),
                                          F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))).alias("p"))
             .select("p.a", "p.b").filter("a != b").distinct())
    links = stored(verify(stored(stars, "pairs")), "links")
    groups = components(links)
    placed = stored(met.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "placed")
    # The two stars already compare all pairs of up to three nodes.
    split = (placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))
             .filter("lo < hi and n > 3").select("key"))
    split = stored(placed.join(small_side(stored(split, "split")), "key").select("key", "node"), "undecided")
    return components(links.union(compare(split)))
