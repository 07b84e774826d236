"""Connected components of a links table, in rounds of joins whose results go to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roundsmith.llm.storage import drop, saved

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links(a, b: long) -> node, comp: each linked node with the smallest node it can reach, saved.

    Alternates large-star and small-star steps (Kiveris et al. 2014); ends when a round changes
    nothing, and raises after MAX_ROUNDS rather than return unfinished labels. Edges stay distributed;
    the stars that take shape point many nodes at one, and each step aggregates before it joins.
    """
    both = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = saved(both, "edges")
    seen = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        # large star: each node links its larger neighbours to its smallest neighbour
        ends = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select(F.col("lo"), F.col("hi")))
        least = ends.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("x"))
        large = edges.select(F.col("lo").alias("n"), "hi").join(least, "n").select("hi", F.col("x").alias("lo")).distinct()
        # small star: each node links itself and its smaller neighbours to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("x"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("x").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("x").alias("lo"))).distinct()
        before, edges = edges, saved(small, "edges")
        drop(before)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
    own = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("comp"))
    out = saved(own.union(edges.select(F.col("lo").alias("node")).distinct().join(own.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))), "comps")
    drop(edges)
    return out


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums of an edge table: equal when a round changed nothing."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0)), F.coalesce(F.sum(h.bitwiseAND(F.lit(2**31 - 1))), F.lit(0))).first())
