"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _state(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v: long) but the roots themselves; the root
    is the least node of its component. Neighbours of a node are never gathered: each step takes a
    minimum, which combines before its shuffle, and joins it back, which Spark can split. ``rows``:
    the number of edges, if known. Rounds go on until nothing changes."""
    now = shared.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        done = [now]
        low = shared.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star", 2 * state[0])
        done.append(low)
        large = shared.stored(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-edges", 2 * state[0])
        low = shared.stored(large.groupBy("u").agg(F.min("v").alias("m")), "small-star", 2 * state[0])
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = shared.stored(small.distinct(), "edges", 2 * state[0])
        shared.discard(*done, large, low)
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
