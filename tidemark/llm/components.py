"""Connected components of a large graph, by alternating stars (Kiveris et al., 2014).

A large-star round hooks every neighbour above a node to the least of its neighbourhood, a
small-star round does so for the neighbours below; edges stay as many as nodes and links, and the
number of rounds grows with the logarithm of the longest path. Only edges move, and only a count
and a checksum reach the driver. A node with very many neighbours is spread over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that is not the least of its component,
    and component is that least node. Loops and repeated edges do no harm."""
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while (new := _state(now)) != state:
        state = new
        if not state[0]:
            break
        # neighbours above a node go to the least below it, or stay with the node if it has none below
        below = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = spread_join(now, below, "v", "u").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The least place of the component of each of n places, from links a-b; ``roots`` are those of
    links seen before."""
    roots = np.arange(n) if roots is None else roots
    while True:
        x, y = roots[a], roots[b]
        open_ = x != y
        if not open_.any():
            return roots
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (again := roots[roots]).tobytes() != roots.tobytes():
            roots = again
