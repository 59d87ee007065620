"""Connected components, on a driver in numpy for one shard's links and in Spark for the links of all shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b lead to: hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while not np.array_equal(up := root[root], root):
            root = up


def _is_star(links: DataFrame) -> bool:
    """Whether each node links to one smaller node that links to none."""
    twice = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return not twice.unionByName(chained).take(1)


def roots(links: DataFrame) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node. links: (a, b), b < a.

    Alternating large and small stars, by minima and joins only. The links of a hub, a node of more than its share of them,
    stay where they are and get its minimum by broadcast; a round's links are a table in the shared folder.
    """
    links = written(links.distinct(), "links")
    while not _is_star(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both, least, "a", 2 * links.count()).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "a", large.count()).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        links = written(small.select("x.a", "x.b").where("a > b").distinct(), "links")
    return links
