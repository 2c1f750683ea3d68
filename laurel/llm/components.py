"""Connected components of links, by star contraction.

Each round hangs every node's larger neighbours on its smallest one, then every node's neighbours on
the smallest of them; what is left are stars around the smallest node of each component, after a number
of rounds that grows with the logarithm of the longest path. A node with very many links is one row of a
minimum that is combined before the shuffle, and a skewed join key that adaptive execution splits; no
list of neighbours is ever made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.tables import remove, staged_at


def _mark(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to id and component, the smallest id that links reach; unlinked ids have no row.

    Links may repeat, go either way or lead to their own start; rows with a null are left out.
    """
    spark = links.sparkSession
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, path = staged_at(pairs, "links")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Written, so that the join with a node of very many links is one that adaptive execution can split.
        lowest, lowest_path = staged_at(both.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m")), "lowest")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = staged_at(large, "large")
        remove(spark, lowest_path)
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, after_path = staged_at(root.withColumnRenamed("m", "b").unionByName(moved).distinct(), "links")
        now = _mark(after)
        remove(spark, large_path)
        remove(spark, path)
        pairs, path = after, after_path
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For nodes 0 to ``size`` the smallest node that the links ``a``-``b`` reach; inside a task."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
