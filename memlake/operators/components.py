"""Connected components of an edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.shared import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b); root is the smallest node of its component.

    Large-star and small-star rounds in turn, each stored in the shared folder, until nothing changes. Hot nodes arrive
    pre-aggregated at the minimum, and Spark splits them in the joins. Loops and null ends are dropped.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stash(edges.where("a <> b").select(a, b).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        across = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stash(across.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of an edge list."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
