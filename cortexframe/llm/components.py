"""Connected components over edge tables, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import materialize


def _neighbours_least(edges: DataFrame) -> DataFrame:
    """``v, m``: the least vertex among each vertex and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v, root`` for every vertex of ``edges(u, v)``; the root is the least vertex of the component.

    Union-find as alternating large and small stars: each round hangs neighbours under the least vertex seen, first the
    larger ones, then all. Least neighbours are partial aggregations and joins spread frequent vertices, so no
    neighbourhood is collected. A round is written to the shared folder before the next one reads it.
    """
    now = materialize(_ordered(edges))
    for _ in range(max_rounds):
        least = _neighbours_least(now)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = spread_join(both.filter("v > u"), least.withColumnRenamed("v", "u"), ["u"], "v")
        after = materialize(_ordered(large.select(F.col("m").alias("u"), "v")))
        # small star: of a vertex and its smaller neighbours, all hang under the least
        under = after.groupBy("v").agg(F.min("u").alias("m"))
        small = spread_join(after, under, ["v"], "u")
        star = small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v"))
        new = materialize(_ordered(star))
        # done when every vertex hangs under one root that hangs under nothing
        roots = new.select(F.col("u").alias("v")).distinct()
        several = new.groupBy("v").count().filter("count > 1")
        if new.join(roots, "v", "left_semi").limit(1).count() == 0 and several.limit(1).count() == 0:
            found = new.select("v", F.col("u").alias("root"))
            return materialize(found.unionByName(roots.select("v", F.col("v").alias("root"))))
        now = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _ordered(edges: DataFrame) -> DataFrame:
    pair = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pair.filter("u != v").distinct()
