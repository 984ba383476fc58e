"""Connected components of a table of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_saved, saved


def _hung(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours. Both sides grow with the edges, so neither passes through the driver."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.hint("merge"), "u").withColumn("m", F.least("u", "m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its least one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    hung = _hung(down)
    own = hung.select("u", F.col("m").alias("v"))
    return own.union(hung.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u long, v long), as a table of the shared folder: root is the least node of its component.

    Each round writes its edges to the shared folder, so that a lost executor never reaches back over rounds; it ends
    when a round changes nothing: every node then hangs on its root. Rounds grow with the logarithm of the largest component.
    """
    now, was = saved(edges.select("u", "v").filter("u <> v").distinct(), "edges"), None
    for _ in range(most):
        new = saved(_small(_large(now)), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_saved(now)
        now = new
        if mark == was:
            found = saved(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "roots")
            drop_saved(now)
            return found
        was = mark
    raise RuntimeError(f"components did not settle in {most} rounds")
