"""Connected components by alternating large-star and small-star rounds.

Each round is two joins with pre-aggregated minima, so a node with very many
edges is one row per task before it is shuffled, and the edge side of the join
may be split.  Rounds end when the edges stop changing; every node then points
at the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 100


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and
    its neighbours."""
    all_ = _both(edges)
    low = all_.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return all_.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of
    them.  Edges point from the larger node (u) to the smaller (v)."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    side = down.join(low, "u")
    out = side.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
                                        F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids -> (d, comp) for every id that has a link;
    ``comp`` is the smallest id reachable.  Self-links and repeated links
    change nothing; no links give no rows."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        edges = cut(small_star(large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("d"), F.col("v").alias("comp"))
    return cut(nodes.union(edges.select(F.col("v").alias("d"), F.col("v").alias("comp"))).distinct())
