"""Connected components of an edge table by alternating large-star and small-star contraction (Kiveris et al., 2014).

Each round is two aggregations and two joins on the node. The least neighbours are written before they are joined, so both sides
of a join come straight from a shuffle and adaptive execution can split a hub's edges over tasks; sums are combined before they
are shuffled. The driver sees only a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


#: Edges of one output file or so: small rounds are written by a few tasks, large ones by more.
FILE_EDGES = 10_000


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least.coalesce(files), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs to (node, root): root is the smallest node of the component; isolated nodes have no row.

    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum((F.xxhash64("u", "v") / F.lit(1 << 20)).cast("long"))).first())

    before = state(edges)
    while before[0]:
        files = before[0] // FILE_EDGES + 2
        # not narrowed before it is written: a hub's edges are split over the tasks of this join
        stars = materialize(_large_star(edges, files), "stars")
        edges = materialize(_small_star(stars, files).coalesce(files), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
