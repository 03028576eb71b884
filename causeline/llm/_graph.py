"""Connected components by DataFrame rounds; no task and no driver holds a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

EDGES_PER_FILE = 20_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id on an edge with the smallest id it can reach.

    Edges run from the larger to the smaller id. A round ties all smaller neighbours of an id to the smallest of
    them, then moves every id to its neighbour's neighbour; it ends when all edges point to roots. Minima are pre-aggregated,
    joins are plain equi-joins that adaptive execution may split, and each round is checkpointed.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    n = edges.count()
    while True:
        low = e.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = e.join(low, "hi").select(
            F.explode(
                F.when(F.col("lo") == F.col("m"), F.array(F.struct("hi", F.col("m").alias("lo"), F.lit(0).alias("moved")))).otherwise(
                    F.array(
                        F.struct("hi", F.col("m").alias("lo"), F.lit(1).alias("moved")),
                        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(1).alias("moved")),
                    )
                )
            ).alias("x")
        ).select("x.*")
        tied = tied.groupBy("hi", "lo").agg(F.max("moved").alias("moved"))
        # the key is written anew, so that both sides are dealt for this join and it may be split
        up = low.select(F.col("hi").bitwiseXOR(F.lit(0)).alias("lo"), F.col("m").alias("next"))
        new = tied.join(up, "lo", "left").select("hi", F.coalesce("next", "lo").alias("lo"), F.when(F.col("next").isNotNull(), 1).otherwise(F.col("moved")).alias("moved"))
        # dealt anew, so that the join before may be split where many ids share a neighbour
        new = new.repartition("hi").groupBy("hi", "lo").agg(F.max("moved").alias("moved"))
        # a file for so many edges, not for each partition: a round makes at most two edges of one
        new = cut(new.coalesce(max(1, 2 * n // EDGES_PER_FILE)))
        n, moved = new.agg(F.count(F.lit(1)), F.max("moved")).first()
        e = new.drop("moved")
        if not moved:
            roots = e.select(F.col("lo").alias("id")).distinct()
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
