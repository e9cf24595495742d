"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """Columns ``node``, ``component`` for every node that an edge names.

    ``edges`` has two columns of one orderable type; the component of a node is
    the smallest node it reaches.  Alternating large-star and small-star steps
    (Kiveris et al., 2014) need a logarithmic number of rounds and never gather
    a component in one place: each step groups by node with a minimum that is
    partially aggregated before the shuffle.  Edges with a null end and loops
    are ignored.  Every round is written to shared storage.
    """
    a, b = edges.columns[:2]
    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v and (u > v)").distinct(),
        f"{label}-0",
    )
    before, k = None, 0
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state or not state["n"]:
            break
        before, k = state, k + 1
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are saved first: a join of two plain shuffles can split a node with very many edges.
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct(), f"{label}-large")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        small = large.join(least, "u")
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.save(star, f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    own = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return own.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
