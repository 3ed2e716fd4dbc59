"""Connected components by alternating large-star and small-star steps, every step a grouping with
partial minima and a join; each round is written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stage


#: How many tasks at least share the edges of one node.
SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: link every larger neighbour of a node to the node's least neighbour;
    small: link a node and its smaller neighbours to the least of them."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a hub's edges are dealt by their other end as well, and its one row is there for each of those
    dealt = least.select("u", "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("s"))
    linked = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(dealt, ["u", "s"])
    out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: src, dst of any one orderable type; order and repeats don't matter. Returns node,
    component (its least node) for all nodes of an edge with two ends that differ; rows with a null
    end are left out."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stage(e)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    for _ in range(most_rounds if seen[0] else 0):
        e = stage(_star(_star(e, True), False))
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
