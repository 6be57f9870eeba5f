"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the edges (u, v).

    Alternates two steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones and itself, to its smallest neighbour.  Both
    keep components whole and shorten ways, so a few rounds suffice.  The smallest
    neighbour is a partial aggregate; it is joined back by a key of its own, so a
    hub's neighbours can be split over tasks.  Every round is written to the
    shared folder.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                        "edges")
    before = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = star(both, both.where("v > u"))
        edges = cut_lineage(star(edges, edges), "edges")
        now = fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and hardly ever else."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.hash("u", "v").cast("long"))).head())


def star(known: DataFrame, handed: DataFrame) -> DataFrame:
    """Edges (larger, smaller) from the handed neighbours v of u, and u itself, to the smallest of u's known neighbours and u."""
    least = known.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    keyed = least.select(F.xxhash64("u").alias("key"), F.col("u").alias("its"), "least")
    met = handed.withColumn("key", F.xxhash64("u")).join(keyed, "key").where(F.col("u") == F.col("its"))
    out = met.select("v", "least").unionByName(least.select(F.col("u").alias("v"), "least"))
    return out.where("v <> least").select(F.greatest("v", "least").alias("u"), F.least("v", "least").alias("v")).distinct()
