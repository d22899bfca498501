"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every endpoint of links (a, b); component is the least id that can be reached.

    Each round hands every node the least label among its neighbours and then jumps to that label's own label, so the rounds
    grow with the logarithm of a component's diameter. Labels are written to the shared folder each round. Null endpoints and
    links from a node to itself are ignored; an empty table gives an empty one.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = staged(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        hung = labels.join(near, "u").select("u", F.col("l").alias("before"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("root"))
        fresh = staged(hung.join(jump, "l").select("u", "before", F.least("l", "root").alias("l")), "labels")
        if fresh.where("l <> before").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))
        labels = fresh.select("u", "l")
