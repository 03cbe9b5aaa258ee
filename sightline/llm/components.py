"""Connected components over a table of links, by alternating star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so a node with
very many links is never gathered in one place. Lineage is cut by checkpoint() per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Links are undirected; loops and repeats do no harm; links with a null end are ignored.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = checkpointed(edges.select(high.alias("u"), low.alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        edges = checkpointed(
            small.select("u", F.col("m").alias("v")).unionByName(linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        )
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
