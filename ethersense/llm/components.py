"""Connected components of an edge table by repeated contraction onto smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.session import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node on an edge; component is its smallest reachable node.

    Each round sends every node to its smallest neighbour, jumps pointers twice, and keeps the edges
    between different targets, so a star of any size and a long chain both shrink fast. Rounds are
    stored tables. Self loops and nulls are ignored; no edges give an empty table.
    """
    u, v = F.col(a), F.col(b)
    links = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(
        F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi")
    ).distinct()
    links = materialise(links, "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select(F.col("lo").alias("node"), F.col("lo").alias("to")).union(
            links.select(F.col("hi"), F.col("lo"))
        )
        parent = both.groupBy("node").agg(F.min("to").alias("to"))
        near = parent = materialise(parent, "parent")
        for _ in range(2):
            far = parent.select(F.col("node").alias("to"), F.col("to").alias("far"))
            parent = parent.join(far, "to").select("node", F.col("far").alias("to"))
        parent = materialise(parent, "parent")
        discard(near)
        steps.append(parent)
        lo = parent.select(F.col("node").alias("lo"), F.col("to").alias("x"))
        hi = parent.select(F.col("node").alias("hi"), F.col("to").alias("y"))
        old, links = links, materialise(
            links.join(lo, "lo").join(hi, "hi").where("x <> y")
            .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(),
            "links",
        )
        discard(old)
    if not steps:
        return links.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        found = found.join(
            step.select(F.col("node").alias("component"), "to"), "component", "left"
        ).select("node", F.coalesce("to", "component").alias("component"))
    found = materialise(found, "components")
    discard(links, *steps)
    return found
