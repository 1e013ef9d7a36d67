"""Connected components of an edge table, without a vertex's edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import discard, materialize


def connected(links: DataFrame, label: str = "components") -> DataFrame:
    """Links (a, b) as (id, component): the smallest id that each linked id reaches.

    Each round gives a vertex the least label among its neighbours, and then
    gives all that shared its old label the least that any of them received, so
    the rounds needed grow with the logarithm of a component's breadth. Labels
    are written to the shared folder after each round. All aggregations are
    minima, which combine before they move; the joins have a hub's edges on one
    side only, where adaptive execution splits them.
    """
    both = links.where("a != b").select("a", "b")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("component"))
    labels = materialize(labels, f"{label}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["id"] == near["a"]).where("near < component").select("component", "near")
        roots = materialize(moved.groupBy("component").agg(F.min("near").alias("root")), f"{label}-roots-{k}")
        if roots.isEmpty():
            discard(both)
            return labels
        new = labels.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        old, labels = labels, materialize(new, f"{label}-{k}")
        discard(old)
        discard(roots)
