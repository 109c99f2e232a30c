"""Connected components of a link table by contraction; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b); component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows pointers once and contracts the links;
    rounds grow with the logarithm of a component's width, and what is left of the links shrinks with each.
    """
    links = staged(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("parent"))
        parent = staged(parent, f"{name}-parents")
        up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        parent = staged(parent.join(up, "parent").select("id", F.col("next").alias("parent")), f"{name}-jumped")
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            on = parent.select(F.col("id").alias("component"), "parent")
            labels = staged(labels.join(on, "component", "left").select("id", F.coalesce("parent", "component").alias("component")), f"{name}-labels")
        left = parent.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        moved = links.join(left, "a").join(right, "b").where("pa != pb")
        links = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-links")
        if links.isEmpty():
            return labels
