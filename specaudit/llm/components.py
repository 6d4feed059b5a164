"""Connected components of links that are spread over executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: for each node with links, the least node that links lead to.

    Each round hooks every label onto the least label beside it, follows hooks until they end, and renames the
    links; links inside a label drop out. Labels that still have links at least halve in number in a round.
    Every round is written to the shared folder. A label with very many links only meets a minimum, which is
    taken on the map side first.
    """
    edges = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both(edges).select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not edges.isEmpty():
        hooks = materialise(both(edges).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("label"), F.least("a", "b").alias("to")), "hooks")
        while True:  # follow hooks to their ends
            nxt = hooks.select(F.col("label").alias("to"), F.col("to").alias("far"))
            jumped = materialise(hooks.join(nxt, "to", "left").select("label", F.coalesce("far", "to").alias("to")), "hooks")
            done = jumped.join(hooks, ["label", "to"], "left_anti").isEmpty()
            release(hooks)
            hooks = jumped
            if done:
                break
        renamed = materialise(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        new = edges.join(hooks.select(F.col("label").alias("a"), F.col("to").alias("ta")), "a", "left").join(hooks.select(F.col("label").alias("b"), F.col("to").alias("tb")), "b", "left")
        new = new.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = materialise(new, "edges")
        release(edges, labels, hooks)
        edges, labels = new, renamed
    release(edges)
    return labels
