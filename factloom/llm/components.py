"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

#: Hooks that are followed before they are written.
STEPS = 3


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links(a, b).

    In each round, each component is hooked to the smallest component that a link joins it to, chains of hooks are shortened, and the
    links between the components that are left go on: about a logarithmic number of rounds. Nodes follow the rounds' hooks at the end. Repeated links and links from a node
    to itself are harmless. Hooks are counted by component and combine before the shuffle, so a hub with any number
    of links is no hot key; no links or components go to the driver.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    links = links.where("a <> b")
    while not links.isEmpty():
        hooks = _shortened(links.groupBy("a").agg(F.min("b").alias("to")))
        labels = labels.join(hooks.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        at_a, at_b = hooks.select("a", F.col("to").alias("to_a")), hooks.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved_links = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y")).where("x <> y")
        links = stored(moved_links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    return stored(labels, "labels")


def _shortened(hooks: DataFrame) -> DataFrame:
    """hooks(a, to), each to the end of its chain. A pass follows STEPS hooks, each of them as far as earlier passes have brought it."""
    hooks = stored(hooks, "hooks")
    while True:
        far, moved = hooks, F.lit(False)
        for k in range(STEPS):
            step = hooks.select(F.col("a").alias("to"), F.col("to").alias(f"to_{k}"))
            far = far.join(step, "to", "left").withColumn("to", F.coalesce(f"to_{k}", "to"))
            moved = moved | F.col(f"to_{k}").isNotNull()
        hooks = stored(far.select("a", "to", moved.alias("moved")), "hooks")
        done = hooks.where("moved").isEmpty()
        hooks = hooks.select("a", "to")
        if done:
            return hooks
