"""Connected components of a table of links, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) of long ids -> (id, label): the smallest id that each id reaches.

    Every round a node and the root it points at take the smallest label around
    the node, and then that label's own label (hooking and pointer jumping), so the rounds follow the logarithm of a
    component's diameter.  Minima are summed in each task before the shuffle, and
    each round is a written table, so that a lost executor costs one round.
    Rows with a null end are no links; an empty table has no components."""
    links = links.where("a is not null and b is not null and a <> b")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialise(links.distinct(), "pairs")
    both = materialise(links.union(links.select("b", "a")).toDF("id", "to"), "links")
    labels = materialise(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("label").alias("seen")), "to").join(labels, "id")
        near = near.select(F.explode(F.array("id", "label")).alias("id"), "seen").groupBy("id").agg(F.min("seen").alias("seen"))
        hooked = labels.select("id", "label").join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        root = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        jumped = hooked.join(root, "label", "left").select("id", "was", F.coalesce("root", "label").alias("label"))
        before, labels = labels, materialise(jumped, "labels")
        discard(before)
        if labels.where("label <> was").isEmpty():
            discard(both, links)
            return labels.select("id", "label")
