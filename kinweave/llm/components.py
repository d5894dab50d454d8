"""Connected components by smallest labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import stored


def connected(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``v, label`` for every end of ``links`` (a, b): the smallest id of its component.

    Each round a node takes the smallest label among its own and its
    neighbours', then its label's label. Neighbours are combined in each task
    before they are shuffled, so a node with very many links is no hot key.
    Every round is written to the shared folder; the loop ends when no label
    changes.
    """
    both = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    sides = stored(links.select(F.explode(both).alias("e")).select("e.v", "e.w"), "links")
    labels = stored(sides.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = sides.join(labels.withColumnsRenamed({"v": "w", "label": "_l"}), "w").groupBy("v").agg(F.min("_l").alias("near"))
        hooked = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("new"))
        jump = labels.withColumnsRenamed({"v": "new", "label": "up"})
        jumped = hooked.join(jump, "new").select("v", F.least("new", "up").alias("new"), "label")
        labels = stored(jumped.select("v", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("changed")), "labels")
        if labels.filter("changed").isEmpty():
            return labels.drop("changed")
        labels = labels.drop("changed")
    raise RuntimeError("components didn't settle")
