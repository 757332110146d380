"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.blocks import stored


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); equal labels mean connected.

    A round gives each node the smallest label around it and then the label of its
    label, so paths shorten to a fraction each time. Every round is written out.
    With ``rounds`` the work stops after that many: nodes with equal labels are
    connected then, but connected nodes may still differ.
    """
    both = stored(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")
    ), "labels")
    done = 1
    while rounds is None or done < rounds:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = stored(
            lower.join(jump, "to", "left").select(
                "node", F.col("label").alias("was"), F.least(F.col("to"), F.coalesce("further", "to")).alias("label")
            ),
            "labels",
        )
        labels, done = moved.select("node", "label"), done + 1
        if moved.where("was != label").isEmpty():
            break
    return labels
