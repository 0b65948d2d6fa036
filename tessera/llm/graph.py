"""Connected components of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame | None:
    """(unit, label) of each unit in links (a, b): label is the least one it is connected with. None
    without links.

    Labels fall to the neighbours' least and then jump to the label's own label, until none changes;
    every round ends in a work table. All aggregates combine on the map side, so a node with very
    many neighbours is no burden to one task.
    """
    both = links.select(F.col("a").alias("unit"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("unit"), F.col("a").alias("near")))
    both = materialise(both.distinct(), "edges")
    if not both.limit(1).count():
        return None
    labels = materialise(both.groupBy("unit").agg(F.least("unit", F.min("near")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("unit", "near"), "near").groupBy("unit").agg(F.min("label").alias("lower"))
        fallen = labels.join(near, "unit").select("unit", F.col("label").alias("old"), F.least("label", "lower").alias("label"))
        jump = labels.select(F.col("unit").alias("label"), F.col("label").alias("next"))
        fallen = materialise(fallen.join(jump, "label", "left").select("unit", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        release(labels)
        labels = fallen
        if not fallen.where("old <> label").limit(1).count():
            release(both)
            return labels.select("unit", "label")
