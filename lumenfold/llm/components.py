"""Connected components over links, with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut_lineage, join_hot


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of `links` (a, b); component is the least id that links reach.

    Each round takes the least label among the neighbours, then the label of that label, so long chains halve; minima
    are combined before they are shuffled, and each round's labels are written to the checkpoint folder. When no
    neighbour has a lesser label, every link has one label at both ends, and the labels are final.
    """
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = cut_lineage(ends.union(ends.select("v", "u")).filter("u <> v").distinct())
    labels = cut_lineage(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("component"), F.count(F.lit(1)).alias("_links")))
    n_edges, n_ends = labels.agg(F.coalesce(F.sum("_links"), F.lit(0)), F.count(F.lit(1))).first()
    while True:
        ends = labels.select(F.col("id").alias("v"), "component", "_links")
        near = join_hot(edges, ends, "v", "_links", -F.abs(F.col("u")) - 1, n_edges).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("_near"))
        step = cut_lineage(labels.join(near, "id").select("id", "_links", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")))
        if step.filter("_new <> _old").isEmpty():
            return step.select("id", F.col("_new").alias("component"))
        # a label is an end itself, so its own label is there too
        heads = step.groupBy("_new").agg(F.count(F.lit(1)).alias("_n"))
        jump = cut_lineage(heads.join(step.select(F.col("id").alias("_new"), F.col("_new").alias("_far")), "_new"))
        labels = cut_lineage(join_hot(step, jump, "_new", "_n", -F.abs(F.col("id")) - 1, n_ends).select("id", "_links", F.least("_new", "_far").alias("component")))
