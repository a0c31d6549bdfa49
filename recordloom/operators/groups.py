"""Connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import stored


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(ck, group_seq) with the least group_seq of the connected component; edges(a, b) in both directions."""
    labels = nodes
    touched = edges.select(F.col("a").alias("ck")).distinct()
    inner = stored(nodes.join(touched, "ck"), "labels")
    owner = inner.select(F.col("group_seq").alias("own"), F.col("ck").alias("owner"))
    while True:
        # least label of the neighbours, then the label of that label's owner
        near = edges.join(inner.withColumnRenamed("ck", "b"), "b").groupBy(F.col("a").alias("ck")).agg(F.min("group_seq").alias("m"))
        step = inner.join(near, "ck").select("ck", "group_seq", F.least("group_seq", "m").alias("now"))
        jump = step.select(F.col("ck").alias("owner"), F.col("now").alias("further"))
        after = step.join(owner, F.col("now") == F.col("own"), "left").join(jump, "owner", "left")
        after = stored(after.select("ck", F.col("group_seq").alias("before"), F.least("now", F.coalesce("further", "now")).alias("group_seq")), "labels")
        moved = after.where("before != group_seq").limit(1).count()
        inner = after.select("ck", "group_seq")
        if not moved:
            break
    return labels.join(touched, "ck", "left_anti").unionByName(inner)
