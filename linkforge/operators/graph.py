"""Connected components."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of all nodes of an undirected graph, label the least node of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each an aggregation by node, until nothing
    changes. Each round only moves links to smaller nodes of the component, so rounds end; their number grows with the
    logarithm of the component's size. Each step of a round is written to the checkpoint folder.
    """
    both = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links, before = cut(both), None
    for _ in count():
        # What is joined is written first: both sides are then exchanged as they are, and the many links of a hub can be split.
        out = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(out.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        links = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        digest = lambda x: F.sum(x.cast("decimal(38,0)"))
        now = links.agg(F.count("*"), digest(F.hash("u", "v")), digest(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
