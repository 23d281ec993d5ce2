"""How groups change over a range of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from . import groups as G


def thresholds(low: int, high: int, step: int = 5) -> list[int]:
    return list(range(low, high + 1, step))


def evolution(members: DataFrame, scores: DataFrame, steps: list[int], min_group_size: int = 2, keep_representative: bool = True) -> DataFrame:
    """Members of the groups at the lowest threshold, at each threshold: in the group while close enough to its representative.

    members, scores: (group_key, member_id) and (group_key, src, dst, score) of the components at the lowest threshold,
    written, since they are read several times. keep_representative=False gives the representative a score of 0 to itself,
    so that it leaves its own group.
    """
    base = G.analyse(members, scores).where(F.col("group_size") >= min_group_size).select("group_id", "group_key", "representative_id")
    both = scores.select("group_key", F.col("src").alias("representative_id"), F.col("dst").alias("member_id"), "score").unionByName(scores.select("group_key", F.col("dst").alias("representative_id"), F.col("src").alias("member_id"), "score"))
    rows = members.join(base, "group_key").join(both, ["group_key", "representative_id", "member_id"], "left")
    own = F.col("member_id") == F.col("representative_id")
    rows = rows.withColumn("similarity_to_representative", F.when(own, F.lit(100.0 if keep_representative else 0.0)).otherwise(F.col("score")))
    rows = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, sorted(steps)))))
    rows = rows.withColumn("in_group", F.col("similarity_to_representative") >= F.col("threshold"))
    # Members of a group at a threshold are bounded by the group; sums are combined before the shuffle, then joined.
    kept = rows.where("in_group").groupBy("group_key", "threshold").agg(F.count("*").alias("group_size_at_threshold"), F.min("similarity_to_representative").alias("lo"), F.avg("similarity_to_representative").alias("mean"))
    out = rows.join(kept, ["group_key", "threshold"], "left")
    return out.select("group_id", "threshold", "member_id", own.alias("is_representative"), "similarity_to_representative", F.coalesce("group_size_at_threshold", F.lit(0)).cast("long").alias("group_size_at_threshold"), F.round(F.coalesce("lo", F.lit(0.0)), 2).alias("group_min_similarity"), F.round(F.coalesce("mean", F.lit(0.0)), 2).alias("group_avg_similarity"), "in_group")


def summary(evolved: DataFrame, steps: list[int], n_products: int) -> DataFrame:
    """Figures for each threshold, those without groups included; the mean is by member rows."""
    spark = evolved.sparkSession
    kept = evolved.where("in_group").groupBy("threshold").agg(
        F.countDistinct("group_id").alias("groups_found"), F.countDistinct("member_id").alias("products_in_groups"), F.max("group_size_at_threshold").alias("largest_group_size"), F.avg("group_avg_similarity").alias("avg_group_similarity")
    )
    every = spark.createDataFrame([(t,) for t in steps], "threshold int")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(kept, "threshold", "left").select("threshold", zero("groups_found"), zero("products_in_groups"), zero("largest_group_size"), F.coalesce("avg_group_similarity", F.lit(0.0)).alias("avg_group_similarity"), (F.lit(n_products) - F.coalesce("products_in_groups", F.lit(0))).cast("long").alias("singletons"))


def with_attributes(evolved: DataFrame, rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Further columns of the original rows on evolution rows, by member; those that the table lacks are left out."""
    have = [c for c in columns if c in rows.columns]
    taken = rows.select(F.col(f"`{row_id}`").alias("member_id"), *[F.col(f"`{c}`").alias(f"member_{c}" if c in evolved.columns else c) for c in have])
    return evolved.join(taken, "member_id", "left")


def recomputed(edge: DataFrame, scores: DataFrame, steps: list[int], min_group_size: int = 2, conservative: bool = True) -> DataFrame:
    """Groups found anew at each threshold; the mean is by groups. Thresholds without groups have zeros.

    scores: (group_key, src, dst, score) of the components at the lowest threshold. Groups at a higher one are parts of them, so
    nothing is scored again, and all thresholds are grouped in one run, over nodes that are pairs of threshold and row.
    """
    spark = edge.sparkSession
    every = F.explode(F.array(*map(F.lit, steps))).alias("threshold")
    at = lambda c: F.struct("threshold", F.col(c).alias("id"))
    edges = edge.select("src", "dst", "score", every).where("score >= threshold").select(at("src").alias("src"), at("dst").alias("dst"), "score")
    members = cut(G.find_groups(edges, 0.0, min_group_size))
    known = scores.select("src", "dst", "score", every).select(at("src").alias("src"), at("dst").alias("dst"), "score")
    inside = cut(G.scores_within(members, known))
    if conservative:
        flat = inside.select("group_key", F.col("src.id").alias("src"), F.col("dst.id").alias("dst"), "score", F.col("src.threshold").alias("threshold"))
        parts = G.conservative_split(members.select("group_key", F.col("member_id.id").alias("member_id")), flat)
        threshold = F.col("component.threshold")
        members = cut(parts.select(F.struct(threshold.alias("threshold"), F.col("group_key").alias("id")).alias("group_key"), F.struct(threshold.alias("threshold"), F.col("member_id").alias("id")).alias("member_id")))
        inside = G.scores_within(members, inside)
    stats = inside.groupBy("group_key").agg(F.avg("score").alias("avg_similarity"))
    sizes = members.groupBy("group_key").agg(F.count("*").alias("group_size")).where(F.col("group_size") >= min_group_size)
    found = sizes.join(stats, "group_key").groupBy(F.col("group_key.threshold").alias("threshold")).agg(
        F.count("*").alias("groups_found"), F.sum("group_size").alias("products_in_groups"), F.max("group_size").alias("largest_group_size"), F.avg("avg_similarity").alias("avg_group_similarity")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spark.createDataFrame([(t,) for t in steps], "threshold int").join(found, "threshold", "left").select(
        "threshold", zero("groups_found"), zero("products_in_groups"), zero("largest_group_size"), F.coalesce("avg_group_similarity", F.lit(0.0)).alias("avg_group_similarity")
    )


def at_threshold(evolved: DataFrame, threshold: int, in_group_only: bool = True) -> DataFrame:
    """The rows of one threshold."""
    out = evolved.where(F.col("threshold") == threshold)
    return out.where("in_group") if in_group_only else out
