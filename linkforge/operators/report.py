"""Summaries of results and of barcode quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gtin


def match_summary(pairs: DataFrame) -> DataFrame:
    """Number of pairs, mean confidence, unordered distinct name pairs, rows with a match, and that figure as twice the pairs."""
    names = F.array_sort(F.array("left_name", "right_name"))
    return pairs.agg(
        F.count("*").alias("n_matches"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.countDistinct(names).alias("distinct_pairs"), F.countDistinct("left_id").alias("rows_with_matches")
    ).withColumn("pairs_times_two", F.col("distinct_pairs") * 2)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs of names, once each, with their best confidence."""
    return pairs.groupBy(F.least("left_name", "right_name").alias("name_a"), F.greatest("left_name", "right_name").alias("name_b")).agg(F.max("confidence").alias("confidence"))


def group_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("n_products"), F.max("group_size").alias("largest"), F.min("group_size").alias("smallest"))


def gtin_quality(df: DataFrame, columns: Sequence[str], gtin13: bool = False) -> DataFrame:
    """One row: total_products, products_with_gtins, valid_gtins, correctable_gtins, invalid_gtins, coverage_percentage."""
    marks = F.array(*[gtin.quality(F.col(f"`{c}`"), gtin13) for c in columns]) if columns else F.array().cast("array<string>")
    rows = df.select(F.filter(marks, lambda m: m.isNotNull()).alias("m"))
    count = lambda kind: F.coalesce(F.sum(F.size(F.filter("m", lambda x: x == kind))), F.lit(0)).cast("long").alias(f"{kind}_gtins")
    out = rows.agg(F.count("*").alias("total_products"), F.count_if(F.size("m") > 0).alias("products_with_gtins"), *map(count, ("valid", "correctable", "invalid")))
    return out.withColumn("coverage_percentage", F.coalesce(F.try_divide(F.col("products_with_gtins") * 100.0, F.col("total_products")), F.lit(0.0)))
