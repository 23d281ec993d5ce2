"""Roles of columns from their names and values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of columns that hold product names.
NAMES = {"product_name", "description", "short_name", "long_name", "name", "title", "product", "print name", "item name"}
#: Words that mark a barcode column, and words that rule one out.
CODE_WORDS = ("gtin", "upc", "ean", "barcode", "bar_code", "product_code", "item_code", "sku", "code", "id")
NOT_CODES = ("type", "description", "name", "category")
#: Names of columns that hold a category.
CATEGORIES = {
    "category", "commodity", "department", "type", "class", "group", "segment", "division", "section", "line", "family", "brand", "supplier",
    "vendor", "product_type", "product_category", "item_type", "item_category", "category_name", "commodity_code", "dept", "dept_name",
}


def name_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in NAMES]


def restriction_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_distinct, n_rows, by_name, by_values) of every string column, in one pass over the table.

    A column fits by values with 2 to 50 distinct values that are fewer than half the rows; nulls do not count.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    spark = df.sparkSession
    if not texts:
        return spark.createDataFrame([], "column_name string, n_distinct long, n_rows long, by_name boolean, by_values boolean")
    counted = df.agg(F.count("*").alias("n"), *[F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(texts)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("n_distinct"), F.lit(c.lower() in CATEGORIES).alias("by_name")) for i, c in enumerate(texts)]))
    fits = F.col("r.n_distinct").between(2, 50) & (F.col("r.n_distinct") < 0.5 * F.col("n"))
    return counted.select("n", rows.alias("r")).select("r.column_name", "r.n_distinct", F.col("n").alias("n_rows"), "r.by_name", fits.alias("by_values"))


def restriction_columns(df: DataFrame) -> list[str]:
    found = {r["column_name"] for r in restriction_profile(df).where("by_name or by_values").collect()}
    return [c for c in df.columns if c in found]


def gtin_columns(df: DataFrame, order_by: str | None = None) -> list[str]:
    """Columns named like barcodes of whose first ten values at least half have seven digits or more; one job reads them all."""
    named = [c for c in df.columns if any(re.search(w, c.lower()) for w in CODE_WORDS) and not any(w in c.lower() for w in NOT_CODES)]
    every = None
    for c in named:
        some = df.where(F.col(f"`{c}`").isNotNull())
        some = (some.orderBy(order_by) if order_by else some).select(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")).limit(10)
        every = some if every is None else every.unionByName(some)
    values: dict[str, list[str]] = {c: [] for c in named}
    for r in every.collect() if every is not None else []:
        values[r["c"]].append(r["v"])
    return [c for c in named if values[c] and sum(len(re.sub(r"\D", "", v)) >= 7 for v in values[c]) * 2 >= len(values[c])]
