"""From a raw table to the columns that matching reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gtin, sizes, text
from ..plans.settings import ColumnConfig, MatchSettings
from .numbering import numbered


def with_row_id(df: DataFrame, order_by: list[str], row_id: str = "row_id") -> DataFrame:
    """Numbers rows from 0 by the given columns, which must order them uniquely for stable numbers. For tables without a key of their own."""
    return numbered(df, list(order_by), row_id).withColumn(row_id, F.col(row_id) - 1)


def prepare(df: DataFrame, config: ColumnConfig, settings: MatchSettings = MatchSettings(), output: bool = False) -> DataFrame:
    """row_id, name, size_text, size_base, gtin_pool and one _keep_ column for each restriction, lower-cased with null empty.

    output: also the further output columns that the table has, in _more.
    """
    more = [F.col(f"`{c}`") for c in dict.fromkeys(config.output) if output and c in df.columns]
    product = [c for c in config.product if c in df.columns]
    name = text.combine([text.clean(F.col(f"`{c}`"), settings.remove_stop_words, settings.case_sensitive) for c in product])
    if config.size_value and config.size_value in df.columns:
        unit = F.col(f"`{config.size_unit}`") if config.size_unit else F.lit("")
        size = sizes.compose(F.col(f"`{config.size_value}`"), unit)
    else:
        size = F.col(f"`{config.size}`") if config.size and config.size in df.columns else F.lit(None).cast("string")
    standard = sizes.standardise(size)
    if settings.include_size_in_text:
        name = F.trim(F.concat_ws(" ", name, standard))
    return df.select(
        F.col(f"`{config.row_id}`").alias("row_id"),
        name.alias("name"),
        standard.alias("size_text"),
        sizes.base_amount(size).alias("size_base"),
        gtin.pool([F.col(f"`{c}`") for c in config.gtin if c in df.columns], settings.gtin13, settings.alt_padding).alias("gtin_pool"),
        *[F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"_keep_{i}") for i, c in enumerate(settings.restrictions)],
        *([F.struct(*more).alias("_more")] if more else []),
    )
