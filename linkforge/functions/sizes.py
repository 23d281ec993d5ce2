"""Package sizes: composing, standardising and comparing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import UNITS


def compose(value: Column, unit: Column) -> Column:
    """'{number} {unit}', empty where the value is no number; a missing unit is empty."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNotNull(), F.concat_ws(" ", number.cast("string"), F.coalesce(unit.cast("string"), F.lit("")))).otherwise(F.lit(""))


def base_amount(size: Column) -> Column:
    """Grams or millilitres to one decimal, or null. Units are tried in a fixed order; the first that occurs wins."""
    text = F.lower(F.coalesce(size.cast("string"), F.lit("")))
    tried = []
    for unit, factor in UNITS:
        number = F.regexp_extract(text, rf"(\d*\.?\d+)\s*({unit})\b", 1)
        tried.append(F.when(number != "", F.round(number.try_cast("double") * F.lit(factor), 1)))
    return F.coalesce(*tried)


def standardise(size: Column) -> Column:
    """'340.2g' for '12 oz'; empty where no unit is found."""
    amount = base_amount(size)
    return F.when(amount.isNull(), F.lit("")).otherwise(F.concat(F.format_string("%.1f", amount), F.lit("g")))


def similarity(a: Column, b: Column, tolerance: float = 20.0) -> Column:
    """0 to 100 by relative difference: 100 for equal amounts, 0 from `tolerance` percent of the larger one on.

    0 where either is missing; where either is zero, 100 if both are.
    """
    larger, smaller = F.greatest(a, b), F.least(a, b)
    apart = (larger - smaller) * 100.0 / larger
    close = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1.0 - apart / F.lit(float(tolerance))) * 100.0))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(0.0))
        .when((a == 0) | (b == 0), F.when(a == b, F.lit(100.0)).otherwise(F.lit(0.0)))
        .when(apart <= F.lit(float(tolerance)), close)
        .otherwise(F.lit(0.0))
    )
