"""Barcodes (GTIN): check digits, variants for matching and quality, as column expressions.

By default 13-digit codes have no check digit and cases no unit, as in the system that results are compared
with; gtin13=True applies the standard rule to both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidences of a pair by how its codes were derived.
EXACT, CORRECTED, CASE_UNIT = 120.0, 92.0, 90.0
_POOL = "array<struct<gtin14:string,source:string>>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once; plain nesting would repeat the value's expression at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")


def with_check_digit(base: Column, gtin13: bool = False) -> Column:
    """The digits of `base` with a check digit, or empty if their number fits no code."""
    lengths = (7, 11, 12, 13) if gtin13 else (7, 11, 13)
    return _let(digits(base), lambda code: F.when(F.length(code).isin(*lengths), F.concat(code, _check_digit(code))).otherwise(F.lit("")))


def _check_digit(code: Column) -> Column:
    """The digit that makes the weighted sum from the right, 3 1 3 1 ..., a multiple of ten."""
    weighted = F.transform(F.split(F.reverse(code), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1))
    return F.pmod(-F.aggregate(weighted, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def corrected(code: Column, gtin13: bool = False) -> Column:
    """A complete code with its last digit replaced by the check digit, or empty."""
    last_off = lambda c: with_check_digit(F.substring(c, F.lit(1), F.length(c) - 1), gtin13)
    return _let(digits(code), lambda c: F.when(F.length(c).isin(8, 12, 13, 14), last_off(c)).otherwise(F.lit("")))


def is_valid(code: Column, gtin13: bool = False) -> Column:
    return _let(digits(code), lambda c: F.length(c).isin(8, 12, 13, 14) & (corrected(c, gtin13) == c))


def unit_of_case(code: Column, gtin13: bool = False) -> Column:
    """The code of the unit inside a 14-digit case, or empty."""
    return _let(digits(code), lambda c: F.when(F.length(c) == 14, with_check_digit(F.substring(c, 2, 12), gtin13)).otherwise(F.lit("")))


def _entry(code: Column, source: str) -> Column:
    return F.struct(F.lpad(code, 14, "0").alias("gtin14"), F.lit(source).alias("source"))


def variants(value: Column, gtin13: bool = False, alt_padding: bool = True) -> Column:
    """All 14-digit forms under which a code may be found, each with its source; empty for no code or over 14 digits."""
    return _let(digits(value), lambda code: _variants(code, gtin13, alt_padding))


def _variants(code: Column, gtin13: bool, alt_padding: bool) -> Column:
    n = F.length(code)
    none = F.lit(None).cast("struct<gtin14:string,source:string>")
    entry_if = lambda value, test, source: _let(value, lambda v: F.when(test(v), _entry(v, source)).otherwise(none))
    steps = [
        F.when(n <= 14, _entry(code, "original")).otherwise(none),
        entry_if(corrected(code, gtin13), lambda v: (v != "") & (v != code), "corrected"),
        entry_if(with_check_digit(code, gtin13), lambda v: n.isin(*((7, 11, 12) if gtin13 else (7, 11))) & (v != ""), "missing_check"),
    ]
    if gtin13:
        steps.append(entry_if(unit_of_case(code, True), lambda v: v != "", "case_to_unit"))
    pool = F.filter(F.array(*steps), lambda x: x.isNotNull())
    if alt_padding:
        shifts = F.when(n < 14, F.sequence(F.lit(0), F.lit(13) - n)).otherwise(F.array().cast("array<int>"))
        padded = F.transform(shifts, lambda i: F.rpad(F.concat(F.repeat(F.lit("0"), i), code), 14, "0"))
        pool = _let(pool, lambda p: F.concat(p, F.transform(F.array_except(padded, F.transform(p, lambda x: x["gtin14"])), lambda g: F.struct(g.alias("gtin14"), F.lit("original").alias("source")))))
    fits = F.filter(pool, lambda x: F.length(x["gtin14"]) == 14)
    return F.when((n > 0) & (n <= 14), _last_wins(fits)).otherwise(F.array().cast(_POOL))


def _last_wins(pool: Column) -> Column:
    def kept(p: Column) -> Column:
        keys = F.transform(p, lambda x: x["gtin14"])
        return F.filter(p, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0))), x["gtin14"]))

    return _let(pool, kept)


def pool(columns: Sequence[Column], gtin13: bool = False, alt_padding: bool = True) -> Column:
    """Variants of several code columns; where a form repeats, the last column's source holds."""
    if not columns:
        return F.array().cast(_POOL)
    return _last_wins(F.flatten(F.array(*[variants(c, gtin13, alt_padding) for c in columns])))


def pair_confidence(a: Column, b: Column) -> Column:
    """Confidence of two sources that share a form."""
    both = lambda s: (a == s) | (b == s)
    return (
        F.when((a == "original") & (b == "original"), F.lit(EXACT))
        .when(both("corrected"), F.lit(CORRECTED))
        .when(both("case_to_unit"), F.lit(CASE_UNIT))
        .when(both("missing_check"), F.lit(CORRECTED))
        .otherwise(F.lit(EXACT))
    )


def match_type(confidence: Column) -> Column:
    return F.when(confidence == EXACT, "Exact Match").when(confidence == CORRECTED, "Corrected Match").when(confidence == CASE_UNIT, "Case/Unit Match")


def quality(value: Column, gtin13: bool = False) -> Column:
    """valid, correctable or invalid for a value with a digit, else null."""
    def mark(code: Column) -> Column:
        n = F.length(code)
        return (
            F.when(n == 0, F.lit(None).cast("string"))
            .when(~n.isin(7, 8, 11, 12, 13, 14), "invalid")
            .when(n.isin(7, 11), "correctable")
            .when(is_valid(code, gtin13), "valid")
            .when(corrected(code, gtin13) != "", "correctable")
            .otherwise("invalid")
        )

    return _let(digits(value), mark)
