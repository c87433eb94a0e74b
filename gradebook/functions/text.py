"""Scalar text helpers as built-in Column expressions (JVM-side, whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer options and the two "no usable answer" labels of the answer sheets.
OPTIONS = ("A", "B", "C", "D", "E")
HALL_NONE = ("HALL", "NONE")
CATEGORY_MULTI = "MULTI"
CATEGORY_HALL_NONE = "HALL / NONE"


def normalize_response(c: Column) -> Column:
    """Upper-case and trim a sheet cell; empty string becomes NULL."""
    # cells that are a label as it should be are left as they are; of the others the text is made once (a CASE would make it again)
    return F.when(c.isin(*OPTIONS, *HALL_NONE), c).otherwise(F.nullif(F.upper(F.trim(c)), F.lit("")))


def response_category(r: Column) -> Column:
    """MULTI for multi-select (contains '-'), 'HALL / NONE' for those labels, else the label."""
    return (F.when(r.isNull(), F.lit(None))
            .when(r.contains("-"), F.lit(CATEGORY_MULTI))
            .when(r.isin(*HALL_NONE), F.lit(CATEGORY_HALL_NONE))
            .otherwise(r))


def valid_option(r: Column, options=OPTIONS) -> Column:
    """Keep the label only if it is one of the options, else NULL."""
    return F.when(r.isin(*options), r)


def safe_name(c: Column) -> Column:
    """File-safe label: spaces, slashes and dots become underscores; parentheses dropped."""
    return F.translate(F.regexp_replace(c, r"[ /.]", "_"), "()", "")


def three_decimals(c: Column) -> Column:
    """A number with three decimals, rounded from the number itself: 0.0375, which lies just below, gives 0.037.
    (``format_string`` rounds the shortest decimal that stands for it; ``format_number`` does so below 0.001 only.)"""
    tiny = F.concat(F.when(c < 0, "-").otherwise(""), F.when(F.abs(c) >= 0.0005, "0.001").otherwise("0.000"))
    return F.when(F.abs(c) < 0.001, tiny).otherwise(F.replace(F.format_number(c, 3), F.lit(","), F.lit("")))


def format_ci(est: Column, lo: Column, hi: Column) -> Column:
    """``k [lo, hi]``; NULL where one of them is."""
    return F.concat(three_decimals(est), F.lit(" ["), three_decimals(lo), F.lit(", "), three_decimals(hi), F.lit("]"))
