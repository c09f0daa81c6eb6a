"""Scalar rules of the text table, as Column expressions that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a cell may say for "missing", after stripping.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity)$"


def stripped(c: Column) -> Column:
    """Without white space at either end (tabs and line ends too)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+", ""), r"\s+$", "")


def is_missing(c: Column) -> Column:
    return stripped(c).isin(*MISSING)


def is_number(c: Column) -> Column:
    """Whether the text reads as a number; type suffixes that a SQL cast would take (1d, 1f) do not."""
    t = stripped(c)
    return t.rlike(NUMBER) | t.rlike(SPECIAL)


def number(c: Column) -> Column:
    """The number that the text reads as, NULL if missing or no number; infinities stay."""
    t = stripped(c)
    special = F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.rlike(SPECIAL), special)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities: observed means finite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def name_template(c: Column) -> Column:
    """The name with each run of digits as #."""
    return F.regexp_replace(c, r"[0-9]+", "#")


def shape(c: Column) -> Column:
    """Letters as A, digits as 9, at most 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(stripped(c), r"[A-Za-z]", "A"), r"[0-9]", "9"), 1, 40)


def significant(c: Column, digits: int = 4) -> Column:
    """Rounded to so many significant digits; 0 and NULL as they are."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c.isNull() | (c == 0), c).otherwise(F.round(c * scale) / scale)


def split_first(c: Column, delimiter: str) -> tuple[Column, Column]:
    """(left, right) at the first delimiter; NULL where it is absent or at an edge."""
    at = F.instr(c, F.lit(delimiter))
    good = (at > 1) & (at + len(delimiter) <= F.length(c))
    return F.when(good, F.substring(c, F.lit(1), at - 1)), F.when(good, F.substring(c, at + len(delimiter), F.length(c)))


def split_last(c: Column, delimiter: str) -> tuple[Column, Column]:
    """(left, right) at the last delimiter; NULL where it is absent or at an edge."""
    right = F.substring_index(c, delimiter, -1)
    left_size = F.length(c) - F.length(right) - len(delimiter)
    good = (left_size >= 1) & (F.length(right) >= 1)
    return F.when(good, F.substring(c, F.lit(1), left_size)), F.when(good, right)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [..]) as an anchored regular expression, case-sensitive."""
    import fnmatch

    return "^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"


def matches_glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_to_regex(pattern))


def label_number(c: Column) -> Column:
    """The number in a time label: what is left of digits, points and minus signs, if it reads as one."""
    return number(F.regexp_replace(c, r"[^0-9.\-]", ""))


def log_base(c: Column, base: float | str, offset: Column | float = 0.0) -> Column:
    """log of c + offset; NULL where that is not positive, never an infinity. base: 2, 10 or "e"."""
    x = c + offset
    log = F.log2(x) if base == 2 else F.log10(x) if base == 10 else F.ln(x)
    return F.when(x > 0, log)


def unlog(c: Column, base: float | str, offset: float = 0.0) -> Column:
    return F.pow(F.lit(math.e if base == "e" else float(base)), c) - offset


def arcsinh(c: Column, cofactor: float) -> Column:
    return F.asinh(c / cofactor)


def logistic(c: Column) -> Column:
    """1 / (1 + exp(-c)), without overflow at either side."""
    return F.when(c >= 0, 1 / (1 + F.exp(-F.abs(c)))).otherwise(F.exp(-F.abs(c)) / (1 + F.exp(-F.abs(c))))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def natural_key(c: Column) -> Column:
    """A sort key: labels with a number first, by number, then the others by text."""
    v = label_number(c)
    return F.struct(v.isNull().alias("no_number"), F.coalesce(v, F.lit(0.0)).alias("number"), c.alias("label"))
