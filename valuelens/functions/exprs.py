"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_or_lit",
    "clip",
    "try_num",
    "plain_number",
    "safe_div",
    "text_flag",
    "contains_ci",
    "first_int",
    "tokens",
    "null_if_blank",
    "round_even",
    "rnd",
    "sql_rnd",
]

# A plain decimal literal: optional sign, digits with optional fraction, optional exponent.
# Guards try_cast against Java suffix literals such as '1d', '2f' and words like 'nan'.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def clip(c, lo=None, hi=None) -> Column:
    """Null-safe clip (Spark's least/greatest skip nulls, so guard explicitly)."""
    c = col_or_lit(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def plain_number(s: Column) -> Column:
    return s.rlike(PLAIN_NUMBER)


def try_num(c) -> Column:
    """Coerce to double; anything that is not a plain number becomes NULL."""
    s = F.trim(col_or_lit(c).cast("string"))
    return F.when(plain_number(s), s.try_cast("double"))


def safe_div(a, b) -> Column:
    """Division where a zero denominator gives NULL (ANSI would raise)."""
    return F.try_divide(col_or_lit(a), F.nullif(col_or_lit(b), F.lit(0.0)))


def null_if_blank(c) -> Column:
    c = col_or_lit(c)
    return F.when(F.length(F.trim(c)) > 0, c)


def text_flag(c) -> Column:
    """1.0 if the trimmed text is longer than 2 characters, else 0.0 (null text -> 0)."""
    return (F.length(F.trim(F.coalesce(col_or_lit(c).cast("string"), F.lit("")))) > 2).cast("double")


def contains_ci(c, word: str) -> Column:
    """1.0 if the text contains ``word`` in any case, null text -> 0.0."""
    return F.coalesce(F.lower(col_or_lit(c).cast("string")).contains(word.lower()), F.lit(False)).cast("double")


def first_int(c, pattern: str) -> Column:
    """First capture group of ``pattern`` as double, NULL when it does not match."""
    s = F.regexp_extract(F.coalesce(col_or_lit(c).cast("string"), F.lit("")), pattern, 1)
    return F.when(s != "", s.cast("double"))


def tokens(c, delimiter: str = ",") -> Column:
    """Split on a literal delimiter and trim every token (Spark's split takes a regex)."""
    import re

    return F.transform(F.split(F.coalesce(col_or_lit(c).cast("string"), F.lit("")), re.escape(delimiter)), lambda t: F.trim(t))


def round_even(c, scale: int = 0) -> Column:
    return F.bround(col_or_lit(c), scale)


def rnd(c, digits: int = 0, even: bool = False) -> Column:
    """Round to ``digits`` decimals by scaling, rounding to an integer and unscaling.

    Scaling first makes ties behave the same on every engine that does IEEE
    arithmetic (the SQL twin is ``sql_rnd``); ``even`` rounds ties to even as
    Python's ``round`` does, otherwise ties go away from zero.
    """
    c = col_or_lit(c)
    f = F.bround if even else F.round
    if digits == 0:
        return f(c, 0)
    scale = float(10 ** digits)
    return f(c * scale, 0) / scale


def sql_rnd(expr: str, digits: int = 0, even: bool = False) -> str:
    """DuckDB twin of :func:`rnd`."""
    fn = "round_even" if even else "round"
    if digits == 0:
        return f"{fn}(({expr}), 0)"
    scale = float(10 ** digits)
    return f"({fn}(({expr}) * {scale}, 0) / {scale})"
