"""Cleaning and typing.

The type decision is data-dependent (a column becomes numeric when at least
80 % of its non-blank values parse).  It is made from ONE wide aggregate
(two counts per column); only those counts reach the driver, the data stays
distributed and the projection is lazy.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.functions.exprs import try_num

# Fixed values that must equal the reference: the unit suffix pattern stripped
# before parsing (case-insensitive, one trailing unit).
UNIT_PATTERN = r"\s*(ft\.?|sqft|sq\.?\s*ft\.?|m2?|km|kg|lb|lbs|%|acres?|ha)\s*$"

# Internal tag columns and hidden/PII column names and name parts.
INTERNAL_COLS = {"_source", "_file_type", "_sample_weight"}
ALWAYS_HIDE_COLS = {
    "_source", "_file_type", "_sample_weight",
    "listing_id", "real_mls",
    "street", "address", "postal_code", "zip_code",
    "listing_agent", "listing_agent_phone", "listing_agent_brokerage",
    "selling_agent", "selling_agent_brokerage", "selling_agent_phone",
    "summary_url", "virtual_tour", "photo_count", "photos",
    "description", "strata_details", "lot_dimensions",
    "sold_date", "listing_date", "province", "province_code",
    "exposure", "construction_materials", "foundation",
    "ownership",
}
HIDDEN_NAME_PARTS = [
    "agent", "brokerage", "phone", "email", "url", "link", "description",
    "lot_dimension", "photo", "strata_detail", "province",
    "sold_date", "listing_date", "postal", "zip", "address", "street",
]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_text(c: str | Column, thousands: bool = False) -> Column:
    """C1 parse of one text value: trim, strip one unit, ',' -> '.', drop spaces.

    With ``thousands=True`` commas are treated as thousands separators instead
    (so '1,250,000' parses; the reference turns it into an unparseable '1.250.000').
    """
    s = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    s = F.regexp_replace(s, "(?i)" + UNIT_PATTERN, "")
    s = F.regexp_replace(s, ",", "" if thousands else ".")
    s = F.regexp_replace(s, " ", "")
    return try_num(s)


def coerce_numeric(c: str | Column) -> Column:
    """To number, anything unparseable -> NULL (never raises under ANSI)."""
    return try_num(F.col(c) if isinstance(c, str) else c)


def _non_blank(c: str) -> Column:
    s = F.trim(F.col(c).cast("string"))
    return F.col(c).isNotNull() & ~s.isin("", "nan")


def numeric_decisions(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8, thousands: bool = False) -> dict[str, bool]:
    """One aggregate: per string column, does it parse often enough to become numeric?"""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if columns is None else list(columns)
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(F.when(_non_blank(c), 1)).alias(f"n{i}"))
        aggs.append(F.count(numeric_text(c, thousands)).alias(f"p{i}"))
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        nn, parsed = r[f"n{i}"], r[f"p{i}"]
        out[c] = bool(nn > 0 and parsed / nn >= threshold)
    return out


def clean_numeric(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8, thousands: bool = False) -> DataFrame:
    """Convert each string column to DOUBLE iff >= threshold of its non-blank values parse."""
    decisions = numeric_decisions(df, columns, threshold, thousands)
    return df.select(*[numeric_text(f.name, thousands).alias(f.name) if decisions.get(f.name) else F.col(f.name) for f in df.schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on floating columns (corr/avg then skip them like pandas does)."""
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def is_hidden_col(name: str) -> bool:
    """hidden/PII/internal column by exact name or name part."""
    low = name.lower()
    return name in ALWAYS_HIDE_COLS or any(x in low for x in HIDDEN_NAME_PARTS)


def visible_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not is_hidden_col(c)]


def project_visible(df: DataFrame) -> DataFrame:
    """Drop hidden columns (names come from the schema; data stays lazy)."""
    return df.select(*visible_columns(df))


def numeric_columns(df: DataFrame) -> list[str]:
    """C4: numeric, visible, non-internal columns in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in INTERNAL_COLS and not is_hidden_col(f.name)]


def categorical_columns(df: DataFrame) -> list[str]:
    """C4: non-numeric, visible, non-internal columns in schema order."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, NUMERIC_TYPES) and f.name not in INTERNAL_COLS and not is_hidden_col(f.name)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    cols = set(df.columns)
    return [n for n in names if n in cols]
