"""Derived listing features D1-D22: one projection, whole-stage codegen friendly.

Each feature is added only when its inputs exist and the output does not.
Every clip is null-safe and every division turns a zero denominator into NULL.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuelens.functions.exprs import clip, contains_ci, first_int, safe_div, text_flag, try_num
from valuelens.operators.clean import is_numeric

# Fixed values from the reference: distance centre (lat, lon) and km per degree.
CENTRE_LAT, CENTRE_LON, KM_PER_DEGREE = 49.2827, -123.1207, 111.0

# Fixed values: (flag column, source text column) in priority order.
TEXT_FLAGS = [
    ("has_view", "view"), ("has_fireplace", "fireplace_features"), ("has_fireplace", "fireplace"),
    ("has_cooling", "cooling_features"), ("has_parking_feat", "parking_features"),
    ("has_appliances", "appliances"), ("has_interior", "interior_features"),
]


def derived_feature_exprs(df: DataFrame, ref_year: int | None = None, centre: tuple[float, float] = (CENTRE_LAT, CENTRE_LON)) -> list[tuple[str, Column]]:
    """(name, expression) for every derived feature computable from ``columns``."""
    have = set(df.columns)

    def _num(c: str) -> Column:
        # numeric columns are used as they are; text goes through the C2 coercion
        return F.col(c).cast("double") if is_numeric(df, c) else try_num(F.col(c))

    out: list[tuple[str, Column]] = []
    made: set[str] = set()

    def add(name: str, expr: Column, *needs: str) -> None:
        if all(n in have for n in needs) and name not in have and name not in made:
            out.append((name, expr))
            made.add(name)

    year = ref_year if ref_year is not None else _dt.date.today().year
    add("age", clip(F.lit(float(year)) - _num("year_built"), 0, 200) if "year_built" in have else None, "year_built")
    if "floor_area_sqft" in have:
        fa = _num("floor_area_sqft")
        add("lot_ratio", clip(safe_div(_num("lot_size_sqft") if "lot_size_sqft" in have else F.lit(None), fa), 0, 100), "lot_size_sqft")
        add("room_density", clip(safe_div(_num("rooms") if "rooms" in have else F.lit(None), fa) * 100, 0, 10), "rooms")
    if "rooms" in have and "bathrooms" in have:
        add("bath_ratio", clip(safe_div(_num("bathrooms"), _num("rooms")), 0, 2), "bathrooms", "rooms")
    if "parking_spaces" in have:
        ps = F.coalesce(F.col("parking_spaces").cast("string"), F.lit(""))
        add("n_parking_spaces", clip(F.coalesce(first_int(ps, r"Total spaces:\s*(\d+)"), first_int(ps, r"(\d+)")), 0, 20), "parking_spaces")
        add("n_covered_parking", clip(F.coalesce(first_int(ps, r"\((\d+)\s*covered\)"), F.lit(0.0)), 0, 20), "parking_spaces")
        add("has_garage", contains_ci(ps, "garage"), "parking_spaces")
        add("has_rv_parking", contains_ci(ps, "rv"), "parking_spaces")
    if "fireplace" in have and "n_fireplaces" not in have:
        fp = F.coalesce(F.col("fireplace").cast("string"), F.lit(""))
        add("n_fireplaces", clip(F.coalesce(first_int(fp, r"^(\d+)"), (F.length(fp) > 2).cast("double")), 0, 5), "fireplace")
        add("has_gas_fireplace", contains_ci(fp, "gas"), "fireplace")
    if "levels" in have:
        add("n_levels", clip(_num("levels"), 1, 5), "levels")
    if "floor_area_sqft" in have and "price" in have:
        add("ppsf", clip(safe_div(_num("price"), _num("floor_area_sqft")), 50, 10000), "price", "floor_area_sqft")
    if "days_on_market" in have:
        add("log_dom", F.log1p(clip(_num("days_on_market"), 0, 365)), "days_on_market")
    if "latitude" in have and "longitude" in have:
        d = F.sqrt(F.pow(_num("latitude") - centre[0], 2) + F.pow(_num("longitude") - centre[1], 2)) * KM_PER_DEGREE
        add("dist_van_centre", clip(d, 0, 200), "latitude", "longitude")
    for name, src in TEXT_FLAGS:
        if src in have:
            add(name, text_flag(src), src)
    if "maintenance_fee" in have:
        add("has_strata", F.coalesce(_num("maintenance_fee") > 0, F.lit(False)).cast("double"), "maintenance_fee")
    if "sold_price" in have and "price" in have:
        add("price_discount_pct", clip(safe_div(_num("sold_price") - _num("price"), _num("price")) * 100, -30, 30), "sold_price", "price")
    return out


def add_derived_features(df: DataFrame, ref_year: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Append D1-D22 (those whose inputs exist) in one projection."""
    exprs = derived_feature_exprs(df, ref_year)
    if only is not None:
        exprs = [(n, e) for n, e in exprs if n in only]
    return df.select("*", *[e.alias(n) for n, e in exprs])
