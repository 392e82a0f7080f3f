"""Queries for cleaning (C1-C4), profiling (C5-C14), derived features (D) and filters (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.functions.exprs import PLAIN_NUMBER, sql_rnd
from valuelens.operators import clean as C
from valuelens.operators import filters as FL
from valuelens.operators import profile as P
from valuelens.operators.features import add_derived_features
from valuelens.plans.listing import KEYS, LISTING_SQL, listing_view, table
from valuelens.plans.registry import query

REF_YEAR = 2025
K = ", ".join(KEYS)


def with_listing(body: str, *ctes: str) -> str:
    extra = "".join(f", {c}" for c in ctes)
    return f"WITH listing AS ({LISTING_SQL}){extra} {body}"


def sql_clip(x: str, lo, hi) -> str:
    inner = f"({x})"
    if lo is not None:
        inner = f"greatest({inner}, CAST({lo} AS DOUBLE))"
    if hi is not None:
        inner = f"least({inner}, CAST({hi} AS DOUBLE))"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {inner} END"


def sql_div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def sql_try_num(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{PLAIN_NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


# ------------------------------------------------------------------ C1 C2
_RAW_COLS = {
    "size_txt": "CAST(p_size AS STRING) || ' sqft'",
    "price_txt": "replace(CAST(p_retailprice AS STRING), '.', ',')",
    "mixed80": "CASE WHEN p_partkey % 10 < 8 THEN CAST(p_size AS STRING) || ' FT' ELSE 'n/a' END",
    "mixed70": "CASE WHEN p_partkey % 10 < 7 THEN CAST(p_size AS STRING) || ' %' ELSE 'unknown' END",
    "acres_txt": "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST(p_size AS STRING) || ' Acres' END",
    "name_txt": "p_name",
}


def _raw_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in _RAW_COLS.items()])


def _clean_sql() -> str:
    cols = list(_RAW_COLS)
    unit = C.UNIT_PATTERN
    parsed = ", ".join(
        f"{c}, {sql_try_num(f'replace(replace(regexp_replace(trim({c}), {chr(39)}{unit}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}i{chr(39)}), {chr(39)},{chr(39)}, {chr(39)}.{chr(39)}), {chr(39)} {chr(39)}, {chr(39)}{chr(39)})')} AS {c}__num"
        for c in cols
    )
    dec = ", ".join(
        f"count(CASE WHEN {c} IS NOT NULL AND trim({c}) NOT IN ('', 'nan') THEN 1 END) AS {c}__nn, count({c}__num) AS {c}__p"
        for c in cols
    )
    outs = " UNION ALL ".join(
        f"SELECT p_partkey, '{c}' AS column_name, ({c}__nn > 0 AND {c}__p / {c}__nn >= 0.8) AS converted, "
        f"CASE WHEN {c}__nn > 0 AND {c}__p / {c}__nn >= 0.8 THEN {c}__num END AS num_value, "
        f"CASE WHEN {c}__nn > 0 AND {c}__p / {c}__nn >= 0.8 THEN NULL ELSE {c} END AS text_value FROM parsed CROSS JOIN dec"
        for c in cols
    )
    raw = ", ".join(f"{e} AS {n}" for n, e in _RAW_COLS.items())
    return (f"WITH raw AS (SELECT p_partkey, {raw} FROM part), parsed AS (SELECT p_partkey, {parsed} FROM raw), "
            f"dec AS (SELECT {dec} FROM parsed) {outs}")


@query("clean_numeric", "C1", _clean_sql())
def q_clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on text columns with units, decimal commas, blanks and words; long output."""
    raw = _raw_part(spark, sf_dir)
    decisions = C.numeric_decisions(raw, list(_RAW_COLS))
    cleaned = C.clean_numeric(raw, list(_RAW_COLS))
    parts = [
        F.struct(F.lit(c).alias("column_name"), F.lit(decisions[c]).alias("converted"),
                 (F.col(c) if decisions[c] else F.lit(None).cast("double")).alias("num_value"),
                 (F.lit(None).cast("string") if decisions[c] else F.col(c)).alias("text_value"))
        for c in _RAW_COLS
    ]
    return cleaned.select("p_partkey", F.explode(F.array(*parts)).alias("s")).select("p_partkey", "s.*")


_COERCE = {
    "size_d": "CAST(p_size AS STRING) || 'd'",
    "price_s": "CAST(p_retailprice AS STRING)",
    "name_s": "p_name",
    "nan_s": "CASE WHEN p_partkey % 2 = 0 THEN 'nan' ELSE ' 12.5 ' END",
}


@query("coerce_numeric", "C2", "SELECT p_partkey, " + ", ".join(f"{sql_try_num(e)} AS {n}" for n, e in _COERCE.items()) + " FROM part")
def q_coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Try-coercion; Java suffix literals ('5d') and 'nan' become NULL."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in _COERCE.items()])
    return p.select("p_partkey", *[C.coerce_numeric(n).alias(n) for n in _COERCE])


# ------------------------------------------------------------------ C3 C4 F12
def _visible_names() -> list[str]:
    from valuelens.plans.listing import listing_columns

    return [c for c in listing_columns() if not C.is_hidden_col(c)]


@query("visible_columns", "C3 C4", with_listing(f"SELECT {', '.join(_visible_names())} FROM listing"))
def q_visible_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hidden/internal columns (tags, street) are dropped from the listing view."""
    return C.project_visible(listing_view(spark, sf_dir))


_LEAK_FEATURES = ["price", "list_price", "floor_area_sqft", "ppsf", "district", "rooms", "price_discount_pct"]


def _leak_sql() -> str:
    kept, _ = FL.leakage_guard(_LEAK_FEATURES, "sold_price")
    return with_listing(f"SELECT {K}, {', '.join(kept)}, sold_price FROM listing")


@query("leakage_guard", "F12", _leak_sql())
def q_leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sold-price target drops price/list/asking/discount and ppsf (area selected)."""
    lv = add_derived_features(listing_view(spark, sf_dir), REF_YEAR, only=["ppsf", "price_discount_pct"])
    kept, _removed = FL.leakage_guard(_LEAK_FEATURES, "sold_price")
    return lv.select(*KEYS, *kept, "sold_price")


# ------------------------------------------------------------------ C5 C6 C12 F13 C11
def _profile_cols() -> list[str]:
    from valuelens.plans.listing import listing_columns

    return list(listing_columns())


def _null_sql(cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {sql_rnd(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 3)}::DOUBLE AS null_rate FROM listing" for c in cols
    )
    return with_listing(parts)


@query("null_rates", "C5", _null_sql(_profile_cols()))
def q_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.null_rates(listing_view(spark, sf_dir), digits=3)


_CAT = ["city", "district", "property_type", "view", "fireplace", "parking_spaces", "cooling_features",
        "appliances", "parking_features", "interior_features", "l_linestatus", "o_orderpriority", "c_mktsegment"]


def _distinct_sql(cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 200 AS listed_as_categorical FROM listing"
        for c in cols
    )
    return with_listing(parts)


@query("distinct_counts", "C6 C12", _distinct_sql(_CAT))
def q_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = listing_view(spark, sf_dir)
    return P.distinct_counts(lv, C.categorical_columns(lv))


def _candidate_sql(cols: list[str], target: str) -> str:
    skip = FL.CANDIDATE_SKIP + [target]
    parts = []
    for c in cols:
        bad = c in skip or any(p in c.lower() for p in FL.CANDIDATE_SKIP_PARTS)
        rate = f"avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE"
        parts.append(f"SELECT '{c}' AS column_name, {sql_rnd(rate, 4)} AS non_null_rate, "
                     f"{'false' if bad else 'true'} AND {rate} > 0.3 AS selected FROM listing")
    return with_listing(" UNION ALL ".join(parts))


@query("candidate_features", "F13", _candidate_sql(_profile_cols(), "price"))
def q_candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.candidate_features(listing_view(spark, sf_dir), "price")


def _profile_sql(cols: list[str], numeric: set[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i}::INTEGER AS position, '{'numeric' if c in numeric else 'categorical'}' AS kind, "
        f"{sql_rnd(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 3)}::DOUBLE AS null_rate, "
        f"{'NULL::BIGINT' if c in numeric else f'count(DISTINCT CAST({c} AS VARCHAR))'} AS n_distinct FROM listing"
        for i, c in enumerate(cols)
    )
    return with_listing(f"SELECT p.*, (SELECT count(*) FROM listing) AS n_rows FROM ({parts}) p")


_NUMERIC_LISTING = {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "_sample_weight", "price", "sold_price", "list_price",
                    "floor_area_sqft", "lot_size_sqft", "rooms", "bedrooms", "bathrooms", "year_built", "maintenance_fee",
                    "days_on_market", "levels", "latitude", "longitude"}


@query("dataset_profile", "C11", _profile_sql(_profile_cols(), _NUMERIC_LISTING))
def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: per column kind, null rate, distinct count, plus the row count."""
    return P.dataset_profile(listing_view(spark, sf_dir))


# ------------------------------------------------------------------ C7 C8 C9 C10 O6
_FV_COLS = [c for c in _CAT if not any(s in c.lower() for s in P.FILTER_SKIP_PARTS)]


def _fv_sql(split: bool) -> str:
    cols = _FV_COLS if split else [c for c in _CAT if c not in P.FILTER_SKIP_EXACT]
    if split:
        long = " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, trim(tok) AS value FROM (SELECT unnest(string_split(coalesce(CAST({c} AS VARCHAR), ''), ',')) AS tok FROM listing)"
            for c in cols
        )
        dist = "SELECT DISTINCT column_name, value FROM long WHERE lower(value) NOT IN ('nan', 'unknown', '')"
        lim = "CASE WHEN column_name IN ('district', 'city') THEN 120 ELSE 50 END"
    else:
        long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM listing WHERE {c} IS NOT NULL" for c in cols)
        dist = "SELECT DISTINCT column_name, value FROM long"
        lim = "50"
    body = (f"SELECT column_name, n_values, string_agg(value, '|' ORDER BY value) AS filter_values FROM d JOIN s USING (column_name) "
            f"GROUP BY column_name, n_values")
    return with_listing(body, f"long AS ({long})", f"d AS ({dist})",
                        f"s AS (SELECT column_name, count(*) AS n_values FROM d GROUP BY column_name HAVING count(*) BETWEEN 2 AND {lim})")


@query("filter_values", "C7", _fv_sql(True))
def q_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma tokens per categorical column, 2..50 values (120 for city/district)."""
    lv = listing_view(spark, sf_dir)
    return P.filter_values(lv, C.categorical_columns(lv), split=True)


@query("filter_values_cells", "C8", _fv_sql(False))
def q_filter_values_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-cell values, 2..50 per column."""
    lv = listing_view(spark, sf_dir)
    return P.filter_values(lv, C.categorical_columns(lv), split=False)


@query("city_districts", "C9", with_listing(
    "SELECT city, count(*) AS n_districts, string_agg(district, '|' ORDER BY district) AS districts FROM "
    "(SELECT DISTINCT trim(coalesce(city, '')) AS city, trim(district) AS district FROM listing WHERE district IS NOT NULL) "
    "WHERE city <> '' AND district <> '' AND city <> district GROUP BY city"))
def q_city_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.city_districts(listing_view(spark, sf_dir))


@query("cities", "C10 O6", with_listing("SELECT DISTINCT city AS value FROM listing WHERE city IS NOT NULL"))
def q_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = listing_view(spark, sf_dir)
    return P.distinct_values(lv, P.detect_city_column(lv))


# ------------------------------------------------------------------ C13 C14
_TYP_NUM = ["price", "floor_area_sqft", "rooms", "year_built", "maintenance_fee"]
_TYP_CAT = ["city", "property_type", "o_orderpriority", "view"]


def _typ_num_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {sql_rnd(f'median({c})', 2)} AS median, {sql_rnd(f'avg({c})', 2)} AS mean, "
        f"{sql_rnd(f'min({c})', 2)} AS min, {sql_rnd(f'max({c})', 2)} AS max, "
        f"{sql_rnd(f'quantile_cont({c}, 0.25)', 2)} AS p25, {sql_rnd(f'quantile_cont({c}, 0.75)', 2)} AS p75 FROM listing"
        for c in _TYP_NUM
    )
    return with_listing(parts)


@query("typical_values", "C13", _typ_num_sql())
def q_typical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.typical_numeric(listing_view(spark, sf_dir), _TYP_NUM)


def _typ_cat_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM listing WHERE {c} IS NOT NULL" for c in _TYP_CAT)
    return with_listing(
        "SELECT column_name, string_agg(value, '|' ORDER BY rk) FILTER (WHERE rk <= 3) AS top3, "
        "min(value) FILTER (WHERE rk = 1) AS mode, count(*) AS n_unique FROM r GROUP BY column_name",
        f"long AS ({long})",
        "vc AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY ALL)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk FROM vc)",
    )


@query("typical_values_categorical", "C13", _typ_cat_sql())
def q_typical_values_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.typical_categorical(listing_view(spark, sf_dir), _TYP_CAT)


@query("typical_row", "C14", with_listing(
    f"SELECT {K}, city, property_type, floor_area_sqft, price, {sql_rnd('med', 2)} AS median_target FROM listing, "
    "(SELECT median(price) AS med FROM listing) m ORDER BY abs(price - med), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1"))
def q_typical_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: listing whose price is nearest the median price."""
    return P.typical_row(listing_view(spark, sf_dir), "price", KEYS, ["city", "property_type", "floor_area_sqft", "price"])


# ------------------------------------------------------------------ D
def _derived(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return add_derived_features(listing_view(spark, sf_dir), REF_YEAR, only=names).select(*KEYS, *names)


_D_RATIOS = {
    "age": sql_clip(f"{REF_YEAR} - year_built", 0, 200),
    "lot_ratio": sql_clip(sql_div("lot_size_sqft", "floor_area_sqft"), 0, 100),
    "room_density": sql_clip(sql_div("rooms", "floor_area_sqft") + " * 100", 0, 10),
    "bath_ratio": sql_clip(sql_div("bathrooms", "rooms"), 0, 2),
    "ppsf": sql_clip(sql_div("price", "floor_area_sqft"), 50, 10000),
    "price_discount_pct": sql_clip(sql_div("sold_price - price", "price") + " * 100", -30, 30),
}


def _ps_num(pattern: str) -> str:
    e = f"regexp_extract(coalesce(parking_spaces, ''), '{pattern}', 1)"
    return f"CASE WHEN {e} <> '' THEN CAST({e} AS DOUBLE) END"


_D_PARKING = {
    "n_parking_spaces": sql_clip(f"coalesce({_ps_num(r'Total spaces:\s*(\d+)')}, {_ps_num(r'(\d+)')})", 0, 20),
    "n_covered_parking": sql_clip(f"coalesce({_ps_num(r'\((\d+)\s*covered\)')}, 0.0)", 0, 20),
    "has_garage": "CAST(contains(lower(coalesce(parking_spaces, '')), 'garage') AS DOUBLE)",
    "has_rv_parking": "CAST(contains(lower(coalesce(parking_spaces, '')), 'rv') AS DOUBLE)",
}

_FP = "coalesce(fireplace, '')"
_D_FIREPLACE = {
    "n_fireplaces": sql_clip(
        f"coalesce(CASE WHEN regexp_extract({_FP}, '^(\\d+)', 1) <> '' THEN CAST(regexp_extract({_FP}, '^(\\d+)', 1) AS DOUBLE) END, "
        f"CAST(length({_FP}) > 2 AS DOUBLE))".replace("\\\\", "\\"), 0, 5),
    "has_gas_fireplace": f"CAST(contains(lower({_FP}), 'gas') AS DOUBLE)",
    "n_levels": sql_clip("levels", 1, 5),
}


def _flag(c: str) -> str:
    return f"CAST(length(trim(coalesce({c}, ''))) > 2 AS DOUBLE)"


_D_FLAGS = {
    "has_view": _flag("view"),
    "has_fireplace": _flag("fireplace"),
    "has_cooling": _flag("cooling_features"),
    "has_parking_feat": _flag("parking_features"),
    "has_appliances": _flag("appliances"),
    "has_interior": _flag("interior_features"),
    "has_strata": "CAST(coalesce(maintenance_fee > 0, false) AS DOUBLE)",
}

_D_GEO = {
    "log_dom": sql_rnd(f"ln(1 + {sql_clip('days_on_market', 0, 365)})", 6),
    "dist_van_centre": sql_rnd(sql_clip("sqrt(pow(latitude - 49.2827, 2) + pow(longitude - (-123.1207), 2)) * 111", 0, 200), 6),
}


def _d_sql(d: dict[str, str]) -> str:
    return with_listing(f"SELECT {K}, " + ", ".join(f"{e} AS {n}" for n, e in d.items()) + " FROM listing")


@query("derived_ratios", "D1 D2 D3 D4 D12 D22", _d_sql(_D_RATIOS))
def q_derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, list(_D_RATIOS))


@query("derived_parking", "D5 D6 D7 D8", _d_sql(_D_PARKING))
def q_derived_parking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, list(_D_PARKING))


@query("derived_fireplace", "D9 D10 D11", _d_sql(_D_FIREPLACE))
def q_derived_fireplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, list(_D_FIREPLACE))


@query("derived_flags", "D15-D21", _d_sql(_D_FLAGS))
def q_derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, list(_D_FLAGS))


@query("derived_geo_time", "D13 D14", _d_sql(_D_GEO))
def q_derived_geo_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from valuelens.functions.exprs import rnd

    d = _derived(spark, sf_dir, list(_D_GEO))
    return d.select(*KEYS, *[rnd(c, 6).alias(c) for c in _D_GEO])


# ------------------------------------------------------------------ F
@query("filter_global", "F1", with_listing(
    f"SELECT {K}, city, o_orderpriority, price FROM listing WHERE CAST(city AS VARCHAR) IN ('NATION_1', 'NATION_7') "
    "AND CAST(o_orderpriority AS VARCHAR) = '1-URGENT'"))
def q_filter_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list filter on city, scalar on priority; unknown column and empty value ignored."""
    lv = FL.global_filter(listing_view(spark, sf_dir),
                          {"city": ["NATION_1", "NATION_7"], "o_orderpriority": "1-URGENT", "no_such_column": "x", "district": ""})
    return lv.select(*KEYS, "city", "o_orderpriority", "price")


@query("filter_tokens", "F7", with_listing(
    f"SELECT {K}, interior_features FROM listing WHERE "
    "list_has_any(list_transform(string_split(coalesce(interior_features, ''), ','), lambda x: trim(x)), ['ring', 'widget'])"))
def q_filter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = FL.any_token_filter(listing_view(spark, sf_dir), {"interior_features": ["ring", "widget"]})
    return lv.select(*KEYS, "interior_features")


@query("filter_rooms", "F3 F5 F6 F8", with_listing(
    f"SELECT {K}, property_type, bedrooms, bathrooms, floor_area_sqft FROM listing WHERE _source = 'N' "
    "AND CAST(property_type AS VARCHAR) IN ('PROMO', 'SMALL') AND coalesce(bedrooms, 0) >= 3 AND coalesce(bathrooms, 0) >= 1 "
    "AND floor_area_sqft IS NOT NULL"))
def q_filter_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = FL.restrict_source(listing_view(spark, sf_dir), "N")
    lv = FL.value_filter(lv, "property_type", ["PROMO", "SMALL"])
    lv = FL.min_count_filter(lv, "bedrooms", 3)
    lv = FL.min_count_filter(lv, "bathrooms", 1)
    lv = FL.require_area(lv)
    return lv.select(*KEYS, "property_type", "bedrooms", "bathrooms", "floor_area_sqft")


@query("filter_location", "F4 F14", with_listing(
    f"SELECT {K}, coalesce(city, district) AS city, district FROM listing WHERE CAST(coalesce(city, district) AS VARCHAR) IN ('NATION_3', 'NATION_4')"))
def q_filter_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = FL.city_fallback(listing_view(spark, sf_dir))
    return FL.value_filter(lv, "city", ["NATION_3", "NATION_4"]).select(*KEYS, "city", "district")


@query("source_split", "F2", with_listing(
    f"SELECT {K}, _source, 'train' AS role FROM listing WHERE _source = 'R' UNION ALL "
    f"SELECT {K}, _source, 'eval' AS role FROM listing WHERE _source = 'A'"))
def q_source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, ev = FL.source_split(listing_view(spark, sf_dir), "R", "A")
    return tr.select(*KEYS, "_source", F.lit("train").alias("role")).unionByName(ev.select(*KEYS, "_source", F.lit("eval").alias("role")))


@query("outlier_fence", "F9 F10", (
    "WITH e AS (SELECT event_id, TRY_CAST(value AS DOUBLE) AS value FROM events WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL), "
    "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM e) "
    "SELECT event_id, value FROM e, q WHERE n < 20 OR value BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)"))
def q_outlier_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9+F10 on the events value column (it has a long right tail)."""
    ev = FL.numeric_target(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return FL.outlier_fence(ev, "value", 3.0, min_rows=20)


@query("target_fallback", "F11", with_listing(f"SELECT {K}, 'price' AS target_column, price AS target FROM listing"))
def q_target_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an all-null sold_price falls back to the first usable price column."""
    lv = listing_view(spark, sf_dir).withColumn("sold_price", F.lit(None).cast("double"))
    t = FL.usable_target(lv, "sold_price")
    return lv.select(*KEYS, F.lit(t).alias("target_column"), F.col(t).alias("target"))
