"""Filters and predicates F1-F14 (lazy ``where``s Catalyst can push down)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd, tokens, try_num
from valuelens.operators.clean import is_numeric
from valuelens.operators.quantiles import DEFAULT_MAX_GROUP_ROWS, fence_bounds
from valuelens.session import cut

# Fixed values from the reference.
AREA_COLUMNS = ["floor_area_sqft", "sqft", "size_sqft", "area_sqft"]
PRICE_CANDIDATES = ["sold_price", "price", "list_price", "asking_price"]
DIRECT_LEAKY = ["price", "list_price", "asking_price", "price_discount_pct"]
SOLD_TARGETS = ["sold_price", "sold_price_adjusted"]
SQFT_NAMES = ["floor_area_sqft", "sqft", "floor_area"]
CANDIDATE_SKIP = ["listing_id", "real_mls", "mls", "summary_url", "virtual_tour", "street", "_source", "_file_type", "_sample_weight"]
CANDIDATE_SKIP_PARTS = ["url", "link", "photo", "id", "agent", "brokerage", "email"]


def global_filter(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """equality (scalar) or IN (list), compared as strings; unknown columns and empty values ignored."""
    for col, val in (filters or {}).items():
        if not val or col not in df.columns:
            continue
        s = F.col(col).cast("string")
        df = df.where(s.isin([str(v) for v in val])) if isinstance(val, (list, tuple, set)) else df.where(s == str(val))
    return df


def exclude_sources(df: DataFrame, excluded: Sequence[str] | None) -> DataFrame:
    """S7 applied: drop rows of toggled-off sources; untagged rows stay."""
    if excluded and "_source" in df.columns:
        df = df.where(F.col("_source").isNull() | ~F.col("_source").isin(list(excluded)))
    return df


def working_frame(df: DataFrame, excluded: Sequence[str] | None = None, filters: Mapping[str, object] | None = None) -> DataFrame:
    return global_filter(exclude_sources(df, excluded), filters)


def source_split(df: DataFrame, train_source: str = "", eval_source: str = "") -> tuple[DataFrame, DataFrame | None]:
    """train = A (eval = B), or everything but B trains; no sources -> (df, None)."""
    if "_source" in df.columns and train_source:
        return df.where(F.col("_source") == train_source), (df.where(F.col("_source") == eval_source) if eval_source else None)
    if "_source" in df.columns and eval_source:
        return df.where(~F.col("_source").eqNullSafe(eval_source)), df.where(F.col("_source") == eval_source)
    return df, None


def restrict_source(df: DataFrame, source: str = "") -> DataFrame:
    """single-source restriction."""
    return df.where(F.col("_source") == source) if source and "_source" in df.columns else df


def value_filter(df: DataFrame, column: str | None, value) -> DataFrame:
    """scalar or list membership on a column (as strings)."""
    if not value or not column or column not in df.columns:
        return df
    vals = [str(v) for v in value] if isinstance(value, (list, tuple, set)) else [str(value)]
    return df.where(F.col(column).cast("string").isin(vals))


def min_count_filter(df: DataFrame, column: str | None, minimum) -> DataFrame:
    """numeric minimum where an unparseable/missing value counts as 0."""
    if minimum is None or not column or column not in df.columns:
        return df
    return df.where(F.coalesce(try_num(F.col(column)), F.lit(0.0)) >= float(minimum))


def any_token_filter(df: DataFrame, allowed: Mapping[str, Sequence[str]] | None, delimiter: str = ",") -> DataFrame:
    """keep a row if any delimiter token of the cell is allowed."""
    for col, vals in (allowed or {}).items():
        if not vals or col not in df.columns:
            continue
        df = df.where(F.arrays_overlap(tokens(col, delimiter), F.array(*[F.lit(str(v)) for v in vals])))
    return df


def area_column(df: DataFrame) -> str | None:
    return next((c for c in AREA_COLUMNS if c in df.columns), None)


def require_area(df: DataFrame) -> DataFrame:
    """F8: drop rows without a floor area (first of the known names present)."""
    c = area_column(df)
    return df.where(F.col(c).isNotNull()) if c else df


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """coerce the target to DOUBLE and drop rows where it is missing or unparseable."""
    v = F.col(target).cast("double") if is_numeric(df, target) else try_num(F.col(target))
    return df.withColumn(target, v).where(F.col(target).isNotNull())


def outlier_fence(df: DataFrame, target: str, k: float = 3.0, min_rows: int = 0, max_group_rows: int = DEFAULT_MAX_GROUP_ROWS, keep: bool = True) -> DataFrame:
    """keep rows with target in [q1 - k*IQR, q3 + k*IQR] (exact linear quartiles).

    The fence applies only when at least ``min_rows`` target values exist.  ``keep`` is that of ``group_quantiles``.
    Quartiles come from the distributed exact quantile operator (the whole
    table is one group, so no single task ever holds it); the one-row bound
    table is written once, so that no reader of the rows works it out again, and
    broadcast (one row by construction).
    """
    b = cut(fence_bounds(df, target, k, max_group_rows=max_group_rows, keep=keep), "fence")
    j = df.crossJoin(F.broadcast(b))
    inside = (F.col("_n") < min_rows) | F.col(target).between(F.col("_lo"), F.col("_hi"))
    return j.where(inside).drop("_n", "_q1", "_q3", "_lo", "_hi")


def usable_target(df: DataFrame, target: str, candidates: Sequence[str] = PRICE_CANDIDATES) -> str | None:
    """the target if it has any parseable value, else the first usable price column."""
    names = [target] + [c for c in candidates if c != target]
    names = [c for c in names if c in df.columns]
    if not names:
        return None
    # mostly the first answers, and the columns of the others need not be made
    for some in (names[:1], names[1:]):
        if some:
            r = df.agg(*[F.count(try_num(F.col(c))).alias(f"c{i}") for i, c in enumerate(some)]).first()
            for i, c in enumerate(some):
                if r[f"c{i}"] > 0:
                    return c
    return None


def leakage_guard(features: Sequence[str], target: str) -> tuple[list[str], list[str]]:
    """drop features that leak a sold-price target. Returns (kept, removed)."""
    feats = [c for c in features if c != target]
    if target not in SOLD_TARGETS:
        return feats, []
    to_remove = set(DIRECT_LEAKY)
    if any(c in feats for c in DIRECT_LEAKY) or any(c in feats for c in SQFT_NAMES):
        to_remove.add("ppsf")
    removed = [c for c in feats if c in to_remove]
    return [c for c in feats if c not in to_remove], removed


def candidate_features(df: DataFrame, target: str, min_non_null: float = 0.3) -> DataFrame:
    """(column_name, non_null_rate, selected) from one aggregate over all columns."""
    cols = [c for c in df.columns]
    rates = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    long = rates.unpivot([], cols, "column_name", "non_null_rate")
    skip = set(CANDIDATE_SKIP) | {target}
    name_ok = ~F.col("column_name").isin(list(skip))
    for part in CANDIDATE_SKIP_PARTS:
        name_ok = name_ok & ~F.lower(F.col("column_name")).contains(part)
    return long.select("column_name", rnd("non_null_rate", 4).alias("non_null_rate"),
                       (name_ok & (F.col("non_null_rate") > min_non_null)).alias("selected"))


def city_fallback(df: DataFrame, city: str = "city", district: str = "district") -> DataFrame:
    """null city -> district."""
    if city in df.columns and district in df.columns:
        return df.withColumn(city, F.coalesce(F.col(city), F.col(district)))
    return df
