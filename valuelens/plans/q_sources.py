"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.operators.clean import clean_numeric
from valuelens.plans.listing import KEYS, NEARBY_SQL, listing_view, nearby_edges, table
from valuelens.plans.q_clean import with_listing
from valuelens.plans.registry import query
from valuelens.session import scratch_dir
from valuelens.sources import cache as CA
from valuelens.sources import csv as CSV
from valuelens.sources import geography as G
from valuelens.sources import pages as PG

_PART_TYPED_SQL = ("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, "
                   "CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")


@query("csv_roundtrip", "S1 S15 C1", _PART_TYPED_SQL)
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> quoted ';' CSV on the shared store -> sniffed read (all text) -> C1 typing."""
    path = scratch_dir(spark, "csv-roundtrip")
    CSV.write_csv(table(spark, sf_dir, "part"), path, sep=";")
    df, _ = CSV.read_csv(spark, path)
    return clean_numeric(df)


@query("csv_encodings", "S2 S1", "SELECT CAST(conv_id AS DOUBLE) AS conv_id, CAST(turn AS DOUBLE) AS turn, role, text, 'latin-1' AS encoding FROM conversations")
def q_csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations written as ISO-8859-1 (accents, quoted newlines): UTF-8 decoding shows U+FFFD, the chain falls back to latin-1."""
    path = scratch_dir(spark, "csv-latin1")
    CSV.write_csv(table(spark, sf_dir, "conversations"), path, encoding="ISO-8859-1")
    df, enc = CSV.read_csv(spark, path, encodings=CSV.EXTRA_ENCODINGS)
    return clean_numeric(df).withColumn("encoding", F.lit(enc))


_QUOTED = "'say \"' || p_name || '\"' || chr(10) || 'size ' || CAST(p_size AS VARCHAR)"


@query("csv_quoted_sink", "S15 S1", f"SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, {_QUOTED} AS note FROM part")
def q_csv_quoted_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with embedded quotes and newlines survive the quote-all sink and the multi-line reader."""
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit('say "'), F.col("p_name"), F.lit('"\n'), F.lit("size "), F.col("p_size").cast("string")).alias("note"))
    path = scratch_dir(spark, "csv-quoted")
    CSV.write_csv(p, path)
    df, _ = CSV.read_csv(spark, path)
    return clean_numeric(df)


@query("load_folders", "S3 O4 S1 C1", (
    "SELECT 'listings' AS file_type, 1.0::DOUBLE AS weight, CAST(c_custkey AS DOUBLE) AS number, c_name AS name, CAST(NULL AS VARCHAR) AS reason FROM customer "
    "UNION ALL SELECT 'listings', 1.0, CAST(p_partkey AS DOUBLE), p_name, NULL FROM part "
    "UNION ALL SELECT 'sold', 3.0, CAST(s_suppkey AS DOUBLE), s_name || chr(10) || 'nation ' || CAST(s_nationkey AS VARCHAR), NULL FROM supplier "
    "UNION ALL SELECT 'listings', NULL, NULL, NULL, 'a record has 3 fields, the header 2'"))
def q_load_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: folders of CSV files with two headers, quoted newlines and one ragged file, read in one scan; the bad file is a row."""
    from valuelens.sources.folders import load_folders

    base = scratch_dir(spark, "folders")
    parts = [("ads", "customer", "c_custkey", F.col("c_name")), ("ads", "part", "p_partkey", F.col("p_name")),
             ("sold", "supplier", "s_suppkey", F.concat("s_name", F.lit("\nnation "), F.col("s_nationkey").cast("string")))]
    for folder, name, key, label in parts:
        rows = table(spark, sf_dir, name).select(F.col(key).alias(f"{name}_number"), label.alias("name"))
        rows.write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{base}/{folder}")
    ragged = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("1,2,3").alias("a,b"))
    ragged.coalesce(1).write.mode("append").option("header", True).option("quote", "").csv(f"{base}/ads")
    got, problems = load_folders(spark, base, 2025)
    number = F.coalesce(*[F.col(f"{name}_number") for _, name, _, _ in parts])
    rows = got.select(F.col("_file_type").alias("file_type"), F.col("_sample_weight").alias("weight"), number.alias("number"), "name", F.lit(None).cast("string").alias("reason"))
    null = F.lit(None)
    return rows.union(problems.select(F.split("source", "/")[0].alias("file_type"), null.cast("double"), null.cast("double"), null.cast("string"), "reason"))


@query("folder_reload", "S4 S1", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, 'listings' AS file_type FROM part")
def q_folder_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder watched twice while files arrive; the state holds each file's last version."""
    from valuelens.streaming import folder_versions as FV

    base, p = scratch_dir(spark, "reload"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    for half in (0, 1):
        p.where(F.col("p_partkey") % 2 == half).write.mode("append").option("header", True).option("quoteAll", True).csv(f"{base}/ads")
        FV.watch_once(spark, f"{base}/ads", f"{base}/state")
    return FV.current(spark, f"{base}/state", ref_year=2025).select("p_partkey", "p_name", F.col("_file_type").alias("file_type"))


@query("preview", "S14", with_listing(
    "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in [*KEYS, "city", "view", "fireplace", "appliances"])
    + " FROM listing ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5"))
def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CSV.preview(listing_view(spark, sf_dir), KEYS, 5, [*KEYS, "city", "view", "fireplace", "appliances"])


def _pages_sql() -> str:
    art = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
    num = f"regexp_extract({art}, '(\\d[\\d,]*)', 1)"
    href = "regexp_extract(html, '<a href=\"([^\"]*)\"', 1)"
    return (
        "SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, "
        "nullif(regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1), '') AS lang, "
        "nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') AS h1, "
        f"nullif({href}, '') AS first_href, "
        f"CASE WHEN nullif({href}, '') IS NULL THEN NULL WHEN starts_with({href}, '/') THEN "
        f"regexp_extract(url, '^(https?://[^/?#]+)', 1) || {href} ELSE {href} END AS first_link, "
        f"CASE WHEN {num} <> '' THEN CAST(replace({num}, ',', '') AS DOUBLE) END AS first_number, "
        "len(regexp_extract_all(html, '<a href'))::INTEGER AS n_links FROM pages"
    ).replace("\\\\", "\\")


@query("page_records", "S16", _pages_sql())
def q_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PG.page_records(table(spark, sf_dir, "pages"))


_EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query("folder_stream", "S4 S3", "SELECT *, 'listings' AS _file_type, 1.0::DOUBLE AS _sample_weight FROM events")
def q_folder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events exported as CSV in two drops; two availableNow runs ingest each drop exactly once."""
    from valuelens.streaming.folder_stream import TS_FORMAT, ingest_once, read_sink

    base = scratch_dir(spark, "folder-stream")
    ev = table(spark, sf_dir, "events")
    for i, part in enumerate((ev.where(F.col("event_id") % 2 == 0), ev.where(F.col("event_id") % 2 == 1))):
        part.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
            "timestampNTZFormat", TS_FORMAT).csv(f"{base}/drop{i}")
        # move the finished drop's files into the watched folder (atomic renames, as a landing zone would)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        src = jvm.org.apache.hadoop.fs.Path(f"{base}/drop{i}")
        fs = src.getFileSystem(conf)
        dst = jvm.org.apache.hadoop.fs.Path(f"{base}/ads")
        fs.mkdirs(dst)
        for st in fs.listStatus(src):
            name = st.getPath().getName()
            if name.endswith(".csv"):
                fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(f"{base}/ads/drop{i}-{name}"))
        ingest_once(spark, f"{base}/ads", _EVENTS_SCHEMA, f"{base}/sink", f"{base}/checkpoint")
    return read_sink(spark, f"{base}/sink").drop("_source")


@query("result_cache", "S11", (
    "WITH ids AS (SELECT range AS id, bit_count(range)::INTEGER AS n_features FROM range(1, 16)), "
    "s AS (SELECT id, list_filter(['district', 'floor_area_sqft', 'property_type', 'rooms'], lambda c, i: ((id >> (4 - i)) & 1) = 1) AS f FROM ids), "
    "n AS (SELECT count(*) AS n FROM lineitem) "
    "SELECT array_to_string(f, ',') AS features, substr(md5(concat_ws('|', CAST(n AS VARCHAR), 'district|floor_area_sqft|property_type|rooms', "
    "array_to_string(list_sort(f), ','), 'linear', 'True', 'True', 'sold_price', 'R')), 1, 16) AS cache_key FROM s, n"))
def q_result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys for every subset of 4 features, written to and read back from a partitioned cache."""
    from valuelens.operators.search import feature_subsets

    cols = ["district", "floor_area_sqft", "property_type", "rooms"]
    subs = feature_subsets(spark, cols, min_features=1, max_features=4)
    n = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("_rows"))
    keyed = subs.crossJoin(F.broadcast(n)).withColumn(
        "cache_key", CA.cache_key(F.col("_rows"), cols, F.col("features"), "linear", True, True, "sold_price", "R"))
    path = scratch_dir(spark, "result-cache")
    CA.write_cache(keyed.select("cache_key", F.array_join("features", ",").alias("features")), path)
    back = CA.lookup(spark, path, keyed.select("cache_key"))
    return back.select("features", "cache_key")


@query("model_registry", "S13")
def q_model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, save twice, rename one, delete one, reload and score; list newest first."""
    from valuelens.operators import models as MD
    from valuelens.sources import registry as RG

    lv = listing_view(spark, sf_dir)
    m = MD.train_model(lv, "sold_price", ["floor_area_sqft", "district", "property_type"], KEYS, "linear", train_source="R")
    root = scratch_dir(spark, "models")
    a = RG.save_model(spark, root, m, "first", "20250101_000000")
    b = RG.save_model(spark, root, m, "second", "20250102_000000")
    RG.rename_model(spark, root, a, "renamed")
    RG.delete_model(spark, root, b)
    loaded = RG.load_model(spark, root, a)
    scored = loaded.predict(lv.where(F.col("_source") == "A"), "score").agg(F.count("prediction").alias("n_scored"))
    return RG.list_models(spark, root).select("id", "name", "model_type", "target_col").crossJoin(scored)


# ------------------------------------------------------------------ J2 J3 J5 S10
@query("coverage_counts", "J2 A7", (
    "WITH cust AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "cnt AS (SELECT n_name, count(*) AS n FROM cust GROUP BY 1) "
    "SELECT o_orderkey, coalesce(n, 0) AS n_district FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cnt USING (n_name)"))
def q_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order, the number of customers in its customer's nation (missing -> 0)."""
    from valuelens.operators.valuation import attach_coverage

    c, n, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    cust = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("district"))
    orders = o.join(cust, o.o_custkey == cust.c_custkey, "left").select("o_orderkey", "district")
    return attach_coverage(orders, cust).select("o_orderkey", "n_district")


@query("nearby_semi", "J3", (
    f"WITH e AS ({NEARBY_SQL}) SELECT c_custkey, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "WHERE n_name IN (SELECT nearby FROM e WHERE city = 'NATION_1')"))
def q_nearby_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers located in a city near NATION_1 (semi join through the adjacency edges)."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    cust = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("city"))
    near = nearby_edges(spark, sf_dir).where(F.col("city") == "NATION_1").select(F.col("nearby").alias("city"))
    return cust.join(F.broadcast(near), "city", "left_semi").select("c_custkey", "city")


@query("geo_dimension", "S10 J5", (
    "SELECT c_custkey, n_name AS district, r_name AS dim_city FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"))
def q_geo_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10+J5: a districts file in the geography JSON shape (nation -> region) read back and joined to customers."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("district"), F.col("r_name").alias("city"))
    doc = dim.agg(F.collect_list(F.struct("district", "city")).alias("districts")).select(
        F.lit("P").alias("province"), F.lit("C").alias("country"), "districts")  # one document: a bounded dimension
    path = scratch_dir(spark, "geography")
    doc.coalesce(1).write.mode("overwrite").json(path)
    districts = G.read_districts(spark, path)
    c = table(spark, sf_dir, "customer")
    cust = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("district"))
    return G.attach_city(cust, districts).select("c_custkey", "district", "dim_city")
