"""URL filters [native]: host-suffix and path-prefix expressions against a rule list.

Every URL is expanded into the expressions it could match - each suffix of its host at a
dot, joined with each prefix of its path that is as long as some rule's path.  Rules and
expressions meet in an equi-join on a short hash prefix; the full digest is confirmed
after it, and the longest rule of a URL decides.  Only built-in functions run.

Scale: expressions are made per distinct (host, path), so a hot address is expanded once;
the rule side is broadcast when a count proves it small, else it is replicated over salts
so that one host that holds a third of all URLs is spread over tasks.

Cases: null URL or none with ``://``: host and path are empty and no rule fits; repeated
rows each get their verdict; an empty rule list or table gives the default verdict or no
rows; rule rows with a null host, path or verdict are ignored; of equal rules ``block``
wins; other columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuelens.llm._shared import sized_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
MAX_BROADCAST_RULES = 100_000
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # the length of the host keeps (ab, c) and (a, bc) apart
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host + path of the winner, else null), verdict."""
    known = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .dropna()
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # block > allow
        .withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    # distinct path lengths of the rules: a few integers, no more than the longest rule has characters
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())

    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = (
        base.where("host != ''")
        .select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("x_digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("x_digest", 1, PREFIX_HEX))
        .select("host", "path", "x_digest", "short")
    )
    side = sized_broadcast(known, MAX_BROADCAST_RULES)
    on = ["short"]
    if side is known:  # too many rules to broadcast: a copy of each per salt
        side = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        expressions = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        on = ["short", "salt"]
    best = (
        expressions.join(side, on)
        .where("x_digest = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_host", "r_path", "r_verdict")).alias("best"))
        .select(
            F.col("host").alias("b_host"),
            F.col("path").alias("b_path"),
            F.concat("best.r_host", "best.r_path").alias("rule"),
            F.col("best.r_verdict").alias("b_verdict"),
        )
    )
    return base.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("b_verdict", F.lit(default)).alias("verdict")
    )
