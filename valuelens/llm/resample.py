"""Quality classifier by importance resampling: hashed n-gram models of target and raw text.

Two kinds of n-grams are hashed into ``BUCKETS`` each: words (runs of letters and digits, A-Z
lowered) and pairs of neighbouring words, all pairs of a word with itself sharing one
bucket; and runs of ``SHAPE`` symbols of the text's outline, in which letters, capitals
and digits stand for their class and a run of one class for one symbol.  The target model
is the smoothed bucket distribution of the texts labelled good, the raw model that of all
texts.  A text's log weight is the sum over its n-grams of the log ratio of both.  Adding
Gumbel noise (from a hash of the id and the seed) to ``TEMPER * log weight / number of
n-grams`` and taking the k largest keys samples k texts without replacement in proportion
to the importance; k is the share of good labels times the number of texts.

Scale.  Each model is one fixed-size vector of counts: a task sends one vector, so what
reaches the driver is bounded by BUCKETS times a merge of pre-summed vectors by bucket.
The k-th largest (key, id) comes from counts of leading bits, refined digit by digit; no sort.

Cases: null and empty texts have no n-gram, weight 0; without target labels all weights are
0 and the choice is by noise alone; null labels and ids are ignored in fitting, a null id
takes part in sampling with the noise of its text; repeated rows each count, and rows with
equal key and id are selected together; k at or above the number of rows keeps all; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package

BUCKETS, SHAPE, SMOOTH, TEMPER, SEED = 10_000, 5, 1.0, 30.0, 17
MAX_BROADCAST_LABELS = 2_000_000
DIGIT_BITS, DIGITS = 13, 5  # 5 x 13 bits cover 64
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = ord("a")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x30:0x3A] = ord("0")


def _features(raw: np.ndarray, bounds: np.ndarray, hasher: W.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and pair of words."""
    data = W.LOWER[raw]
    starts, ends, first = W.spans(data, bounds, W.ALNUM)
    h = hasher.words(data, starts, ends)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = W.windows(h, 2)
    pair[h[1:] == h[:-1]] = 0
    inside = doc[1:] == doc[:-1]
    shape = _CLASS[raw]
    at = np.ones(len(raw), bool)
    at[1:] = (shape[1:] != shape[:-1]) | (shape[1:] < 48)
    at[bounds[:-1][bounds[:-1] < len(raw)]] = True
    place = np.flatnonzero(at)
    owner = np.searchsorted(bounds, place, "right") - 1
    outline = W.windows(shape[place], SHAPE)
    whole = owner[: len(outline)] == owner[SHAPE - 1 :] if len(outline) else np.empty(0, bool)
    words = np.concatenate([h, pair[inside]]) % np.uint64(BUCKETS)
    bucket = np.concatenate([words.astype(np.int64), (outline[whole] % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS])
    return bucket, np.concatenate([doc, doc[:-1][inside] if len(doc) else doc, owner[: len(outline)][whole]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's bucket counts: of all texts, and of those marked as target."""
    hasher = W.Hasher()
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for rows, data, bounds in W.slices(batches):
        bucket, doc = _features(data, bounds, hasher)
        good = rows.column(0).to_numpy(zero_copy_only=False).astype(bool)
        raw += np.bincount(bucket, minlength=2 * BUCKETS)
        target += np.bincount(bucket[good[doc]], minlength=2 * BUCKETS)
    yield pa.record_batch([pa.array(np.arange(2 * BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, each kind of n-gram by itself; zero without target text."""
    out = np.zeros(2 * BUCKETS)
    for kind in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        t, r = target[kind], raw[kind]
        if t.sum():
            out[kind] = np.log((t + SMOOTH) / (t.sum() + SMOOTH * BUCKETS)) - np.log((r + SMOOTH) / (r.sum() + SMOOTH * BUCKETS))
    return out


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for rows, data, bounds in W.slices(batches):
            bucket, doc = _features(data, bounds, hasher)
            n = np.bincount(doc, minlength=rows.num_rows)
            # sums in order of place: a text's weight does not depend on its batch
            weight = np.bincount(doc, ratio[bucket], rows.num_rows)
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "noise_key", "n_features", "log_weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio per bucket, from all texts and all labelled good."""
    ship_package(docs.sparkSession)
    good = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    side = F.broadcast(good) if good.count() <= MAX_BROADCAST_LABELS else good
    marked = docs.join(side, docs["doc_id"] == F.col("good_id"), "left").select(F.col("good_id").isNotNull().alias("good"), F.col("text").cast("string").alias("text"))
    rows = marked.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # 2 * BUCKETS rows
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return log_ratio(raw, target)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, key: the Gumbel key that sampling ranks by."""
    ship_package(docs.sparkSession)
    text = F.col("text").cast("string")
    noise_key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))).otherwise(F.xxhash64(F.lit(seed), text))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), noise_key.alias("noise_key"), text.alias("text"))
    out = given.mapInArrow(_weigh(ratio), "doc_id long, noise_key long, n_features long, log_weight double")
    # 52 bits of the hash, in the open unit interval
    u = (F.shiftrightunsigned("noise_key", 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    mean = F.col("log_weight") / F.greatest(F.col("n_features"), F.lit(1))
    return out.select("doc_id", "n_features", "log_weight", (mean * F.lit(TEMPER) - F.log(-F.log(u))).alias("key"))


def _digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digits that sort as (key falling, id rising, null ids last)."""
    for b in batches:
        bits = b.column(b.schema.get_field_index("key")).to_numpy().view(np.uint64)
        up = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
        ids = b.column(b.schema.get_field_index("doc_id"))
        own = ids.fill_null((1 << 63) - 1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        digits = []
        for x in (~up, own):
            for k in range(DIGITS):
                low = max(64 - DIGIT_BITS * (k + 1), 0)
                width = 64 - DIGIT_BITS * k - low
                digits.append(((x >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64))
        yield pa.record_batch([*b.columns, *map(pa.array, digits)], names=[*b.schema.names, *(f"digit{k}" for k in range(2 * DIGITS))])


def top_k(weighed: DataFrame, k: int) -> DataFrame:
    """``weighed`` with ``selected``: the k rows of largest key; equal keys go by id, the smaller first."""
    digits = [f"digit{i}" for i in range(2 * DIGITS)]
    fields = ", ".join(f"{c} {t}" for c, t in weighed.dtypes) + "".join(f", {d} long" for d in digits)
    rows = cut(weighed.mapInArrow(_digits, fields), "keys")
    left, prefix, chosen, edge = k, F.lit(True), F.lit(False), -1
    for d in digits:
        if left <= 0:
            break
        edge = None
        for r in sorted(rows.where(prefix).groupBy(d).count().collect()):  # at most 2 ** DIGIT_BITS rows
            if r["count"] > left:
                edge = r[d]
                break
            left -= r["count"]
        if edge is None:  # all under the prefix fit
            break
        chosen = chosen | (prefix & (F.col(d) < edge))
        prefix = prefix & (F.col(d) == edge)
    else:
        edge = None if left > 0 else edge  # rows equal in key and id go together
    if k > 0 and edge is None:
        chosen = chosen | prefix
    return rows.withColumn("selected", chosen).drop(*digits)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, key, selected: ``share`` (default: that of good labels) of the rows is sampled."""
    if share is None:
        seen = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if seen is None else seen
    weighed = weigh(docs, fit(docs, labels), seed)
    return top_k(weighed, math.ceil(share * docs.count()))
