"""Language identification with a byte convolutional network trained in numpy.

The network reads fixed-length windows of UTF-8 bytes: filters of several widths on
one-hot bytes, ReLU, max pooling over the window, softmax.  It is trained on the driver
from a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` documents per language and
``SAMPLE_CHARS`` characters of each (a place inside the text chosen by hash).  Prediction
tiles each whole text with windows; a text's probabilities are the means over its windows,
weighted by their bytes, so nothing of a long text is left out.

Scale: labels are counted per language, the sample is picked by a hash threshold per
language, and prediction is one map without a shuffle; the model (a few hundred KB) is all
that is sent to tasks.

Cases: null texts and texts without a letter get ``und`` with score 0; without any
labelled training row every text gets ``und``; null labels and null ids are never learned
from, and a null id is not held out; of equal probabilities the first language by name
wins; repeated rows each get a row; other columns pass through as one struct if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.llm import _words as W
from valuelens.llm._shared import ship_package

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
SAMPLE_DOCS, SAMPLE_CHARS = 600, 2048
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    langs: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    offset: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False):
        """Max-pooled filter outputs of windows (n, WINDOW) and, if asked, where each maximum lies."""
        out, at = [], []
        for f in self.filters:
            w, n = len(f), x.shape[1] - len(f) + 1
            y = f[0][x[:, :n]]
            for j in range(1, w):
                y += f[j][x[:, j : n + j]]
            if places:
                at.append(y.argmax(1))
            out.append(y.max(1))
        z = np.maximum(np.concatenate(out, 1) + self.bias, 0)
        return (z, np.concatenate(at, 1)) if places else z

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.pooled(x) @ self.dense + self.offset
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)


def tile(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, document of each, bytes in each): whole texts cut into WINDOW bytes, the last padded with 0."""
    n = -(-np.diff(bounds) // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    start = bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(n.cumsum() - n, n)) * WINDOW
    size = np.minimum(WINDOW, bounds[1:][doc] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = padded[start[:, None] + np.arange(WINDOW)]
    x[np.arange(WINDOW) >= size[:, None]] = 0
    return x, doc, size


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model | None:
    """Adam on the cross-entropy of single windows; a maximum passes its gradient to the bytes under it."""
    if not texts:
        return None
    langs = sorted(set(labels))
    r = np.random.default_rng(seed)
    x, doc, size = tile(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    use = size >= 32 if (size >= 32).any() else size > 0
    x, y = x[use], np.array([langs.index(v) for v in labels])[doc[use]]
    total = len(WIDTHS) * FILTERS
    model = Model(
        langs,
        [r.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        r.normal(0, 0.3, (total, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    params = [*model.filters, model.bias, model.dense, model.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for i in range(0, len(order), BATCH):
            xb, yb = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
            z, at = model.pooled(xb, places=True)
            s = z @ model.dense + model.offset
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            back = (p @ model.dense.T) * (z > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g = np.zeros_like(model.filters[k])
                for j in range(w):
                    under = np.take_along_axis(xb, at[:, cols] + j, 1)
                    np.add.at(g[j], (under, np.arange(FILTERS)[None, :]), back[:, cols])
                grads.append(g)
            grads += [back.sum(0), z.T @ p, p.sum(0)]
            step += 1
            for q, g, a, b in zip(params, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                q -= (RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return model


def _has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or (not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace")))


def _run(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in W.slices(batches):
            n = np.diff(bounds)
            total = np.zeros((len(n), len(model.langs) if model else 1))
            x, doc, size = tile(data, bounds) if model else (np.empty((0, 1)), None, None)
            for i in range(0, len(x), 512):
                part = slice(i, i + 512)
                np.add.at(total, doc[part], model.probabilities(x[part]) * size[part, None])
            letters = np.array([model is not None and _has_letter(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], bool)
            best = total.argmax(1)
            score = np.where(letters, total[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
            keep = [i for i, c in enumerate(rows.schema.names) if c != "text"]
            yield pa.record_batch(
                [*(rows.column(i) for i in keep), pa.array([model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], pa.string()), pa.array(np.clip(score, 0, 1))],
                names=[*(rows.schema.names[i] for i in keep), "lang_pred", "score"],
            )

    return run


def held_out_column(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """Train on a bounded, hash-picked sample of the labelled rows that are not held out."""
    labelled = docs.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    pick = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, SAMPLE_DOCS / n))), F.col("lang"))
    place = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long")).cast("int")
    sample = (
        labelled.where(pick < share)
        .select("doc_id", "lang", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("part"))
        .limit(2 * SAMPLE_DOCS * len(counts))
    )
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["lang"], r["part"]))
    return train([r["part"].encode() for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, keep_row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; ``keep_row`` adds the input row as the struct ``kept_row``."""
    ship_package(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("kept_row")] if keep_row else []))
    schema = T.StructType([f for f in given.schema.fields if f.name != "text"] + T.StructType.fromDDL("lang_pred string, score double").fields)
    return given.mapInArrow(_run(model), schema)
