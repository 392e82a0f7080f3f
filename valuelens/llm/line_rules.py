"""Quality rules, line first: bad lines go, then documents that lost too much text.

Each line with a word is judged by itself:

* punctuation: it must hold the end of a sentence (one of ``. ! ? …`` before white space
  or the line's end), and marks (``! ?`` and the symbols) may not exceed a quarter of its words;
* navigation: two or more separators ``|`` that make up at least a tenth of its words;
* boilerplate: it holds one of ``BOILERPLATE`` in any case (A-Z).

A document is kept if it passes the base rules and its remaining lines hold at least half
of its words.  All tests are integer arithmetic on whole lines of whole texts.

Scale: one map over the documents, no shuffle; memory follows the longest document.

Cases: null or empty text has no words and fails the base rules; lines without a word are
neither good nor bad; repeated rows each give a row; an empty table gives none; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import ship_package

SYMBOLS = b"#*$%&|<>"  # fixed by the contract
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "terms of use",
    "this work is licensed",
)
MIN_WORDS, WINDOW = 50, 3

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, n_good_words long, clean_text string"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_ELLIPSIS = "…".encode()


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: words within 3-word windows that the same document has twice or more."""
    n = len(h)
    if n < WINDOW:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    w = W.windows(h, WINDOW)
    inside = doc[: len(w)] == doc[WINDOW - 1 :]
    with np.errstate(over="ignore"):
        w = w + W.mix(doc[: len(w)].astype(np.uint64) + np.uint64(7))
    at = np.flatnonzero(inside)
    _, back, count = np.unique(w[at], return_inverse=True, return_counts=True)
    flag = np.zeros(n, bool)
    flag[at[count[back] > 1]] = True
    return W.per_doc(W.covered(flag, WINDOW, n), first)


def judge_lines(text: str) -> tuple[list[str], int, int, int, int]:
    """(good lines, lines with a word, bad lines, words in good lines, lines equal to an earlier one)."""
    good, n, words, dup, seen = [], 0, 0, 0, set()
    for line in text.split("\n"):
        raw = line.encode()
        w = len(raw.split())
        if not w:
            continue
        n += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        b = np.frombuffer(raw, np.uint8)
        stops = np.flatnonzero(_STOP[b])
        ends = bool(len(stops)) and bool(((stops + 1 == len(b)) | W.SPACES[b[np.minimum(stops + 1, len(b) - 1)]]).any())
        if not ends and _ELLIPSIS in raw:
            ends = any(not piece or piece[:1].isspace() for piece in raw.split(_ELLIPSIS)[1:])
        marks = int((_BANG[b] | _SYMBOL[b]).sum())
        bars = raw.count(b"|")
        low = raw.lower()  # bytes: A-Z only
        if not ends or 4 * marks > w or (bars >= 2 and 10 * bars >= w) or any(x in low for x in _BOILER):
            continue
        good.append(line)
        words += w
    return good, n, n - len(good), words, dup


_BOILER = tuple(x.encode() for x in BOILERPLATE)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = W.Hasher()
    for rows, data, bounds in W.slices(batches):
        starts, ends, first = W.spans(data, bounds, W.PLAIN)
        n_words = np.diff(first)
        # code points: bytes that do not continue a character
        chars = W.per_doc(W.PLAIN[data] & ((data & 0xC0) != 0x80), bounds)
        symbols = W.per_doc(_SYMBOL[data], bounds)
        repeats = _repeats(hasher.words(data, starts, ends), first)
        lines = [judge_lines(data[a:b].tobytes().decode("utf-8", "surrogatepass")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        good = np.array([x[3] for x in lines], np.int64)
        failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
        yield pa.record_batch(
            [
                rows.column(0).cast(pa.int64()),
                *(pa.array(np.asarray(x, np.int64)) for x in (n_words, chars, symbols, [x[4] for x in lines], repeats)),
                pa.array(failed),
                pa.array(~failed & (2 * good >= n_words)),
                *(pa.array(np.asarray(x, np.int64)) for x in ([x[1] for x in lines], [x[2] for x in lines], good)),
                pa.array(["\n".join(x[0]) for x in lines], pa.string()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


def clean_lines(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, the verdict and the text without its bad lines."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run, SCHEMA)
