"""Toxicity: a lexicon trie intersected with Levenshtein automata, scored by context.

A word matches a term within one edit (two from ``LONG_TERM`` letters on).  The automaton's
states are sets of (trie node, edits so far); transitions are made when first used, so a
word costs one dictionary step per letter until no term is left.  Words are runs of
letters and digits (every byte from 0x80 on counts as one), A-Z lowered.

A hit's context is the window of ``CONTEXT`` words on each side: between quotation marks
or next to a reporting word it counts as quoted, which weakens it by ``QUOTED``.

Learned from a bounded sample of labelled rows (about ``SAMPLE`` of each class, picked by
hash): the lexicon (words after at least ``SUPPORT`` different words in toxic texts, and at
least ``PRECISION`` of such pairs in toxic texts; near copies of a text thus count once), a weight for exact and for misspelled matches of
each term, and a logistic curve over a text's strongest hit and the sum of the others.

Scale: the sample's ids (bounded) are broadcast to a scan; word counts of the sample are a
grouped count; scoring is one map over whole texts with the lexicon in the task closure.

Cases: null and empty texts have no hits and get the score of a text without hits; null
labels and null ids are not learned from, of several labels for an id the highest counts;
without labels or lexicon every text gets ``NO_MODEL``; repeated rows each get a row;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import ship_package

SAMPLE, SUPPORT, PRECISION = 4000, 5, 0.9
MIN_TERM, LONG_TERM, CONTEXT, QUOTED = 4, 9, 6, 0.25
NO_MODEL = 0.05
REPORTING = frozenset(x.encode() for x in ("said", "says", "quote", "quoted", "quotes", "word", "words", "term", "called", "wrote", "writes", "slur"))
_QUOTES = ('"', "“", "”", "„", "«", "»")


class Automaton:
    """Lexicon trie x Levenshtein automata, determinised as it is used."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.most = [0]  # edits allowed by the most generous term below a node
        for i, t in enumerate(terms):
            node, k = 0, self.edits(t)
            self.most[0] = max(self.most[0], k)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.term_at[node] = i
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}) if terms else -1

    @staticmethod
    def edits(term: str) -> int:
        return 2 if len(term) >= LONG_TERM else 1

    def _state(self, seen: dict[int, int]) -> int:
        """Number of the state that holds these nodes (with fewest edits), after skipping trie letters."""
        todo = list(seen)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = seen[node] + 1
                if e <= self.most[child] and e < seen.get(child, 99):
                    seen[child] = e
                    todo.append(child)
        key = frozenset(seen.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(seen)
            self.next.append({})
            ends = [(e, self.term_at[n]) for n, e in seen.items() if n in self.term_at and e <= self.edits(self.terms[self.term_at[n]])]
            best = min(ends, default=None)
            self.accept.append((best[1], best[0]) if best else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < out.get(node, 99):
                out[node] = e

        for node, e in self.sets[state].items():
            put(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        to = self._state(out)
        if len(self.next[state]) < 4096:
            self.next[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its allowance, of equals the first."""
        state = self.start
        for c in word:
            if state < 0:
                return None
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
        return self.accept[state] if state >= 0 else None


@dataclass
class Model:
    terms: list[str]
    exact: list[float] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)
    curve: tuple[float, float, float] | None = None

    def score(self, hits: dict[tuple[int, bool, bool], int]) -> float:
        if self.curve is None:
            return NO_MODEL
        top, rest = strength(self, hits)
        return float(1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * top + self.curve[2] * rest))))


def strength(model: Model, hits: dict[tuple[int, bool, bool], int]) -> tuple[float, float]:
    """Weight of the strongest hit, and the damped sum of all."""
    w = [((model.fuzzy if wrong else model.exact)[t] * (QUOTED if quoted else 1.0), n) for (t, wrong, quoted), n in hits.items()]
    return (max(x for x, _ in w), float(np.log1p(sum(x * n for x, n in w)))) if w else (0.0, 0.0)


def quoted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, lo: int, hi: int) -> bool:
    """Whether word i (of a document with words lo to hi) stands in quotation marks or beside a reporting word."""
    a, b = max(lo, i - CONTEXT), min(hi, i + CONTEXT + 1)
    if any(data[starts[j] : ends[j]].tobytes() in REPORTING for j in (*range(max(lo, i - 2), i), *range(i + 1, min(hi, i + 3)))):
        return True
    before = data[starts[a] : starts[i]].tobytes().decode("utf-8", "replace")
    after = data[ends[i] : ends[b - 1]].tobytes().decode("utf-8", "replace")
    if i + 1 == b:  # the document's last word: what closes the quotation may follow it
        after = data[ends[i] : ends[i] + 4].tobytes().decode("utf-8", "replace")
    opened = before.count('"') % 2 == 1 and '"' in after
    return opened or any(before.rfind(x) > before.rfind(y) and y in after for x, y in (("“", "”"), ("„", "“"), ("«", "»")))


def document_hits(automaton: Automaton, hasher: W.Hasher, raw: np.ndarray, bounds: np.ndarray) -> list[Counter]:
    """Per document: hits counted by (term, misspelled, quoted)."""
    data = W.LOWER[raw]
    marks = np.flatnonzero(data >= 0x80)
    words = W.ALNUM
    if len(marks) and b"\xe2\x80" in (blob := data.tobytes()) or len(marks) and b"\xc2" in blob:
        # typographic quotation marks are no letters: blank them for the cut, but not for the context
        cutting = np.frombuffer(_blank(blob), np.uint8)
    else:
        cutting = data
    starts, ends, first = W.spans(cutting, bounds, words)
    out = [Counter() for _ in range(len(bounds) - 1)]
    if not len(starts) or automaton.start < 0:
        return out
    _, index, inverse = np.unique(hasher.words(cutting, starts, ends), return_index=True, return_inverse=True)
    found = {}
    for u, at in enumerate(index.tolist()):
        m = automaton.match(cutting[starts[at] : ends[at]].tobytes().decode("utf-8", "replace"))
        if m is not None:
            found[u] = m
    if found:
        is_hit = np.zeros(len(index), bool)
        is_hit[list(found)] = True
        for i in np.flatnonzero(is_hit[inverse]).tolist():
            d = int(np.searchsorted(first, i, "right")) - 1
            t, e = found[int(inverse[i])]
            out[d][(t, e > 0, quoted(data, starts, ends, i, int(first[d]), int(first[d + 1])))] += 1
    return out


def _blank(blob: bytes) -> bytes:
    for x in _QUOTES[1:]:
        b = x.encode()
        blob = blob.replace(b, b" " * len(b))
    return blob


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, hasher = Automaton(model.terms), W.Hasher()
        for rows, data, bounds in W.slices(batches):
            hits = document_hits(automaton, hasher, data, bounds)
            yield pa.record_batch(
                [rows.column(0), pa.array([model.score(h) for h in hits], pa.float64()), pa.array([sum(h.values()) for h in hits], pa.int64())],
                names=["doc_id", "score", "n_terms"],
            )

    return run


def _hits_of_sample(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, hasher = Automaton(terms), W.Hasher()
        for rows, data, bounds in W.slices(batches):
            hits = document_hits(automaton, hasher, data, bounds)
            keys = [[[t, int(w), int(q), n] for (t, w, q), n in h.items()] for h in hits]
            yield pa.record_batch([rows.column(1), pa.array(keys, pa.list_(pa.list_(pa.int64())))], names=["toxic", "hits"])

    return run


def _words_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, bounds in W.slices(batches):
        data = np.frombuffer(_blank(W.LOWER[raw].tobytes()), np.uint8)
        starts, ends, first = W.spans(data, bounds, W.ALNUM)
        toxic = rows.column(1).to_pylist()
        word, left, label = [], [], []
        for d in range(len(bounds) - 1):
            own = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in range(first[d], first[d + 1])]
            seen = {(w, before) for before, w in zip(["", *own[:-1]], own, strict=True) if len(w) >= MIN_TERM}
            word += [w for w, _ in seen]
            left += [x for _, x in seen]
            label += [toxic[d]] * len(seen)
        yield pa.record_batch([pa.array(word, pa.string()), pa.array(left, pa.string()), pa.array(label, pa.int32())], names=["word", "before", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn lexicon, weights and curve from the rows that are not held out."""
    ship_package(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model([])
    pick = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    share = F.when(F.col("toxic") == 1, sample / counts[1]).otherwise(sample / counts[0])
    picked = known.where(pick < share).limit(4 * sample)  # bounded: about 2 * sample rows
    rows = (
        docs.where("text is not null")
        .join(F.broadcast(picked.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))
        .groupBy(F.sha2("text", 256))  # copies of a text count once
        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )
    lexicon = (
        rows.mapInArrow(_words_of_sample, "word string, before string, toxic int")
        .distinct()
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        .where((F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * F.col("n")))
    )
    terms = sorted(r["word"] for r in lexicon.collect())  # at most the sample's words / SUPPORT
    found = [(r["toxic"], {(t, bool(w), bool(q)): n for t, w, q, n in r["hits"]}) for r in rows.mapInArrow(_hits_of_sample(terms), "toxic int, hits array<array<long>>").collect()]
    return learn(terms, found)


def learn(terms: list[str], found: list[tuple[int, dict]]) -> Model:
    """Weights by smoothed log-odds of presence, then a logistic curve by gradient steps."""
    size = [sum(1 for y, _ in found if y == k) for k in (0, 1)]
    if not terms or not all(size):
        return Model(terms)
    n = np.zeros((2, 2, len(terms)))  # misspelled, label, term
    for y, hits in found:
        for t, wrong in {(t, w) for t, w, _ in hits}:
            n[int(wrong), y, t] += 1
    odds = np.log((n[:, 1] + 0.5) / (size[1] + 1)) - np.log((n[:, 0] + 0.5) / (size[0] + 1))
    exact = np.maximum(odds[0], 0)
    # a misspelling that no clean text of the sample holds is trusted half as much as its term
    fuzzy = np.where(n[1, 0] == 0, np.maximum(odds[1], exact / 2), np.maximum(odds[1], 0))
    model = Model(terms, exact.tolist(), fuzzy.tolist())
    x = np.array([(1.0, *strength(model, h)) for _, h in found])
    y = np.array([y for y, _ in found], float)
    w = np.array([-2.0, 1.0, 0.1])
    for _ in range(400):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.01 * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(3), grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return Model(terms, model.exact, model.fuzzy, tuple(w.tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_terms (hits, misspelled ones included)."""
    ship_package(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_score(model), "doc_id long, score double, n_terms long")
