"""Benchmark decontamination: suffix arrays of the training text, searched for test suffixes.

Each task cuts its documents into shards (slices of a few MB, never inside a document) and
builds the suffix array of a shard over words: suffixes sorted by their first ``WINDOW``
words.  Every test suffix - from each word of each benchmark item - is binary-searched in
it; equal ranges give the places of each window, and runs of places along one diagonal
give the longest verbatim match and its location.  Words are compared by rank in the
benchmark's vocabulary; words outside it match nothing, so suffixes that start with one
stay out of the array.  Ranks come from 64-bit hashes, so every match is confirmed on the
bytes before it counts.

Scale: one map over the documents per benchmark block, no shuffle.  Blocks are cut so that
each holds about ``BLOCK_BYTES`` of item text; they are what is broadcast.  With one block
the whole work is one pass.

Cases: null or wordless texts have no words and no hits; null or wordless items have no
window; hits of items with a null id count, but such items are not listed; repeated items
count once by id; repeated documents each get a row; empty tables give no rows or no hits;
other columns pass through untouched as one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package

WINDOW = 10  # fixed by the contract
BLOCK_BYTES = 4 << 20
FOUND = "n_words long, n_hit long, hit binary, items array<string>, longest_words long, longest_at long, longest_item string"


class Probe:
    """Test suffixes of some items, ready to be searched in any shard."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        self.ids, self.words, starts = [], [], []
        for name, text in items:
            data = W.LOWER[np.frombuffer(text, np.uint8)]
            s, e, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
            if len(s):
                self.ids.append(name)
                self.words.append([data[a:b].tobytes() for a, b in zip(s, e, strict=True)])
        vocab = sorted({w for ws in self.words for w in ws})
        blob = np.frombuffer(b"".join(vocab), np.uint8)
        ends = np.cumsum([len(w) for w in vocab], dtype=np.int64)
        h = W.Hasher().words(blob, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if vocab else np.empty(0, np.uint64)
        # rank 1.. by hash; equal hashes share a rank, which the confirmation on bytes sorts out
        self.hashes = np.unique(h)
        rank = dict(zip(vocab, (np.searchsorted(self.hashes, h) + 1).tolist(), strict=True))
        self.bits = max(1, len(self.hashes).bit_length())
        self.per = max(1, 63 // self.bits)
        self.keys = -(-WINDOW // self.per)
        ranks = [np.array([rank[w] for w in ws] + [0] * WINDOW, np.uint64) for ws in self.words]
        base = np.cumsum([0] + [len(r) for r in ranks], dtype=np.int64)
        n = np.array([len(ws) for ws in self.words], np.int64)
        count = np.maximum(n - WINDOW, 0) + 1  # suffixes that still hold a window
        item = np.repeat(np.arange(len(n)), count)
        start = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
        need = np.minimum(n, WINDOW)[item] if len(n) else n
        self.at = np.stack([item, start, need], 1).astype(np.int64)
        flat = np.concatenate(ranks) if ranks else np.empty(0, np.uint64)
        rows = flat[(base[item] + start)[:, None] + np.arange(WINDOW)] if len(item) else np.empty((0, WINDOW), np.uint64)
        beyond = np.arange(WINDOW) >= need[:, None]
        self.low = self._join([self._pack(np.where(beyond, np.uint64(0), rows), j) for j in range(self.keys)])
        self.high = self._join([self._pack(np.where(beyond, np.uint64((1 << self.bits) - 1), rows), j) for j in range(self.keys)])

    def _pack(self, rows: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for t in range(self.per):
            c = j * self.per + t
            out = (out << np.uint64(self.bits)) | (rows[:, c] if c < WINDOW else np.uint64(0))
        return out

    def _join(self, keys: list[np.ndarray]) -> np.ndarray:
        """Keys side by side as fixed-width big-endian strings, which compare like the sequences."""
        return np.ascontiguousarray(np.stack(keys, 1).astype(">u8")).view(f"S{8 * self.keys}").ravel() if len(keys[0]) else np.empty(0, f"S{8 * self.keys}")

    def search(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place) of each occurrence; ranks hold a 0 after each document and ``WINDOW`` at the end."""
        at = np.flatnonzero(ranks[: len(ranks) - WINDOW])
        if not len(at) or not len(self.low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = []
        for j in range(self.keys):
            k = np.zeros(len(at), np.uint64)
            for t in range(self.per):
                c = j * self.per + t
                k = (k << np.uint64(self.bits)) | (ranks[at + c] if c < WINDOW else np.uint64(0))
            keys.append(k)
        order = np.lexsort(keys[::-1])
        array = self._join([k[order] for k in keys])
        a, b = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        n = b - a
        which = np.repeat(np.arange(len(n)), n)
        places = np.repeat(a - (n.cumsum() - n), n) + np.arange(n.sum())
        return which, at[order[places]]


def _run(probe: Probe, again: bool, keep: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = W.Hasher()
        for rows, raw, bounds in W.slices(batches):
            data = W.LOWER[raw]
            starts, ends, first = W.spans(data, bounds, W.ALNUM)
            n_docs, n = len(first) - 1, len(starts)
            doc = np.repeat(np.arange(n_docs), np.diff(first))
            slot = np.arange(n) + doc  # one separator after each document
            ranks = np.zeros(n + n_docs + WINDOW, np.uint64)
            if n and len(probe.hashes):
                h = hasher.words(data, starts, ends)
                r = np.searchsorted(probe.hashes, h)
                r[r == len(probe.hashes)] = 0
                ranks[slot] = np.where(probe.hashes[r] == h, r + 1, 0).astype(np.uint64)
            which, place = probe.search(ranks)
            word = np.searchsorted(slot, place)
            item, start, need = probe.at[which].T if len(which) else np.zeros((3, 0), np.int64)
            sure = np.array(
                [
                    all(data[starts[w + t] : ends[w + t]].tobytes() == probe.words[k][i + t] for t in range(m))
                    for w, k, i, m in zip(word.tolist(), item.tolist(), start.tolist(), need.tolist(), strict=True)
                ],
                bool,
            )
            word, item, start, need = word[sure], item[sure], start[sure], need[sure]
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, word, 1)
            np.add.at(step, word + need, -1)
            hit = step.cumsum()[:n] > 0
            # runs along a diagonal of one item: a longer verbatim match
            order = np.lexsort((word, word - start, item, doc[word])) if len(word) else np.empty(0, np.int64)
            w, k, s, m = word[order], item[order], start[order], need[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1] + 1) | (s[1:] != s[:-1] + 1) | (k[1:] != k[:-1]) | (doc[w[1:]] != doc[w[:-1]])
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(w))) - 1 + m[at] if len(w) else np.empty(0, np.int64)
            best: dict[int, tuple[int, int, str | None]] = {}
            items: dict[int, set[str]] = {}
            for d, x, p, name in zip(doc[w[at]].tolist(), length.tolist(), w[at].tolist(), (probe.ids[i] for i in k[at].tolist()), strict=True):
                if d not in best or x > best[d][0]:
                    best[d] = (x, p - int(first[d]), name)
                if name is not None:
                    items.setdefault(d, set()).add(name)
            out: dict[str, list] = {x.split()[0]: [] for x in FOUND.split(", ")}
            old = {c: rows.column(rows.schema.get_field_index(c)) for c in out} if again else {}
            for d in range(n_docs):
                own = hit[first[d] : first[d + 1]]
                top = best.get(d, (0, None, None))
                names = items.get(d, set())
                if again:
                    own = own | np.unpackbits(np.frombuffer(old["hit"][d].as_py(), np.uint8), count=len(own)).astype(bool)
                    names = names | set(old["items"][d].as_py())
                    if (x := old["longest_words"][d].as_py()) >= top[0]:
                        top = (x, old["longest_at"][d].as_py(), old["longest_item"][d].as_py())
                for c, v in zip(out, (len(own), int(own.sum()), b"" if last else np.packbits(own).tobytes(), sorted(names), *top), strict=True):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
            head = [rows.column(i) for i, c in enumerate(rows.schema.names) if c in ("doc_id", "text", "kept_row") and (c != "text" or not last)]
            yield pa.record_batch(
                [*head, *(pa.array(out[c], t) for c, t in zip(out, kinds, strict=True))],
                names=[c for c in rows.schema.names if c in ("doc_id", "text", "kept_row") and (c != "text" or not last)] + list(out),
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, keep_row: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), the longest match, its word place and item.

    ``keep_row`` adds the whole input row as the struct ``kept_row``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"]).distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    out = docs.select(*cols, *([F.struct("*").alias("kept_row")] if keep_row else []))
    fields = [f for f in out.schema.fields]
    found = T.StructType.fromDDL(FOUND).fields
    for b in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        probe = Probe([(r[0], r[1].encode()) for r in part.orderBy("item_id", "text").collect()])  # about block_bytes of text
        last = b == blocks - 1
        schema = T.StructType([f for f in fields if f.name != "text" or not last] + found)
        out = out.mapInArrow(_run(probe, b > 0, keep_row, last), schema)
        if not last:  # written, so that only one block's probe is held at a time
            out = cut(out, "matches")
    return out.drop("hit")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the documents that hold a benchmark window."""
    return matches(docs, benchmark, keep_row=True).where("n_hit = 0").select("kept_row.*")
