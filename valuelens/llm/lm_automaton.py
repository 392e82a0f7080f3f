"""Language-model scores from a weighted backoff automaton of byte n-grams.

Text.  A text is the symbol string of its words' bytes, a space after each word, and an end
symbol.  Symbols before its start are begin symbols.

States and arcs.  A state is a seen context of up to ``ORDER - 1`` symbols.  Every seen n-gram is
an arc that carries its log10 probability; a context's failure arc carries its smoothing weight
(Witten-Bell) and leads to the context without its first symbol, in the end to equal shares
of all symbols.  A text is read once from left to right; as the state before a symbol is
its ``ORDER - 1`` predecessors, the states of a whole batch are laid out side by side, and
arcs (by a hash table) and failure arcs (once per distinct n-gram) are followed for all of them at once.  The weights of a state add up
to one, so scores are log10 probabilities over all texts.

Scale.  n-grams are counted per task before the shuffle.  The automaton is broadcast in
blocks of about ``BLOCK_ARCS`` arcs, split by the two symbols before an arc's last; each
block adds its part to scores that are written before the next one, so any number of n-grams is
handled alike and the driver and a Python worker hold one block.  For the
base score a map task turns each batch of texts into token numbers local to that batch and
asks for the counts of its distinct words, with its own training counts.  One shuffle by
word adds them up, one by batch brings them back: what moves is a row per distinct word and
batch, not one per token, and no vocabulary is broadcast.  The commonest word has one row
per batch, of the batch's some 200,000, so no word outweighs a task's share of the rows.

Cases: null text is empty: one token, the end; a null id is not held out; without training
texts all symbols have equal shares; words of any length and bytes are handled; repeated
rows count and score each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package

ORDER, BLOCK_ARCS = 6, 4_000_000
BATCH_BYTES, SLICE_BYTES = 8 << 20, 1 << 19
FLUSH_GRAMS, OUT_ROWS = 1_000_000, 20_000
HASH_BYTES = 1 << 16  # a hasher's tables: 1 MB
SPACE, BEGIN, END, SYMBOLS = 32, 256, 257, 258
ROWS = "kind int, batch long, number int, word binary, n long, doc_id long, held_out boolean, score double, tokens binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol strings of a batch of (lowered) texts side by side, and where each text begins."""
    word = W.PLAIN[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first white space behind a word
    starts = bounds[:-1][bounds[:-1] < len(data)]
    keep[starts] = word[starts]
    kept = np.concatenate([[0], keep.cumsum()])[bounds]
    some = np.flatnonzero(np.diff(bounds))
    bare = np.zeros(len(bounds) - 1, bool)  # texts that end in a word: its space is still missing
    bare[some] = word[bounds[some + 1] - 1]
    more = np.concatenate([[0], (1 + bare).cumsum()])
    begin = kept + more
    out = np.full(int(begin[-1]), SPACE, np.int16)
    out[np.arange(int(kept[-1])) + np.repeat(more[:-1], np.diff(kept))] = np.where(word, data, SPACE)[keep]
    out[begin[1:] - 1] = END
    return out, begin


def grams(s: np.ndarray, text_begin: np.ndarray) -> np.ndarray:
    """Code of the ORDER-gram that ends at each symbol; begin symbols stand before each text."""
    n, pad = len(s), ORDER - 1
    padded = np.full(pad * (len(text_begin) - 1) + n, BEGIN, np.int64)
    place = np.arange(n) + np.repeat(np.arange(1, len(text_begin)) * pad, np.diff(text_begin))
    padded[place] = s
    code = np.zeros(max(0, len(padded) - pad), np.int64)
    for j in range(pad, -1, -1):
        code *= SYMBOLS
        code += padded[pad - j : len(padded) - j]
    return code[place - pad]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ORDER-grams of a task's texts, sent once, or whenever many have come together."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def send() -> pa.RecordBatch:
        code, n = _merge(parts)
        parts.clear()
        return pa.record_batch([pa.array(code), pa.array(n)], names=["code", "n"])

    for _, raw, bounds in W.slices(batches, limit=SLICE_BYTES):
        data = W.LOWER[raw]
        parts.append(np.unique(grams(*symbols(data, bounds)), return_counts=True))
        if sum(len(p[0]) for p in parts) > FLUSH_GRAMS:
            parts[:] = [_merge(parts)]
            if len(parts[0][0]) > FLUSH_GRAMS // 2:
                yield send()
    if parts:
        yield send()


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class Table:
    """Values by code, in the order of their hashes; a directory tells where each prefix of a hash begins.

    A look-up costs a probe or two, not a search, and no space is kept free.
    """

    def __init__(self, code: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, (2 * len(code)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self._slot(code)
        order = np.argsort(slot, kind="stable")
        self.code, self.value = code[order], value[order]
        self.begin = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << bits), out=self.begin[1:])

    def _slot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, value)."""
        slot = self._slot(code)
        at, end = self.begin[slot], self.begin[slot + 1]
        known, value = np.zeros(len(code), bool), np.zeros(len(code))
        todo = np.flatnonzero(at < end)
        while len(todo):
            place = at[todo]
            hit = self.code[place] == code[todo]
            known[todo[hit]] = True
            value[todo[hit]] = self.value[place[hit]]
            todo, place = todo[~hit], place[~hit] + 1
            at[todo] = place
            todo = todo[place < end[todo]]
        return known, value


def block_of(code: np.ndarray, blocks: int) -> np.ndarray:
    """Block of an n-gram: by the two symbols before its last."""
    return code // SYMBOLS % SYMBOLS**2 % blocks


class Automaton:
    """Arcs and failure arcs of one block; ``low`` has the counts of all n-grams of order 2."""

    def __init__(self, code: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], block: int = 0, blocks: int = 1) -> None:
        self.block, self.blocks = block, blocks
        self.arcs: list[tuple[np.ndarray, np.ndarray]] = []  # by order from 1: codes, log10 p
        self.fails: list[tuple[np.ndarray, np.ndarray]] = []  # by order from 1: contexts, log10 weight
        self.full: Table | None = None
        p = np.empty(0)
        for k in range(1, ORDER + 1):
            source, weight = low if k <= 2 else (code, n)
            own, at = np.unique(source % SYMBOLS**k, return_inverse=True)
            count = np.bincount(at, weight, len(own)) if len(own) else np.empty(0)
            context, of, types = np.unique(own // SYMBOLS, return_inverse=True, return_counts=True)
            total = np.bincount(of, count, len(context)) if len(own) else np.empty(0)
            shorter = p[_find(self.arcs[-1][0], own % SYMBOLS ** (k - 1))[0]] if k > 1 and len(own) else 1 / SYMBOLS
            p = (count + types[of] * shorter) / (total + types)[of] if len(own) else np.empty(0)
            self.arcs.append((own, np.log10(p)))
            self.fails.append((context, np.log10(types / (total + types)) if len(own) else np.empty(0)))

    def weights(self, code: np.ndarray) -> np.ndarray:
        """log10 weight of the path from each state (context) over its symbol; 0 for other blocks' arcs.

        After ``table`` only for n-grams that are not in it.
        """
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        if self.blocks > 1:
            todo = np.flatnonzero(block_of(code, self.blocks) == self.block)
            code = code[todo]
        for k in range(ORDER, 0, -1):
            at, arc = _find(self.arcs[k - 1][0], code % SYMBOLS**k)
            out[todo[arc]] += self.arcs[k - 1][1][at[arc]]
            todo, code = todo[~arc], code[~arc]
            if not len(todo):
                return out
            at, known = _find(self.fails[k - 1][0], code % SYMBOLS**k // SYMBOLS)
            out[todo[known]] += self.fails[k - 1][1][at[known]]
        out[todo] -= np.log10(SYMBOLS)  # below the last failure arc: equal shares
        return out

    def table(self) -> Table:
        """The arcs of full order by code: made once per Python worker, and held there alone from then on."""
        if self.full is None:
            self.full = Table(*self.arcs[-1])
            self.arcs[-1] = (np.empty(0, np.int64), np.empty(0))
            W.release()
        return self.full

    def scores(self, data: np.ndarray, bounds: np.ndarray, table: Table) -> np.ndarray:
        """This block's part of the log10 probability of each (lowered) text.

        Arcs of full order are looked up for each symbol; failure arcs are followed once per distinct n-gram.
        """
        s, begin = symbols(data, bounds)
        code = grams(s, begin)
        known, weight = table.find(code)
        rest, at = np.unique(code[~known], return_inverse=True)
        weight[~known] = self.weights(rest)[at]
        sums = np.concatenate([[0.0], weight.cumsum()])
        return sums[begin[1:]] - sums[begin[:-1]]


def _traverse(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        table = automaton.table()
        for rows, raw, bounds in W.slices(batches, limit=SLICE_BYTES):
            part = automaton.scores(W.LOWER[raw], bounds, table)
            yield pa.record_batch([*rows.columns[:3], pa.array(part + rows.column(3).to_numpy())], names=rows.schema.names)

    return run


def _unique_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: W.Hasher, other: W.Hasher) -> tuple[np.ndarray, list[bytes]]:
    """Local number of each word, and the distinct words."""
    _, index, inverse = np.unique(hasher.words(data, starts, ends), return_index=True, return_inverse=True)
    second = other.words(data, starts, ends)
    if (second != second[index][inverse]).any():  # two words share a hash: number them by their bytes
        known: dict[bytes, int] = {}
        numbers = [known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)]
        return np.array(numbers, np.int64), list(known)
    blob = data.tobytes()
    return inverse, [blob[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]


def _number(shared: Broadcast):
    """The last block's traversal, and per batch rows of kind 0 (its distinct words, with training counts) and 1 (its texts as token numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _numbered(shared.value, batches)

    return run


def _numbered(automaton: Automaton, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashers, base = (W.Hasher(span=HASH_BYTES), W.Hasher(2, HASH_BYTES)), TaskContext.get().partitionId() << 24
    for i, (rows, raw, bounds) in enumerate(W.slices(batches, limit=BATCH_BYTES)):
        out = _number_batch(automaton, rows, raw, bounds, hashers, base + i)
        for at in range(0, out.num_rows, OUT_ROWS):
            yield out.slice(at, OUT_ROWS)
        del out  # not held while the next one is made


def _number_batch(automaton: Automaton, rows: pa.RecordBatch, raw: np.ndarray, bounds: np.ndarray, hashers: tuple[W.Hasher, W.Hasher], batch: int) -> pa.RecordBatch:
    table = automaton.table()
    part = np.concatenate([automaton.scores(W.LOWER[r], b, table) for _, r, b in W.slices(iter([rows]), limit=SLICE_BYTES)])
    data = W.LOWER[raw]
    starts, ends, first = W.spans(data, bounds, W.PLAIN)
    number, words = _unique_words(data, starts, ends, *hashers)
    words.append(b"")  # the end of a text
    m, n_docs = len(words), rows.num_rows
    held = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    total = np.bincount(number, minlength=m)
    count = np.bincount(number[~held[doc]], minlength=m)
    count[-1] = int((~held).sum())
    total[-1] = n_docs
    # frequent words get small numbers, which are stored in less space
    order = np.argsort(-total, kind="stable")
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    numbers, end = rank[number].astype("<i4"), np.array([rank[-1]], "<i4").tobytes()
    tokens = [numbers[a:b].tobytes() + end for a, b in zip(first[:-1], first[1:], strict=True)]
    own = [
        (pa.int32(), np.zeros(m, np.int32), np.ones(n_docs, np.int32)),
        (pa.int64(), np.full(m, batch), np.full(n_docs, batch)),
        (pa.int32(), np.arange(m, dtype=np.int32), None),
        (pa.binary(), [words[k] for k in order.tolist()], None),
        (pa.int64(), count[order], None),
        (pa.int64(), None, rows.column(0)),
        (pa.bool_(), None, rows.column(1)),
        (pa.float64(), None, part + rows.column(3).to_numpy()),
        (pa.binary(), None, tokens),
    ]
    columns = []
    for kind, w, d in own:
        left = pa.nulls(m, kind) if w is None else pa.array(w, kind)
        right = pa.nulls(n_docs, kind) if d is None else d.cast(kind) if isinstance(d, pa.Array) else pa.array(d, kind)
        columns.append(pa.concat_arrays([left, right]))
    return pa.record_batch(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def _score(n: int, v: int):
    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        c = np.zeros(words.num_rows)
        c[words.column("number").to_numpy()] = words.column("c").to_numpy()
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        rows = [np.frombuffer(t.as_py(), "<i4") for t in texts.column("tokens")]
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
                "n_known": pa.array([int((c[r] > 0).sum()) for r in rows], pa.int64()),
                "train_tokens": pa.array([n] * len(rows), pa.int64()),
                "base_score": pa.array([float(base[r].sum()) for r in rows], pa.float64()),
                "score": texts.column("score"),
            }
        )

    return run


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = rows.toArrow()
    return t.column("code").to_numpy(), t.column("n").to_numpy()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship_package(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("score"))

    counts = given.where("not held_out").select("text").mapInArrow(_count, "code long, n long")
    arcs = cut(counts.groupBy("code").agg(F.sum("n").alias("n")), "arcs")
    blocks = max(1, -(-arcs.count() // BLOCK_ARCS))
    low = _arrays(arcs.groupBy((F.col("code") % SYMBOLS**2).alias("code")).agg(F.sum("n").alias("n")))  # at most SYMBOLS ** 2 rows
    scored = given
    for k in range(blocks):
        own = arcs.where(F.expr(f"(code div {SYMBOLS}) % {SYMBOLS**2} % {blocks} = {k}"))  # about BLOCK_ARCS rows
        shared = spark.sparkContext.broadcast(Automaton(*_arrays(own), low, k, blocks))
        # what a block gives is written, so that only one block is held at a time
        last = k == blocks - 1
        scored = cut(scored.mapInArrow(_number(shared), ROWS) if last else scored.mapInArrow(_traverse(shared), given.schema), "tokens" if last else "scores")
        shared.destroy()

    numbered = scored  # each kind leaves the other's columns null, which take no space
    asked = numbered.where("kind = 0").select("batch", "number", "word", "n")
    by_word = Window.partitionBy("word")
    counted = cut(
        asked.select("batch", "number", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("batch")) == 1).alias("first")),
        "counts",
    )
    n = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v = counted.where("first and c > 0").count()
    texts = numbered.where("kind = 1").select("batch", "doc_id", "held_out", "score", "tokens")
    return texts.groupBy("batch").cogroup(counted.select("batch", "number", "c").groupBy("batch")).applyInArrow(_score(n, v), SCORES)
