"""Substring dedup by recompression: repeated windows of ``WINDOW`` words.

Names.  Runs of a token, then for ``ROUNDS`` rounds pairs, get names that are hashes of what
they stand for, so all tasks give equal strings equal names without a naming shuffle.  In a
round every name is a left or a right one (a bit of its hash), and each left one followed
by a right one becomes a pair.  What a symbol depends on is tracked as a word range; two
equal strings hold the same symbols wherever that range lies inside them.

Anchors.  Of the symbols whose range lies inside a window, the one of least hash is its
anchor; equal windows have equal anchors at equal places.  Consecutive windows with one
anchor form an occurrence, identified by the 128-bit hash of all its words.  A window
without such a symbol is its own anchor, so nothing escapes.

Spark.  Occurrences meet by anchor name (one shuffle; a task sends one row per name and
batch, so a passage that a third of all documents share reaches the shuffle once per
batch).  Equal occurrences are repeats throughout; a name with one occurrence is unique;
occurrences that share a name but not all words send their single windows to a second,
much smaller meeting by 128-bit window hash.  Repeats come back as ranges per text and
are cut from the documents, joined by text hash; the planner may split a hot text.  Texts
with open occurrences are found by broadcast where a count proves the list small.

Cases: null and short texts lose nothing; rows with equal texts lose the same words (and
all, from 35 words on); repeated ids do not matter, as texts are what meets; an empty
table gives none; other columns pass through as one struct if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package

WINDOW, ROUNDS = 35, 5
MAX_BROADCAST_PLACES = 3_000_000
# kinds of rows
ASK, TELL, SETTLED, OPEN, REP = 0, 1, 2, 3, 4
ROW = "name long, e1 long, e2 long, k1 long, k2 long, at long"
_SEEDS = W.mix(np.arange(31, 40, dtype=np.uint64))
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_FAR = 1 << 60


class Ranges:
    """128-bit hashes of word ranges of a batch."""

    def __init__(self, h: np.ndarray) -> None:
        self.sums, self.undo = [], []
        with np.errstate(over="ignore"):
            for base, seed in zip(_BASE, _SEEDS[:2], strict=True):
                power = np.concatenate([[np.uint64(1)], np.full(len(h), base, np.uint64)]).cumprod(dtype=np.uint64)
                self.undo.append(np.concatenate([[np.uint64(1)], np.full(len(h), W._inverse(int(base)), np.uint64)]).cumprod(dtype=np.uint64))
                self.sums.append(np.concatenate([[np.uint64(0)], (W.mix(h ^ seed) * power[:-1]).cumsum(dtype=np.uint64)]))

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return tuple(W.mix((s[b] - s[a]) * u[a] + (b - a).astype(np.uint64)) for s, u in zip(self.sums, self.undo, strict=True))


def symbols(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the symbols after the rounds; [low, high) is the word range each depends on.

    A symbol that depends on the document's edge reaches beyond it and lies in no window.
    """
    n = len(h)
    with np.errstate(over="ignore"):
        # runs of one token
        head = np.ones(n, bool)
        head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        times = np.diff(np.append(at, n))
        name = np.where(times > 1, W.mix(h[at] * np.uint64(5) + times.astype(np.uint64) * _SEEDS[2]), h[at])
        d = doc[at]
        # that a run ends is known from the token beyond it
        low, high = at - 1, at + times + 1
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = d[1:] != d[:-1]
        low[edge[:-1]] = -_FAR
        high[edge[1:]] = _FAR
        for r in range(rounds):
            left = (W.mix(name ^ (_SEEDS[3] + np.uint64(r))) & np.uint64(1)).astype(bool)
            m = len(name)
            same = d[1:] == d[:-1]
            pair = np.zeros(m, bool)  # first of a pair
            pair[:-1] = left[:-1] & ~left[1:] & same
            second = np.zeros(m, bool)
            second[1:] = pair[:-1]
            lo, hi = low.copy(), high.copy()
            lo[second] = hi[pair] = 0  # overwritten below
            # alone: a left symbol was followed by a left one, a right symbol came after a right one
            alone = ~pair & ~second
            nxt, prv = np.full(m, _FAR), np.full(m, -_FAR)
            nxt[:-1][same] = high[1:][same]
            prv[1:][same] = low[:-1][same]
            hi = np.where(alone & left, np.maximum(high, nxt), high)
            lo = np.where(alone & ~left, np.minimum(low, prv), low)
            first = np.flatnonzero(pair)
            joined = name.copy()
            joined[first] = W.mix(name[first] * np.uint64(3) + W.mix(name[first + 1] ^ _SEEDS[4]))
            hi[first] = high[first + 1]
            keep = ~second
            name, low, high, d = joined[keep], lo[keep], hi[keep], d[keep]
    return name, low, high


def occurrences(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, name, first start, last start, e1, e2) of the occurrences of all windows of a batch."""
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    none = np.empty(0, np.int64)
    starts = np.zeros(n, bool)
    if n >= WINDOW:
        starts[: n - WINDOW + 1] = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    if not starts.any():
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint64)
    name, low, high = symbols(h, doc)
    use = high - low <= WINDOW
    name, low, high = name[use], low[use], high[use]
    ranges = Ranges(h)
    # known by all the words it depends on, a symbol is rarely shared by chance
    name = W.mix(name ^ ranges.of(low, high)[0])
    # least hash first, of equal ones the leftmost
    bits = np.uint64(max(1, len(name).bit_length()))
    key = ((W.mix(name ^ _SEEDS[5]) >> bits) << bits) | np.arange(len(name), dtype=np.uint64)
    a = np.maximum(high - WINDOW, 0)
    count = low - a + 1
    best = np.full(n, np.uint64(2**64 - 1))
    which = np.repeat(np.arange(len(name)), count)
    p = np.arange(len(which)) - np.repeat(count.cumsum() - count, count) + a[which]
    np.minimum.at(best, p, key[which])
    at = np.flatnonzero(starts)
    found = best[at] != np.uint64(2**64 - 1)
    anchor = np.where(found, (best[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), -1)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (anchor[1:] < 0) | (doc[at[1:]] != doc[at[:-1]])
    heads = np.flatnonzero(new)
    lo, hi = at[heads], at[np.append(heads[1:], len(at)) - 1]
    e1, e2 = ranges.of(lo, hi + WINDOW)
    got = anchor[heads] >= 0
    own = np.where(got, name[np.maximum(anchor[heads], 0)] if len(name) else np.uint64(0), W.mix(e1 ^ _SEEDS[6]))
    return doc[lo], own, lo, hi, e1, e2


def _pack(lo: np.ndarray, hi: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    return (lo << 10) | ((hi - lo) << 3) | kind


def _i(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of whole texts: what is settled within a batch, and one row per name for the shuffle."""
    hasher = W.Hasher()
    for rows, data, bounds in W.slices(batches):
        starts, ends, first = W.spans(data, bounds, W.PLAIN)
        h = hasher.words(data, starts, ends)
        doc, name, lo, hi, e1, e2 = occurrences(h, first)
        lo, hi = lo - first[doc], hi - first[doc]
        k = [rows.column(rows.schema.get_field_index(c)).to_numpy()[doc] for c in ("k1", "k2")]
        order = np.lexsort((e2, e1, name))
        name, e1, e2, lo, hi, k1, k2 = (x[order] for x in (name, e1, e2, lo, hi, *k))
        m = len(name)
        new_name, new_e = np.ones(m, bool), np.ones(m, bool)
        new_name[1:] = name[1:] != name[:-1]
        new_e[1:] = new_name[1:] | (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
        e_at, n_at = np.flatnonzero(new_e), np.flatnonzero(new_name)
        e_size = np.diff(np.append(e_at, m))
        e_of, n_of = np.cumsum(new_e) - 1, np.cumsum(new_name) - 1
        kinds = np.bincount(n_of[e_at], minlength=len(n_at)) if m else np.empty(0, np.int64)  # different occurrences of a name
        repeated, mixed = e_size[e_of] > 1, kinds[n_of] > 1
        parts = []

        def put(pick: np.ndarray, kind: int, blank: bool = False) -> None:
            at = np.flatnonzero(pick)
            zero = np.zeros(len(at), np.int64)
            e = (zero, zero) if blank else (e1[at], e2[at])
            parts.append([name[at], *e, k1[at], k2[at], _pack(lo[at], hi[at], kind)])

        put(repeated, SETTLED)
        put(~repeated & mixed, OPEN)
        put(new_e & repeated & mixed, REP)
        put(new_e & ~mixed & repeated, TELL)  # known to repeat: tells others
        put(new_e & ~mixed & ~repeated, ASK)
        put(new_name & mixed, TELL, blank=True)
        parts[-1][-1] |= 1 << 9  # a mark of the name alone; spans stay under 64
        yield pa.record_batch([_i(np.concatenate([p[c].view(np.int64) for p in parts])) for c in range(6)], names=["name", "e1", "e2", "k1", "k2", "at"])


def _neighbours(batches: Iterator[pa.RecordBatch], decide) -> Iterator[pa.RecordBatch]:
    """Run ``decide`` on sorted rows with one row of look-behind and look-ahead across batches."""
    before, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.append(x, y) for x, y in zip(held, cols, strict=True)]
        if len(cols[0]) > 1:
            yield decide(before, [c[:-1] for c in cols], [c[-1:] for c in cols])
            before = [c[-2:-1] for c in cols]
        held = [c[-1:].copy() for c in cols]
    if held is not None:
        yield decide(before, held, None)


def _same(before, now, after, columns: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the row before and the row after have equal values."""
    n = len(now[0])
    prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
    inner = np.ones(max(n - 1, 0), bool)
    for c in columns:
        inner &= now[c][1:] == now[c][:-1]
    prev[1:], nxt[:-1] = inner, inner
    if before is not None:
        prev[0] = all(before[c][0] == now[c][0] for c in columns)
    if after is not None:
        nxt[-1] = all(after[c][0] == now[c][-1] for c in columns)
    return prev, nxt


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, e1, e2) to (k1, k2, at) of settled, open and representative occurrences."""

    def decide(before, now, after):
        kind = now[5] & 7
        done = kind >= SETTLED  # only pass
        flag = (now[5] >> 9) & 1 == 1
        name_prev, name_next = _same(before, now, after, (0,))
        e_prev, e_next = _same(before, now, after, (0, 1, 2))
        told = (kind == TELL) & ~flag
        dup = (e_prev | e_next | told) & ~flag
        out = []
        for pick, k in (
            (dup & (kind == ASK), SETTLED),
            (dup & ((name_prev & ~e_prev) | (name_next & ~e_next)), REP),
            (~dup & (name_prev | name_next) & (kind == ASK), OPEN),
        ):
            pick = pick & ~done
            out.append([now[3][pick], now[4][pick], (now[5][pick] & ~np.int64(7)) | k])
        out.append([now[3][done], now[4][done], now[5][done]])
        return pa.record_batch([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["k1", "k2", "at"])

    return _neighbours(batches, decide)


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, k1, k2, at) of each window of open and representative occurrences; combined per batch."""
    hasher = W.Hasher()
    for rows, data, bounds in W.slices(batches):
        starts, ends, first = W.spans(data, bounds, W.PLAIN)
        ranges = Ranges(hasher.words(data, starts, ends))
        spots = rows.column(rows.schema.get_field_index("spots"))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(spots.offsets.to_numpy()))
        at = spots.flatten().to_numpy()
        lo, span, kind = at >> 10, (at >> 3) & 63, at & 7
        which = np.repeat(np.arange(len(at)), span + 1)
        p = lo[which] + np.arange(len(which)) - np.repeat((span + 1).cumsum() - (span + 1), span + 1)
        w1, w2 = ranges.of(p + first[doc[which]], p + first[doc[which]] + WINDOW)
        k1, k2 = (rows.column(rows.schema.get_field_index(c)).to_numpy()[doc[which]] for c in ("k1", "k2"))
        rep = kind[which] == REP
        which = doc[which]
        order = np.lexsort((p, ~rep, w2, w1))
        w1, w2, k1, k2, p, rep = (x[order] for x in (w1, w2, k1, k2, p, rep))
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(group) else np.empty(0, np.int64)
        # a copy of one text may stand in the batch more than once: its open windows count as repeats then, rightly
        known = (size[group] > 1) | rep[np.flatnonzero(new)][group]
        own = which[order]
        parts = []
        for pick, k in ((known & new, TELL), (~known, ASK)):
            parts.append([w1[pick], w2[pick], k1[pick], k2[pick], _pack(p[pick], p[pick], k)])
        # settled windows side by side in a text become one range
        at = np.flatnonzero(known & ~rep)
        at = at[np.lexsort((p[at], own[at]))]
        head = np.ones(len(at), bool)
        head[1:] = (p[at][1:] != p[at][:-1] + 1) | (own[at][1:] != own[at][:-1])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        head |= run % 64 == 0
        lead = at[head]
        span = np.diff(np.append(np.flatnonzero(head), len(at))) - 1
        parts.append([w1[lead], w2[lead], k1[lead], k2[lead], _pack(p[lead], p[lead] + span, SETTLED)])
        yield pa.record_batch([_i(np.concatenate([x[c].view(np.int64) for x in parts])) for c in range(5)], names=["w1", "w2", "k1", "k2", "at"])


def _judge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def decide(before, now, after):
        kind = now[4] & 7
        prev, nxt = _same(before, now, after, (0, 1))
        pick = (kind == SETTLED) | ((kind == ASK) & (prev | nxt))
        return pa.record_batch([pa.array(c) for c in (now[2][pick], now[3][pick], (now[4][pick] & ~np.int64(7)) | SETTLED)], names=["k1", "k2", "at"])

    return _neighbours(batches, decide)


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in W.slices(batches):
        starts, ends, first = W.spans(data, bounds, W.PLAIN)
        n = np.diff(first)
        spots = rows.column(rows.schema.get_field_index("spots"))
        step = np.zeros(len(starts) + 1, np.int64)
        at = spots.flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), pc.list_value_length(spots).fill_null(0).to_numpy())
        lo, span = at >> 10, (at >> 3) & 63
        np.add.at(step, first[doc] + lo, 1)
        np.add.at(step, first[doc] + lo + span + WINDOW, -1)
        gone = step.cumsum()[:-1] > 0
        removed = W.per_doc(gone, first)
        kept, digest = [], []
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            words = data[a:b].tobytes().split()
            if removed[d]:
                g = gone[first[d] : first[d + 1]].tolist()
                words = [w for w, x in zip(words, g, strict=True) if not x]
            text = b" ".join(words)
            kept.append(text)
            digest.append(hashlib.sha256(text).hexdigest())
        keep = [i for i, c in enumerate(rows.schema.names) if c not in ("text", "k1", "k2", "spots")]
        yield pa.record_batch(
            [*(rows.column(i) for i in keep), pa.array(n.astype(np.int64)), pa.array(removed), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*(rows.schema.names[i] for i in keep), "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _per_text(rows: DataFrame) -> DataFrame:
    """One row per text with the list of its places; equal rows of copies are merged before they meet."""
    return rows.distinct().groupBy("k1", "k2").agg(F.collect_list("at").alias("spots"))


def _small_broadcast(spots: DataFrame) -> DataFrame:
    """``spots`` for a broadcast if texts and places together are few, else for a shuffle."""
    size = spots.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spots")), F.lit(0)).alias("s")).first()
    return F.broadcast(spots) if size["n"] + size["s"] <= MAX_BROADCAST_PLACES else spots


def repeated_places(docs: DataFrame) -> DataFrame:
    """(k1, k2, spots): per text hash the packed ranges of window starts that occur anywhere else too."""
    texts = docs.where("text is not null").select("text", "k1", "k2")
    met = texts.mapInArrow(_meet, ROW)
    kind = F.col("at").bitwiseAND(7)
    # rows already settled need no meeting: they are spread, not sent to their name
    to = F.when(kind >= SETTLED, F.xxhash64("k1", "k2", "at")).otherwise(F.col("name"))
    apart = F.when(kind >= SETTLED, F.lit(1)).otherwise(F.lit(0))
    judged = cut(
        met.withColumn("apart", apart).repartition(to).sortWithinPartitions("apart", "name", "e1", "e2").drop("apart").mapInArrow(_judge, "k1 long, k2 long, at long"),
        "occurrences",
    )
    kind = F.col("at").bitwiseAND(7)
    listed = cut(_per_text(judged.where(kind >= OPEN)), "open")
    windows = texts.join(_small_broadcast(listed), ["k1", "k2"]).mapInArrow(_open_windows, "w1 long, w2 long, k1 long, k2 long, at long")
    to = F.when(kind >= SETTLED, F.xxhash64("k1", "k2", "at")).otherwise(F.col("w1"))
    again = windows.repartition(to).sortWithinPartitions("w1", "w2").mapInArrow(_judge_windows, "k1 long, k2 long, at long")
    return cut(_per_text(judged.where(kind == SETTLED).union(again)), "repeats")


def remove_repeats(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text; ``keep_row`` adds the input row as ``kept_row``."""
    ship_package(docs.sparkSession)
    text = F.col("text").cast("string")
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
        *([F.struct("*").alias("kept_row")] if keep_row else []),
    )
    joined = given.join(repeated_places(given), ["k1", "k2"], "left").select("doc_id", *(["kept_row"] if keep_row else []), "text", "spots")
    out = T.StructType([f for f in joined.schema.fields if f.name not in ("text", "spots")] + T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string").fields)
    return joined.mapInArrow(_cut_words, out)
