"""Best-fit packing by a configuration linear program over the length histogram.

1. One map tokenizes whole texts into pieces (length, place, checksum of the ids) and
   writes that narrow table.
2. The histogram has one entry per length, at most ``capacity`` of them.  The
   configuration program (choose amounts of patterns so that every length is covered, with
   as few sequences as possible) is solved in fractions by multiplicative weights with knapsack
   pricing, rounded to whole copies, and what is left is packed by best fit.  The weights
   also give a dual solution, so a bound under any packing (``program``).  All of it works on the histogram.
3. A piece's number within its length class picks its slot: a closed form over the pattern
   table gives sequence and offset.  Numbers come from a window over (length, salt) with
   as many salts per length as its share of the rows asks for, plus the counts of the
   salts before, so no length class sits in one task.

Cases: null text is empty and gives one piece with the end id alone; an empty table gives
no rows; repeated rows are packed one by one; null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package

CAPACITY, END_ID = 2048, 0
#: of the program: rounds, cover per round, fall of a weight with its cover, its convexity at first, lengths per
#: group, free places allowed at last, rounds between full pricings
ROUNDS, STEP, RATE, CONVEX, GROUP, SPARE, PRICED = 250, 0.25, 1.0, 0.5, 100, 8, 10
#: parts of the fractional solution that are rounded and tried
SCALES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
CACHE, BATCH, SLICE_BYTES = 600_000, 16_384, 4 << 20
MARK = b"\x1e"
#: words of plain letters: a-z and the letters from U+00C0 to U+00FF
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_TOKENIZER: dict[str, "Chunks"] = {}
_LETTER = np.zeros(256, bool)
_LETTER[0x30:0x3A] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LEADS = np.zeros(256, bool)  # of two-byte characters that are letters, but for the signs C3 97 and C3 B7
_LEADS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True  # none of ' < | >, of which units and special tokens of their own are made


class Chunks:
    """A worker's tokenizer and the ids of the chunks it has seen, at most ``CACHE`` of them."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # words of plain letters are one unit each and have no other form but lower case: for them alone the same merges without rules
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark_id,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.one, self.two, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.begin = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _add(self, chunks: list[bytes]) -> None:
        """Encode chunks together, with a mark between them that has an id of its own; they get the next numbers."""
        plain_word = np.array([_WORD(c) is not None for c in chunks], bool)
        marked = np.array([MARK in c for c in chunks], bool)
        order, ids, sizes = [], [], []
        for which, tokenizer in ((plain_word, self.words), (~plain_word & ~marked, self.tokenizer)):
            places = np.flatnonzero(which).tolist()
            for i in range(0, len(places), BATCH):
                part = places[i : i + BATCH]
                text = (b" " + MARK + b" ").join([chunks[k] for k in part]).decode("utf-8", "replace")
                found = np.array(tokenizer.encode_batch_fast([text.lower() if tokenizer is self.words else text], add_special_tokens=False)[0].ids, "<u4")
                marks = np.flatnonzero(found == self.mark_id)
                if len(marks) != len(part) - 1:
                    raise ValueError("the tokenizer changed a mark")
                order += part
                ids.append(np.delete(found, marks))
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
        for k in np.flatnonzero(marked).tolist():
            order.append(k)
            ids.append(np.array(self.tokenizer.encode(chunks[k].decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4"))
            sizes.append(np.array([len(ids[-1])]))
        # back to the order of the chunks
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        at = np.empty(len(order), np.int64)
        at[order] = size.cumsum() - size
        own = np.empty(len(order), np.int64)
        own[order] = size
        total = own.cumsum()
        self.ids = np.concatenate([self.ids, flat[np.repeat(at - (total - own), own) + np.arange(int(total[-1]))]])
        self.begin = np.concatenate([self.begin, self.begin[-1] + total])

    def find(self, blob: bytes, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers of chunks with distinct, sorted first hashes; seen ones are known by both hashes."""
        if len(self.one) > CACHE:
            self.forget()
        at = np.minimum(np.searchsorted(self.one, one), max(0, len(self.one) - 1))
        known = self.one[at] == one if len(self.one) else np.zeros(len(one), bool)
        if len(self.one) and (self.two[at[known]] != two[known]).any():  # a chunk with the first hash of another one
            self.forget()
            known[:] = False
        out = np.empty(len(one), np.int64)
        out[known] = self.number[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            out[fresh] = len(self.begin) - 1 + np.arange(len(fresh))
            self._add([blob[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
            place = np.searchsorted(self.one, one[fresh])
            self.one, self.two, self.number = (np.insert(a, place, b[fresh]) for a, b in ((self.one, one), (self.two, two), (self.number, out)))
        return out

    def apart(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of chunks told apart by their bytes; they are not kept."""
        self.forget()
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(c, len(known)) for c in chunks], np.int64)
        self._add(list(known))
        return numbers


def tokenizer(path: str) -> Chunks:
    """One per worker process."""
    if path not in _TOKENIZER:
        _TOKENIZER[path] = Chunks(path)
    return _TOKENIZER[path]


def _part(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space put between a word's last letter or digit and the ASCII signs that end it.

    Letters are those of ASCII and of two bytes with the leads ``_LEADS``.  The tokenizer cuts there anyway, so ids stay the same and fewer distinct chunks are left.
    """
    if not len(data):
        return data, bounds
    # a sign counts if only signs follow up to white space or the text's end
    stop = ~_SIGN[data]
    edge = W.SPACES[data]
    last = np.zeros(len(data), bool)
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    # place of the next byte that is no sign, or of the text's last byte
    halt = np.flatnonzero(stop | last)
    nearest = np.append(halt, len(data) - 1)[np.searchsorted(halt, np.flatnonzero(~stop))]
    mark = np.zeros(len(data), bool)
    mark[np.flatnonzero(~stop)] = edge[nearest] | (last[nearest] & ~stop[nearest])
    mark[1:] &= stop[:-1] | last[:-1]  # the first sign of its run
    letter = _LETTER[data[:-1]]
    letter[1:] |= _LEADS[data[:-2]] & (data[1:-1] >= 0x80) & ~((data[:-2] == 0xC3) & ((data[1:-1] == 0x97) | (data[1:-1] == 0xB7)))
    mark[1:] &= letter
    mark[bounds[:-1][bounds[:-1] < len(data)]] = False
    at = np.flatnonzero(mark)
    return np.insert(data, at, 0x20), bounds + np.searchsorted(at, bounds)


def _lowered(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A-Z lowered, as the tokenizer does it too, but for texts in which a combining mark (lead bytes CC, CD) or a special token could change."""
    low = W.LOWER[data]
    odd = (data == 0xCC) | (data == 0xCD)
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    for d in np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1):
        low[bounds[d] : bounds[d + 1]] = data[bounds[d] : bounds[d + 1]]
    return low


def encode(data: np.ndarray, bounds: np.ndarray, chunks: Chunks, hashers: tuple[W.Hasher, W.Hasher]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice side by side, each with ``END_ID`` behind it, and where each begins.

    The tokenizer never joins across ASCII white space, so a text's ids are those of its
    chunks between white space, one after another.  Distinct chunks are told apart by two 64-bit hashes.
    """
    data, bounds = _part(data, bounds)
    data = _lowered(data, bounds)
    starts, ends, first = W.spans(data, bounds, W.PLAIN)
    one, two = (h.words(data, starts, ends) for h in hashers)
    _, index, inverse = np.unique(one, return_index=True, return_inverse=True)
    blob = data.tobytes()
    if (two != two[index][inverse]).any():  # two chunks share a hash: take them by their bytes
        number = chunks.apart([blob[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    else:
        number = chunks.find(blob, starts[index], ends[index], one[index], two[index])[inverse]
    if not len(number):
        return np.full(len(bounds) - 1, END_ID, "<u4"), np.arange(len(bounds))
    source, size = chunks.begin[number], np.diff(chunks.begin)[number]
    docs = len(bounds) - 1
    total = np.concatenate([[0], size.cumsum()])
    begin = total[first] + np.arange(docs + 1)  # an end id for each text before
    out = np.full(int(begin[-1]), END_ID, "<u4")
    place = np.arange(int(total[-1]))
    out[place + np.repeat(np.repeat(np.arange(docs), np.diff(first)), size)] = chunks.ids[np.repeat(source - total[:-1], size) + place]
    return out, begin


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, hashers = tokenizer(path), (W.Hasher(), W.Hasher(2))
        chunks.forget()  # nothing is kept from task to task
        for rows, data, bounds in W.slices(batches, limit=SLICE_BYTES):
            ids, begin = encode(data, bounds, chunks, hashers)
            size = np.diff(begin)
            count = -(-size // capacity)
            which = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(which)) - np.repeat(count.cumsum() - count, count)
            start = piece * capacity
            length = np.minimum(size[which] - start, capacity)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (begin[which] + start)).tolist(), (4 * (begin[which] + start + length)).tolist(), strict=True)]
            yield pa.record_batch(
                [rows.column(0).take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )
        chunks.forget()
        W.release()

    return run


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; a document's ids end with ``END_ID``."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, capacity), PIECES)


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """Indexes (repeats allowed) of the lengths of a pattern of greatest weight: unbounded knapsack."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(lengths, c, "right"))
        if fit:
            value = weights[:fit] + best[c - lengths[:fit]]
            k = int(value.argmax())
            if value[k] > best[c - 1]:
                best[c], take[c] = value[k], k
                continue
        best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
            continue
        out.append(int(take[c]))
        c -= int(lengths[take[c]])
    return out


def bound(histogram: dict[int, int], capacity: int = CAPACITY) -> float:
    """No packing has fewer sequences: a dual solution of the program, the lengths over the best pattern's sum."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n))
    if not len(lengths):
        return 0.0
    best = int(lengths[price(lengths.astype(float), lengths, capacity)].sum())
    return sum(k * n for k, n in histogram.items()) / best


def _price_groups(values: np.ndarray, sizes: np.ndarray, capacity: int, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(taken, fill) for (group, item) arrays: the pattern of most value among each group's fullest (up to ``spare``), an item at most once."""
    groups, items = sizes.shape
    best = np.full((groups, 2 * capacity + 1), -np.inf)  # sums below 0 are out of reach
    best[:, capacity] = 0
    now, flat = best[:, capacity:], best.reshape(-1)
    at = np.arange(groups)[:, None] * (2 * capacity + 1) + capacity + np.arange(capacity + 1)
    better = np.zeros((items, groups, capacity + 1), bool)
    for i in range(items):
        value = flat[at - sizes[:, i : i + 1]] + values[:, i : i + 1]
        better[i] = (value > now) & (sizes[:, i : i + 1] > 0)
        np.copyto(now, value, where=better[i])
    fullest = capacity - np.isfinite(now[:, ::-1]).argmax(1)
    fill = np.where(np.arange(capacity + 1) >= (fullest - spare)[:, None], now, -np.inf).argmax(1)
    c, taken = fill.copy(), np.zeros((groups, items), bool)
    for i in range(items - 1, -1, -1):
        taken[:, i] = better[i][np.arange(groups), c]
        c -= np.where(taken[:, i], sizes[:, i], 0)
    return taken, fill


class Program(NamedTuple):
    """A fractional solution of the configuration program, and a bound that no packing is below."""

    lengths: np.ndarray
    demand: np.ndarray
    shares: list[tuple[float, np.ndarray, np.ndarray]]  # (amount, indexes of lengths, times)
    cover: np.ndarray  # per length, the part of its demand in the shares
    bound: float


def program(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Program:
    """Cover every length by fractions of patterns: multiplicative weights, priced by knapsack dynamic programs.

    A length's weight starts convex in the length and falls exponentially with its cover.  Each round
    deals the lengths that are not covered (twice where two fit a sequence) to groups at random and prices
    all groups at once: the pattern of most weight that leaves at most ``spare`` places free, none at first
    and a few where that finds little.  Of each it takes what covers ``STEP`` of a length at most, one copy at
    least, and never more than is uncovered.  Every ``PRICED`` rounds the best pattern of all
    lengths is priced, which makes the weights a dual solution and so a bound.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), np.int64)
    demand = np.array([histogram[int(k)] for k in lengths], float)
    cover, shares, best = np.zeros(len(lengths)), [], bound(histogram, capacity)
    order, spare = np.random.default_rng(0), 0
    for r in range(rounds):
        left = demand * (1 - cover)
        on = np.flatnonzero(left > 1e-6)
        if not len(on):
            break
        weight = (lengths / capacity) ** (1 + CONVEX) * np.exp(-RATE * (cover - cover.mean()))
        if r % PRICED == 0:
            dual = lengths / capacity * np.exp(-RATE * (cover - cover.mean()))
            whole = dual[price(dual, lengths, capacity)].sum()
            best = max(best, float((dual * demand).sum() / whole) + histogram.get(capacity, 0))
        item = np.concatenate([on, on[(2 * lengths[on] <= capacity) & (left[on] >= 2)]])
        dealt = np.array_split(order.permutation(item), max(1, len(item) // GROUP))
        at = np.full((len(dealt), max(map(len, dealt))), -1)
        for g, own in enumerate(dealt):
            at[g, : len(own)] = own
        value, sizes = (np.where(at >= 0, v[at], 0) for v in (weight, lengths))
        taken, fill = _price_groups(value, sizes, capacity, np.full(len(dealt), spare))
        found = 0
        for g in np.flatnonzero(fill >= capacity - spare):
            some, times = np.unique(at[g][taken[g]], return_counts=True)
            amount = float((np.minimum((1 - cover[some]) * demand[some], np.maximum(STEP * demand[some], 1.0)) / times).min())
            if amount > 1e-9:
                shares.append((amount, some, times))
                cover[some] += amount * times / demand[some]
                found += 1
        if found < max(1, len(dealt) // 10):
            if spare >= SPARE:
                break
            spare = max(1, 2 * spare)
    return Program(lengths, demand, shares, cover, best)


def rounded(p: Program, scale: float) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Whole copies of the shares times ``scale``, and the histogram of what they leave.

    Copies are the steps of the running sum of the shares, largest first, so the sum of the copies is that of
    the shares; a copy whose pieces are gone is left out.
    """
    left, out, total, done = p.demand.astype(np.int64), [], 0.0, 0
    for amount, some, times in sorted(p.shares, key=lambda x: -x[0]):
        total += amount * scale
        copies = min(int(total + 1e-9) - done, int((left[some] // times).min()))
        done = int(total + 1e-9)
        if copies > 0:
            left[some] -= copies * times
            out.append((copies, [(int(p.lengths[i]), int(m)) for i, m in zip(some, times, strict=True)]))
    return out, {int(k): int(n) for k, n in zip(p.lengths, left, strict=True) if n}


def best_fit(rest: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """The largest pieces that fit, one pattern and its largest possible number of copies at a time."""
    rest, out = dict(rest), []
    while rest:
        room, pattern = capacity, {}
        for k in sorted(rest, reverse=True):
            m = min(room // k, rest[k])
            if m:
                pattern[k] = m
                room -= m * k
            if not room:
                break
        copies = min(rest[k] // m for k, m in pattern.items())
        out.append((copies, list(pattern.items())))
        for k, m in pattern.items():
            rest[k] -= copies * m
            if not rest[k]:
                del rest[k]
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (copies, [(length, times)...]) that hold every piece exactly once.

    The shares are rounded under several scales, best fit packs what each leaves, and the fewest sequences
    count, of equal ones the largest scale; scale 0 is best fit alone, so there are never more.
    """
    p = program(histogram, capacity)
    tried = []
    for scale in SCALES:
        placed, rest = rounded(p, scale)
        tried.append(placed + best_fit(rest, capacity))
    out = min(tried, key=lambda patterns: sum(n for n, _ in patterns))
    return ([(histogram[capacity], [(capacity, 1)])] if histogram.get(capacity) else []) + out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Rows (length, first number, times, first sequence, offset) sorted by length and first number."""
    rows, seen, sequence = [], {}, 0
    for copies, pattern in patterns:
        offset = 0
        for k, m in pattern:
            rows.append((k, seen.get(k, 0), m, sequence, offset))
            seen[k] = seen.get(k, 0) + copies * m
            offset += k * m
        sequence += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "sequence", "offset"), table.T.copy(), strict=True)) | {"key": (table[:, 0] << 48) | table[:, 1]}


def _place(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(table["key"], (length << 48) | number, "right") - 1
            k = number - table["first"][at]
            m = table["times"][at]
            yield pa.record_batch(
                [*b.columns[:5], pa.array(table["sequence"][at] + k // m), pa.array(table["offset"][at] + (k % m) * length)],
                names=[*b.schema.names[:5], "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 within each sequence)."""
    spark = pieces.sparkSession
    ship_package(spark)
    pieces = cut(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    total = sum(histogram.values())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(1, total // max(1, tasks))
    salts = spark.createDataFrame([(k, -(-n // fair)) for k, n in histogram.items()] or [(0, 1)], "length long, salts long")
    keyed = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts"))
    )
    before = (
        keyed.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        keyed.withColumn("nth", F.row_number().over(within))
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("number"))
    )
    return numbered.mapInArrow(_place(slots(solve(histogram, capacity))), PIECES + ", sequence_id long, offset long")
