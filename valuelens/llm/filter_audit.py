"""Filter interaction audit: what each of five filters removes in every order, with exact duplicates by radix tries.

Texts go to ranges cut by adaptive text prefixes: separators are as long as neighbouring
texts of a hash sample need to differ, so a header that many texts share is cut behind it.
Inside a task texts are inserted whole into compressed tries whose terminals hold
the least ids and counts of their groups.  A map task does so first, so a text that a
third of all rows hold reaches the shuffle once per slice; then a range's texts, sorted, are
inserted in blocks of about ``BLOCK_BYTES`` that end between different texts.  Traversing
a trie gives each row's duplicate flag: its id is larger than its terminal's least one.
The other filters' failures depend on the text alone and are found once per distinct
text of a slice.  What remains is a count per (part, labels, failure mask), and all 120
orders are sums over at most 32 masks of a part.

Scale: texts move once (twice if there are too many labels to broadcast).  The sample only
places the separators; any placing gives the same rows, and a task's memory is a block
and the longest text, however uneven the ranges are.

Cases: null text is the empty text; null lang is part ''; a row with a null doc_id is never
a duplicate and makes none; rows that share id and text are no duplicates of
each other; of several label rows of an id a 1 counts; null labels are 0; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
MAX_BROADCAST_LABELS = 1_000_000
#: depths in characters at which sampled texts are compared, and the bytes of a sample that the driver takes
DEPTHS, SAMPLE_BYTES, RANGES_PER_PARTITION = (256, 4096, 65536), 16 << 20, 4
_UPPER = bytes(range(0x41, 0x5B))
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_SYMBOL = re.compile(rb"[#$%&*|]")
_DUPLICATE = 16
_GROUP = pa.struct([("part", pa.string()), ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("n_least", pa.int64())])


class Node:
    """A trie node: the label of its incoming edge, its children by first byte, and what its text holds (terminals only)."""

    __slots__ = ("children", "held", "label")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.held = label, {}, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie over whole texts."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, text: bytes) -> Node:
        """The terminal of ``text``, made if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
            elif not text.startswith(child.label, at):
                k = _common(child.label, text, at)
                above = node.children[text[at]] = Node(child.label[:k])
                child.label = child.label[k:]
                above.children[child.label[0]] = child
                child = above
            node, at = child, at + len(child.label)
        if node.held is None:
            node.held = {}
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """(text, node) of all inserted texts."""
        stack = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            text = above + node.label
            if node.held is not None:
                yield text, node
            stack += [(text, c) for c in node.children.values()]

    def held(self) -> Iterator[Node]:
        """Terminal nodes without their texts."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.held is not None:
                yield node
            stack += node.children.values()


def add(held: dict, group: tuple, n: int, least: int | None, n_least: int) -> None:
    """Add n rows to a group of a terminal: with the least id and how many rows have it."""
    had = held.get(group)
    if had is None:
        held[group] = [n, least, n_least]
        return
    had[0] += n
    if least is not None:
        if had[1] is None or least < had[1]:
            had[1], had[2] = least, n_least
        elif least == had[1]:
            had[2] += n_least


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: cut at the six ASCII spaces
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | (_SYMBOL.search(text) is not None) << 3


def separators(heads: list[tuple[bytes, int]], ranges: int) -> list[bytes]:
    """Least prefixes that start the ranges 1, 2, ...: about equal weights lie between them."""
    heads = sorted(heads)
    step = sum(w for _, w in heads) / ranges
    out: list[bytes] = []
    total, due = 0, step
    for (a, w), (b, _) in zip(heads, heads[1:], strict=False):
        total += w
        if total >= due and a != b:
            out.append(b[: _common(a, b, 0) + 1])
            due = (total // step + 1) * step
    return out


def ranges_of(texts: DataFrame) -> list[bytes]:
    """Separators from a hash sample of the distinct texts, compared as deep as it takes to balance the ranges."""
    spark = texts.sparkSession
    rows = texts.count()
    wanted = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    best: list[bytes] = []
    for depth in DEPTHS:
        every = max(1, -(-rows * depth // SAMPLE_BYTES))  # so the sample has SAMPLE_BYTES at most, about
        head = F.substring("text", 1, depth).cast("binary")
        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(head.alias("head"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("w"))
        heads = [(bytes(r["head"]), r["w"] + 1) for r in some.distinct().collect()]
        ranges = max(1, min(wanted, len(heads) // 4))
        found = separators(heads, ranges)
        best = max(best, found, key=len)
        weight: dict[bytes, int] = {}
        for h, w in heads:
            weight[h] = weight.get(h, 0) + w
        alone = max((w for _, w in heads), default=0)
        if not heads or max(weight.values()) <= max(2 * sum(weight.values()) / ranges, alone):
            break
    return best


def _slice_rows(batches: Iterator[pa.RecordBatch], bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(range_id, text, mask, groups): the terminals of a slice's trie."""
    for rows, data, at in W.slices(batches, limit=SLICE_BYTES):
        trie, raw, ends = Trie(), data.tobytes(), at.tolist()
        ids, parts, good, toxic = (rows.column(c).to_pylist() for c in ("doc_id", "part", "good", "toxic"))
        for k, i in enumerate(ids):
            add(trie.insert(raw[ends[k] : ends[k + 1]]).held, (parts[k], good[k], toxic[k], i is not None), 1, i, int(i is not None))
        texts, groups = [], []
        for text, node in trie.terminals():
            texts.append(text)
            groups.append([dict(zip(("part", "good", "toxic", "n", "least", "n_least"), (*g[:3], *v), strict=True)) for g, v in node.held.items()])
        yield pa.record_batch(
            [
                pa.array([bisect_right(bounds, t) for t in texts], pa.int32()),
                pa.array(texts, pa.binary()),
                pa.array([text_mask(t) for t in texts], pa.int32()),
                pa.array(groups, pa.list_(_GROUP)),
            ],
            names=["range_id", "text", "mask", "groups"],
        )


def _reduce(trie: Trie, counts: dict) -> None:
    """Rows of each (part, good, toxic, mask) of a finished trie, the duplicate's bit included."""
    for node in trie.held():
        mask, held = node.held.pop("mask"), node.held
        least = min((v[1] for v in held.values() if v[1] is not None), default=None)
        for (part, good, toxic, known), (n, own, n_least) in held.items():
            first = n if not known else n_least if own == least else 0
            for m, rows in ((mask, first), (mask | _DUPLICATE, n - first)):
                if rows:
                    key = (part, good, toxic, m)
                    counts[key] = counts.get(key, 0) + rows


def _counted(counts: dict) -> pa.RecordBatch:
    keys = list(counts)
    part, good, toxic, mask = ([k[c] for k in keys] for c in range(4))
    return pa.record_batch(
        [pa.array(part, pa.string()), pa.array(good, pa.int32()), pa.array(toxic, pa.int32()), pa.array(mask, pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
        names=["part", "good", "toxic", "mask", "n"],
    )


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the masks of sorted texts; equal texts follow each other and never fall in two tries."""
    trie, size, last, counts = Trie(), 0, None, {}
    for b in batches:
        groups = b.column(3).to_pylist()
        for text, mask, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), groups, strict=True):
            if size > BLOCK_BYTES and text != last:
                _reduce(trie, counts)
                trie, size = Trie(), 0
                if len(counts) > 100_000:
                    yield _counted(counts)
                    counts = {}
            held = trie.insert(text).held
            held["mask"] = mask
            for g in own:
                # rows without an id are groups of their own: none of them is a duplicate
                add(held, (g["part"], g["good"], g["toxic"], g["least"] is not None), g["n"], g["least"], g["n_least"])
            size += len(text) * (text != last) + 64
            last = text
    _reduce(trie, counts)
    yield _counted(counts)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: documents by the filters they fail."""
    ship_package(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    )
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("l_id"))
        .agg(*(F.max(F.coalesce((F.col(f) == 1).cast("int"), F.lit(0))).alias(t) for f, t in (("quality", "good"), ("toxic", "toxic"))))
    )
    few = labels.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS
    known = texts.join(F.broadcast(marks) if few else marks.hint("shuffle_hash"), F.col("doc_id") == F.col("l_id"), "left").select(
        "doc_id", "text", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    bounds = ranges_of(texts.select("text"))
    found = known.mapInArrow(
        lambda b: _slice_rows(b, bounds), "range_id int, text binary, mask int, groups array<struct<part string, good int, toxic int, n long, least long, n_least long>>"
    )
    counted = found.repartition("range_id").sortWithinPartitions("range_id", "text").mapInArrow(_range_rows, "part string, good int, toxic int, mask int, n long")
    return counted.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of all 120 orders from (part, good, toxic, mask, n)."""
    bit = lambda letter: F.pow(F.lit(2), F.ascii(letter) - 65).cast("int")
    masks = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    letters = F.split("filter_order", "")
    steps = (
        masks.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
        .withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
        .withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("bit", bit(F.col("letter")))
        .withColumn("before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit(x)))
    )
    fails, alive = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    some = lambda value, when: F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        some("n", alive & ~fails).alias("kept"),
        some("n", alive & fails).alias("removed"),
        some("n", ~alive & fails).alias("redundant"),
        some("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        some("good", alive & fails).alias("good_lost"),
        some("toxic", alive & fails).alias("toxic_lost"),
    )
    shapley = out.groupBy(F.col("part").alias("s_part"), F.col("letter").alias("s_letter")).agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, (F.col("part") == F.col("s_part")) & (F.col("letter") == F.col("s_letter"))).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see ``report``."""
    return report(cut(mask_counts(docs, labels), "masks"))
