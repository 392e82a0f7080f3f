"""N-gram Jaccard join with PartEnum signatures, and its connected components.

A document's set holds the hashes of its distinct shingles; their length and the least
similarity of linked sets are a ``Rule``, from which bands, differences and signatures
follow.  Sets are put in bands of sizes within the similarity of each other; linked sets lie in one band or two
neighbouring ones and differ in at most k elements, k given by the band.  The feature
domain is cut by hash into first-level parts, each into second-level parts; with k
differences some first-level part holds at most ``K2`` of them, so among the subsets of
its ``N2`` second-level parts that leave out ``K2`` one is untouched: each such subset is a
signature, and linked sets share one.  No link is lost.  A signature of no element at all
would tie every set that has it, so it is not sent: a band has ``slack`` more parts than it
takes, so linked sets share more than ``slack`` signatures, and one that is not bare if either set has
at most ``slack`` bare ones.  Only the few sets with more split these by the
elements of their prefix, the least ones by hash, of which linked sets share one too.  The
slack of a band is the one that makes its rows fewest.

Sets that share a signature are candidates.  A sketch of each set, its elements counted
by hash in about a fifth as many bins, bounds the common elements of two sets from above, so it rejects
candidates without loss.  Inside a signature's group the sketches are searched from member to member for
those that still may be linked; what this connects is tied, not pair by pair but along the search, and the
ties' components are the candidate groups.  All links lie inside them.  A group's sets
meet in one task, which verifies candidates on the whole sets of 64-bit shingle hashes and
skips what is already connected; only links that connect come out, at most one per member.
Groups of more than ``BLOCK`` elements are cut into blocks that meet two by two, as far as
their bands are equal or neighbours.  Equal sets are one node from the start, and a node's
number says nothing about its documents' ids.

Scale: signatures travel packed, about ten bytes each and in proportion to the shingles whatever the texts'
lengths, to buckets whose number follows the shingles, so a task sorts a bounded number of them; a set that
many documents have is sent once per slice.  Groups of the same members count once.  Whole sets travel only for candidates
that the sketches leave.

Cases: null text and texts without words have the empty set, linked with nothing; texts of
fewer words than a shingle have one shingle, the whole sequence; rows are linked by their
sets alone, so rows of one id with other texts are documents of their own; a row with a null
doc_id links others like any row, but is never a component's name: without a named
one its component is null; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm import _words as W
from valuelens.llm._shared import cut, ship_package
from valuelens.llm.components import components


class Rule(NamedTuple):
    """Words of a shingle and the similarity ``num / den`` from which sets are linked."""

    shingle: int = 3
    num: int = 9
    den: int = 10


#: the contract of query op5
OP5 = Rule()
N2, K2 = 2, 1
BLOCK = 1_000_000
MAX_BROADCAST_IDS = 1_000_000
_SEEDS = tuple(W.mix(np.arange(11, 16, dtype=np.uint64)))
#: signatures of a bucket, about, and elements per bin of a sketch
BUCKET_ROWS, BIN_ELEMENTS = 1_500_000, 5


def linked(a: np.ndarray, b: np.ndarray, rule: Rule = OP5) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return rule.den * common >= rule.num * (len(a) + len(b) - common)


def document_sets(data: np.ndarray, bounds: np.ndarray, hasher: W.Hasher, rule: Rule = OP5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, bounds, W.PLAIN)
    h = hasher.words(data, starts, ends)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = h[a:b]
        out.append(np.unique(W.windows(own, rule.shingle)) if b - a >= rule.shingle else W.windows(own, b - a) if b > a else own)
    return out


def bands(most: int, rule: Rule = OP5) -> np.ndarray:
    """Upper sizes of the bands that reach ``most``: band i holds sizes above u[i-1] up to u[i]."""
    u = [0]
    while u[-1] < most:
        u.append((u[-1] + 1) * rule.den // rule.num)
    return np.array(u, np.int64)


def differences(upper: np.ndarray, rule: Rule = OP5) -> np.ndarray:
    """Most elements in which a set of at most ``upper`` and a linked one can differ."""
    both = upper + upper * rule.den // rule.num
    return both * (rule.den - rule.num) // (rule.den + rule.num)


def _at_least(k: int, mean: float) -> float:
    """Chance that a Poisson number of this mean is ``k`` or more (normal beyond 200)."""
    if k <= 0:
        return 1.0
    if mean > 200:
        return 0.5 * math.erfc((k - 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for i in range(1, k):
        term *= mean / i
        total += term
    return max(0.0, 1.0 - total)


@lru_cache(maxsize=4096)
def slack(least: int, k: int, rule: Rule) -> int:
    """How many parts more than needed make the rows of a band fewest: its sets have ``least`` elements or more and ``k`` differences."""
    prefix = least - -(-rule.num * least // rule.den) + 1

    def rows(extra: int) -> float:
        cells = N2 * (k // (K2 + 1) + 1 + extra)
        bare = cells * math.exp(-least / cells)
        return cells + prefix * bare * _at_least(extra, bare)

    best, step = 0, 1
    while step <= k + 8:  # a grid that grows by an eighth
        if rows(step) < rows(best):
            best = step
        step += 1 + step // 8
    return best


def signatures(sets: list[np.ndarray], rule: Rule = OP5) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set index) of all sets; equal sets need none and sizes with k = 0 have none."""
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    u = bands(int(size.max()), rule)
    band = np.searchsorted(u, size)  # band 0: empty
    values = np.concatenate(sets)
    begin = np.cumsum(size) - size
    prefix = size + (-rule.num * size) // rule.den + 1  # linked sets share one of their so many least elements
    owner = np.repeat(np.arange(len(sets)), size)
    place, weight = W.mix(values ^ _SEEDS[2]), W.mix(values ^ _SEEDS[3])
    low, high = (weight & np.uint64(0xFFFFFFFF)).astype(np.float64), (weight >> np.uint64(32)).astype(np.float64)
    sig, who = [], []
    for below in (0, 1):
        key = band - below
        k = np.where(key > 0, differences(u[np.maximum(key, 0)], rule), 0)
        use = (size > 0) & (key > 0) & (k > 0) & ((below == 0) | (rule.num * size <= rule.den * u[np.maximum(key, 0)]))
        spare = np.zeros(len(size), np.int64)
        for b in np.unique(key[use]).tolist():
            spare[key == b] = slack(int(u[b - 1]) + 1, int(differences(u[b], rule)), rule)
        n1 = np.where(use, k // (K2 + 1) + 1 + spare, 0)
        base = np.concatenate([[0], np.cumsum(n1 * N2)])
        on = use[owner]
        d = owner[on]
        cell = base[d] + (place[on] % (n1[d] * N2).astype(np.uint64)).astype(np.int64)
        sums = [np.bincount(cell, w[on], base[-1]) for w in (low, high)]
        filled = np.bincount(cell, minlength=base[-1]).reshape(-1, N2)
        empty = np.bincount(np.repeat(np.arange(len(sets)), n1), (filled == 0).sum(axis=1), len(sets))
        beyond = empty * math.comb(N2 - 1, N2 - K2 - 1) > spare  # bare signatures are at most so many
        with np.errstate(over="ignore"):
            digest = W.mix(sums[0].astype(np.uint64) + (sums[1].astype(np.uint64) << np.uint64(32)) + _SEEDS[4])
            digest = digest.reshape(-1, N2)  # first-level part x second-level part
            part_owner = np.repeat(np.arange(len(sets)), n1)
            part = np.arange(len(part_owner)) - (base[:-1] // N2)[part_owner]
            for s, subset in enumerate(combinations(range(N2), N2 - K2)):
                x = W.mix(key[part_owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (part * 64 + s).astype(np.uint64))
                for c in subset:
                    x = W.mix(x * np.uint64(3) + digest[:, c])
                some = filled[:, subset].any(axis=1)
                sig.append(x[some])
                who.append(part_owner[some])
                split = ~some & beyond[part_owner]
                bare = part_owner[split]
                n = prefix[bare]
                at = np.repeat(begin[bare] - (n.cumsum() - n), n) + np.arange(int(n.sum()))
                sig.append(W.mix(np.repeat(x[split], n) ^ values[at]))
                who.append(np.repeat(bare, n))
    return np.concatenate(sig), np.concatenate(who)


def _digests(sets: list[np.ndarray], seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([W.mix(s ^ _SEEDS[seed]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's elements by their leading bits, in a power of two of bins; no count is above 255."""
    bits = max(3, (len(s) // BIN_ELEMENTS).bit_length())
    h = W.mix(s ^ _SEEDS[4])
    while True:
        count = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if count.max() < 256:
            return count.astype(np.uint8).tobytes()
        bits += 1


def _sizes(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    hasher = W.Hasher()
    for rows, data, bounds in W.slices(batches):
        sets = document_sets(data, bounds, hasher, rule)
        size = np.array([len(s) for s in sets], np.int64)
        band = np.searchsorted(bands(int(size.max()), rule), size)
        yield pa.record_batch(
            [rows.column(0), rows.column(1), pa.array(size), pa.array(band), pa.array(_digests(sets, 0)), pa.array(_digests(sets, 1)), pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary())],
            names=["doc_id", "key", "n_shingles", "band", "d1", "d2", "sketch"],
        )


def _signed(batches: Iterator[pa.RecordBatch], rule: Rule, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, packed): a slice's signatures by their remainder, as 6 bytes each, a 4-byte place in the list of nodes, and this list."""
    hasher = W.Hasher()
    for _, data, bounds in W.slices(batches, limit=2 * W.SLICE_BYTES):
        sets = document_sets(data, bounds, hasher, rule)
        node, once = np.unique(_digests(sets, 0), return_index=True)
        sig, who = signatures([sets[k] for k in once], rule)
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, who, bucket = sig[order], who[order], bucket[order]
        start = np.searchsorted(bucket, np.arange(buckets + 1))
        named, packed = [], []
        for b in np.unique(bucket).tolist():
            own, short = np.unique(who[start[b] : start[b + 1]], return_inverse=True)
            tail = (W.mix(sig[start[b] : start[b + 1]]).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            places = short.astype("<u4" if len(own) > 65_536 else "<u2")
            named.append(b)
            packed.append(np.array([len(short), len(own)], "<u4").tobytes() + tail + places.tobytes() + node[own].tobytes())
        yield pa.record_batch([pa.array(named, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def _members(t: pa.Table) -> pa.Table:
    """(group, node) of a bucket's signatures that several nodes share; groups of equal members once."""
    sig, node = [], []
    for x in t.column("packed"):
        raw = memoryview(x.as_py())
        n, m = np.frombuffer(raw[:8], "<u4").tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw[8 : 8 + 6 * n], np.uint8).reshape(n, 6)
        kind, at = ("<u4", 4) if m > 65_536 else ("<u2", 2)
        places = np.frombuffer(raw[8 + 6 * n : 8 + (6 + at) * n], kind)
        sig.append(wide.view("<u8").ravel())
        node.append(np.frombuffer(raw[8 + (6 + at) * n :], "<i8")[places])
    sig, node = np.concatenate(sig), np.concatenate(node)
    # of most signatures there is one: only the others are sorted by node
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = sig[1:] == sig[:-1]
    shared = np.zeros(len(sig), bool)
    shared[1:] |= same
    shared[:-1] |= same
    sig, node = sig[shared], node[shared]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(W.mix(node.view(np.uint64) ^ _SEEDS[2]), start) if len(start) else np.empty(0, np.uint64)
        name = W.mix(name + size.astype(np.uint64))
    first = np.unique(name, return_index=True)[1]
    first = first[size[first] > 1]
    pick = np.repeat(start[first] - (size[first].cumsum() - size[first]), size[first]) + np.arange(int(size[first].sum()))
    return pa.table({"group": np.repeat(name[first], size[first]).view(np.int64), "node": node[pick]})


def _folded(raw: list[bytes]) -> np.ndarray:
    """Sketches as rows of one width, that of the shortest."""
    width = min(map(len, raw))
    out = np.empty((len(raw), width), np.int32)
    for n in set(map(len, raw)):
        at = [k for k, x in enumerate(raw) if len(x) == n]
        out[at] = np.frombuffer(b"".join(raw[k] for k in at), np.uint8).reshape(len(at), width, n // width).sum(2)
    return out


def may_link(common: np.ndarray, n: np.ndarray, m: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether sets of these sizes with at most so many common elements can be linked."""
    return (rule.num + rule.den) * common >= rule.num * (n + m)


def _searched(node: np.ndarray, n: np.ndarray, raw: list[bytes], rule: Rule) -> list[tuple[int, int]]:
    """Ties that connect the members of a group which a chain of possible links connects."""
    h, out = _folded(raw), []
    free = np.arange(len(node))
    while len(free):
        todo, free = [free[0]], free[1:]
        while todo and len(free):
            k = todo.pop()
            hit = may_link(np.minimum(h[free], h[k]).sum(1), n[free], n[k], rule)
            todo += free[hit].tolist()
            out += [(int(node[k]), int(node[x])) for x in free[hit]]
            free = free[~hit]
    return out


def _ties(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows (group, node, n, sketch) sorted by group."""

    def tied(t: pa.Table) -> pa.RecordBatch:
        group, node, n = (t.column(c).to_numpy() for c in ("group", "node", "n"))
        raw = t.column("sketch").to_pylist()
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        out: list[tuple[int, int]] = []
        two = start[size == 2]
        wide = np.array([max(len(raw[k]), len(raw[k + 1])) for k in two], np.int64)
        for w in np.unique(wide).tolist():  # pairs of one width at once
            at = two[wide == w]
            h = _folded([raw[k] for k in at] + [raw[k + 1] for k in at])
            fit = at[may_link(np.minimum(h[: len(at)], h[len(at) :]).sum(1), n[at], n[at + 1], rule)]
            out += zip(node[fit].tolist(), node[fit + 1].tolist(), strict=True)
        for k, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            out += _searched(node[k : k + m], n[k : k + m], raw[k : k + m], rule)
        return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        group = held.column("group").to_numpy()
        last = int(np.searchsorted(group, group[-1]))  # its rows may go on in the next batch
        if last:
            yield tied(held.slice(0, last))
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield tied(held)


def _blobs(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(node, band, shingles): repeated rows of a slice once."""
    hasher = W.Hasher()
    for rows, data, bounds in W.slices(batches):
        sets = document_sets(data, bounds, hasher, rule)
        node = rows.column(0).to_numpy(zero_copy_only=False)
        once = np.unique(node, return_index=True)[1]
        yield pa.record_batch([pa.array(node[once]), rows.column(1).take(pa.array(once)), pa.array([sets[k].tobytes() for k in once], pa.binary())], names=["node", "band", "shingles"])


def _inside(key: tuple, t: pa.Table, rule: Rule) -> pa.Table:
    """Links that connect members of the left side with members of the right one."""
    t = t.take(pa.array(np.unique(t.column("node").to_numpy(), return_index=True)[1]))  # repeated rows came from several slices
    node, left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "is_left", "is_right"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
    size = np.array([len(s) for s in sets])
    # where each set's elements lie, for the right side
    elements = np.concatenate(sets)
    begin = np.concatenate([[0], size.cumsum()])
    label = np.arange(len(sets))  # what is connected has one label
    found = []
    right_at = np.flatnonzero(right)
    for p in np.flatnonzero(left).tolist():
        fits = (rule.num * size[right_at] <= rule.den * size[p]) & (rule.num * size[p] <= rule.den * size[right_at])
        other = right_at[fits & (label[right_at] != label[p])]
        if not len(other):
            continue
        n = size[other]
        values = elements[np.repeat(begin[other] - (n.cumsum() - n), n) + np.arange(int(n.sum()))]
        at = np.searchsorted(sets[p], values)
        at[at == len(sets[p])] = 0
        common = np.add.reduceat((sets[p][at] == values).astype(np.int64), n.cumsum() - n)
        hit = other[rule.den * common >= rule.num * (n + size[p] - common)]
        if len(hit):
            labels, first = np.unique(label[hit], return_index=True)
            found += [(int(node[p]), int(node[q])) for q in hit[first]]
            label[np.isin(label, labels)] = label[p]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _meetings(groups: DataFrame) -> DataFrame:
    """(meeting, node, band, is_left, is_right) from (group, node, band, n): which sets are compared in which task.

    A small group is one meeting.  A large one is cut by band and hash into blocks of about
    ``BLOCK`` elements; each block meets the blocks of its band and of the next one.
    """
    per_band = groups.groupBy("group", "band").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    per_group = per_band.groupBy("group").agg(F.sum("n").alias("total"))
    small = groups.join(per_group.where(f"total <= {BLOCK}").select("group"), "group")
    one = small.select(F.struct("group", F.lit(-1).cast("long").alias("band"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("step")).alias("meeting"), "node", "band", F.lit(True).alias("is_left"), F.lit(True).alias("is_right"))

    blocks = per_band.join(per_group.where(f"total > {BLOCK}").select("group"), "group").select("group", "band", "blocks")
    beside = [
        blocks.withColumnRenamed("blocks", "own"),
        blocks.select("group", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")),
        blocks.select("group", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")),
    ]
    sized = beside[0].join(beside[1], ["group", "band"], "left").join(beside[2], ["group", "band"], "left").na.fill(0, ["above", "below"])
    rows = groups.join(sized, ["group", "band"]).withColumn("h", F.pmod(F.xxhash64("node"), F.col("own")))

    def each(count: str, step: int, left: bool) -> DataFrame:
        some = rows.where(F.col(count) > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
        if count == "own":
            i, j = F.least("h", "k"), F.greatest("h", "k")
            sides = [(F.col("h") == i), (F.col("h") == j)]
        else:
            i, j = (F.col("h"), F.col("k")) if left else (F.col("k"), F.col("h"))
            sides = [F.lit(left), F.lit(not left)]
        band = F.col("band") if left else F.col("band") - 1
        meeting = F.struct("group", band.cast("long").alias("band"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(step).alias("step"))
        return some.select(meeting.alias("meeting"), "node", "band", sides[0].alias("is_left"), sides[1].alias("is_right"))

    return one.union(each("own", 0, True)).union(each("above", 1, True)).union(each("below", 1, False))


class _Found(NamedTuple):
    rows: DataFrame  # doc_id, key, n_shingles, band, d1, d2 of each document
    sets: DataFrame  # d1, d2, component: the distinct sets that are not empty


def _find(docs: DataFrame, rule: Rule) -> _Found:
    """Sets of all rows and the components of the distinct ones; ``key`` is a digest of a row's text."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string")
    key = F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    rows = cut(given.mapInArrow(lambda b: _sizes(b, rule), "doc_id long, key binary, n_shingles long, band long, d1 long, d2 long, sketch binary"), "sets")
    # equal sets are one node; one of its rows stands for it
    reps = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min(F.struct("doc_id", "key")).alias("rep"), F.max("n_shingles").alias("n"), F.max("band").alias("band"), F.max("sketch").alias("sketch")
    )
    reps = cut(reps.select("d1", "d2", "rep", "n", "band", "sketch", F.monotonically_increasing_id().alias("node")), "reps")

    shingles = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, -(-shingles // BUCKET_ROWS))
    signed = given.where("text is not null").select("doc_id", "text").mapInArrow(lambda b: _signed(b, rule, buckets), "bucket long, packed binary")
    shared = signed.repartition("bucket").groupBy("bucket").applyInArrow(_members, "group long, node long").distinct()
    known = shared.join(reps.select("d1", F.col("node").alias("rep"), "n", "sketch"), F.col("node") == F.col("d1")).select("group", F.col("rep").alias("node"), "n", "sketch")
    ties = known.repartition("group").sortWithinPartitions("group", "node").mapInArrow(lambda b: _ties(b, rule), "a long, b long")
    pairs = ties.distinct()
    groups = components(pairs).select(F.col("component").alias("group"), "node")
    groups = cut(groups.join(reps.select("node", "band", "n", "rep"), "node"), "groups")
    wanted = groups.select(F.col("rep.doc_id").alias("w_id"), F.col("rep.key").alias("w_key"), "node", "band")
    few = groups.count() <= MAX_BROADCAST_IDS
    met = given.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
    sets = met.select("node", "band", "text").mapInArrow(lambda b: _blobs(b, rule), "node long, band long, shingles binary")
    links = _meetings(groups.drop("rep")).join(sets, ["node", "band"]).groupBy("meeting").applyInArrow(lambda key, t: _inside(key, t, rule), "a long, b long")
    linked_nodes = components(links).select(F.col("node").alias("l_node"), "component")
    named = reps.join(linked_nodes, F.col("node") == F.col("l_node"), "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    return _Found(rows, cut(named, "components"))


def jaccard_components(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """doc_id, n_shingles, component_id; documents link at the rule's Jaccard similarity or more."""
    rows, sets = _find(docs, rule)
    of_set = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    names = sets.join(of_set, ["d1", "d2"]).groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = sets.join(names, "component").select("d1", "d2", "component_id")
    own = rows.where("n_shingles > 0").join(by_set, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return own.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """``docs`` (all columns) with one row of each component, and all rows whose set is empty.

    It is the row of the smallest id (a null one only if there is no other), of several the
    one of the least text digest, and of rows equal in both the least in all columns.
    """
    rows, sets = _find(docs, rule)
    of_set = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first"))
    chosen = sets.join(of_set, ["d1", "d2"]).groupBy("component").agg(F.min("first").alias("first"))
    chosen = cut(chosen.select(F.col("first.doc_id").alias("c_id"), F.col("first.key").alias("c_key"), F.lit(1).alias("c_one")), "chosen")
    empty = rows.where("n_shingles = 0").select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key"), F.lit(0).alias("c_one")).distinct()
    side = chosen.union(empty)
    n = side.count()
    text = F.col("text").cast("string")
    key = F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("r_id"), key.alias("r_key"))
    kept = held.join(F.broadcast(side) if n <= MAX_BROADCAST_IDS else side, F.col("r_id").eqNullSafe(F.col("c_id")) & (F.col("r_key") == F.col("c_key")))
    # rows that repeat id and text: only one of them stays
    again = cut(rows.where("n_shingles > 0").groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("a_id"), F.col("key").alias("a_key")), "again")
    n = again.count()
    if not n:
        return kept.select("row.*")
    side = F.broadcast(again) if n <= MAX_BROADCAST_IDS else again
    on = F.col("r_id").eqNullSafe(F.col("a_id")) & (F.col("r_key") == F.col("a_key"))
    once = kept.join(side, on, "left_semi").groupBy("r_id", "r_key").agg(F.min("row").alias("row"))
    return kept.join(side, on, "left_anti").select("row.*").union(once.select("row.*"))
