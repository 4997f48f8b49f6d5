"""Finding held-out evaluation texts inside a corpus.

Items are cut into windows: windows of the item's own size, which meet edited copies, and all runs of EXACT words, which
meet wording kept as it is. Windows of the corpus that can be alike get a SimHash, and runs kept as they are meet by
multi-index Hamming blocks of it, as a join of keyed tables. Fingerprints of edited windows may differ in any number of
bits, so that these meet by their rarest shingles, one of which all pairs have in common that are alike enough; exact
weighted shingle similarity then decides.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.sources.tables import cut, small

WORD = re.compile(r"[^\W_]+")
#: Words of a run that counts as leaked when it is kept as it is.
EXACT = 13
#: Least similarity of windows of an item's size. A word counts 2, a run of two words 1: with one word of ten changed,
#: windows come to 0.76 on average.
ALIKE = 0.7
#: Bits of 64 in which the fingerprints of edited windows may differ for `within_radius`, and those of runs of EXACT words,
#: which are equal. `leaked` asks it for the latter only.
RADIUS, RADIUS_EXACT = 15, 3
#: Blocks of bits of a fingerprint, and bits in which a block may differ for both kinds. Of two fingerprints that differ
#: in less than BLOCKS * (FLIPS + 1) bits, 16 and 4, some block differs in FLIPS at most, so that all within the radius meet.
BLOCKS, FLIPS, FLIPS_EXACT = 4, 3, 0
#: Windows of an item's size come in rungs, each about 1.4 times the one before; shorter items are their own window.
RUNGS = [26, *(round(26 * 2 ** (k / 2)) for k in range(1, 40))]
#: Bits of the filter of shingles that items have: 32 for each shingle, at most 16 MB. A fuller filter lets more
#: windows through to the join and loses none.
FILTER_BITS = 1 << 27
#: Most places of the table of how many windows of items hold a shingle, 4 bytes each. A fuller one takes some shingles
#: for more frequent than they are, which makes more work and loses nothing.
PLACES = 1 << 22
#: Words that are looked at in one step.
STEP = 50_000

WINDOWS = "doc_id bigint, size int, place int, print bigint, wid bigint, words array<int>"
BITS = 64 // BLOCKS
SCHEMA = "doc_id bigint, item_id bigint, windows int, longest_run int, best double"


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return WORD.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _twos(h: np.ndarray) -> np.ndarray:
    """A hash of every run of two words, along the last axis."""
    with np.errstate(over="ignore"):
        return _mix(_mix(h[..., :-1]) * np.uint64(0x9E3779B97F4A7C15) ^ h[..., 1:])


def weight(size: int) -> int:
    """Weight of all shingles of a window: 2 for each word, 1 for each run of two."""
    return 2 * size + max(0, size - 1)


def needed(size: int, at_least: float) -> int:
    """Weight that windows of one size share if their similarity is `at_least`."""
    return max(1, int(np.ceil(2 * weight(size) * at_least / (1 + at_least) - 1e-9)))


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """64-bit SimHash of windows of word hashes (a row each): shingles vote with their weight, repeated ones again."""
    if not len(windows):
        return np.empty(0, np.uint64)
    votes = np.zeros((len(windows), 64), np.int32)
    for h, w in ((_mix(windows), 2), (_twos(windows), 1)):
        if h.shape[1]:
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(*h.shape, 8), axis=2, bitorder="little")
            votes += w * bits.sum(1, dtype=np.int32)
    return np.packbits(2 * votes > weight(windows.shape[1]), axis=1, bitorder="little").view(np.uint64).ravel()


def window_ids(windows: np.ndarray) -> np.ndarray:
    """A 64-bit number for the word sequence of each window; with the fingerprint it stands for the window."""
    out = np.full(len(windows), windows.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(windows.shape[1]):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + windows[:, i])
    return out


def _kept(windows: np.ndarray) -> np.ndarray:
    """32 bits of each word, enough to compare two windows."""
    return windows.astype(np.uint32).view(np.int32)


def similarity(a: list[int], b: list[int]) -> float:
    """Weighted Jaccard similarity of the shingles of two windows: sum of lower over sum of higher counts, by weight."""
    low = high = 0
    for k, w in ((1, 2), (2, 1)):
        x, y = (Counter(zip(*(s[i:] for i in range(k)), strict=False)) for s in (a, b))
        both = sum((x & y).values())
        low, high = low + w * both, high + w * (x.total() + y.total() - both)
    return low / high if high else 0.0


def item_windows(n: int) -> list[tuple[int, int, bool]]:
    """(start, size, edited) of the windows of an item of `n` words; `edited` are those that meet edited wording.

    Those are the largest rung that fits, at both ends and every half of it, and the smallest rung likewise for partial
    copies; an item below it is its own window.
    """
    out = [(i, EXACT, False) for i in range(n - EXACT + 1)]
    if 0 < n < RUNGS[0]:
        return [*out, (0, n, True)]
    for size in {max(r for r in RUNGS if r <= n), RUNGS[0]} if n else ():
        out += [(i, size, True) for i in sorted({*range(0, n - size + 1, size // 2), n - size})]
    return out


def _cut_items(items: DataFrame) -> DataFrame:
    """(item_id, size, edited, print, wid, words) of all windows of all items, each window of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array([_hash(w) for w in words(text)], np.uint64)
                by_kind: dict[tuple[int, bool], list[int]] = {}
                for start, size, edited in item_windows(len(h)):
                    by_kind.setdefault((size, edited), []).append(start)
                for (size, edited), starts in by_kind.items():
                    w = h[np.array(starts)[:, None] + np.arange(size)]
                    wid, first = np.unique(window_ids(w), return_index=True)
                    w = w[first]
                    for col, x in zip(cols, ([key] * len(w), [size] * len(w), [edited] * len(w), fingerprints(w).view(np.int64), wid.view(np.int64), _kept(w)), strict=True):
                        col += list(x)
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "size", "edited", "print", "wid", "words"])

    return items.mapInArrow(run, "item_id bigint, size int, edited boolean, print bigint, wid bigint, words array<int>")


def _filter_of(items: DataFrame, bits: int) -> np.ndarray:
    """A bit map of the shingles of all items, made by the tasks and put together one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            lists = [np.array([_hash(w) for w in words(t)], np.uint64) for t in batch.column(1).to_pylist()]
            if lists:
                at = np.unique(np.concatenate([s for h in lists for s in (_mix(h), _twos(h))]) & np.uint64(bits - 1))
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()])], names=["own"])

    out = np.zeros(bits // 8, np.uint8)
    for row in items.mapInArrow(run, "own binary").toLocalIterator():
        out |= np.frombuffer(row.own, np.uint8)
    return out


def _holds(own: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    at = shingles & np.uint64(len(own) * 8 - 1)
    return (own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def _groups(lists: list[list]) -> Iterator[list[int]]:
    """Places of lists that together hold about STEP values; a longer list stands alone."""
    part, size = [], 0
    for i, x in enumerate(lists):
        part.append(i)
        size += len(x)
        if size >= STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


def _cut_documents(docs: DataFrame, own: np.ndarray, least: dict[int, int]) -> DataFrame:
    """WINDOWS of the documents that hold enough weight of shingles that items have; words once a task for each window.

    least: sizes, and the weight asked for. A window with less can't be as alike as asked to any item's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashed, given = shared.value, lru_cache(1 << 18)(_hash), set()
        names = ["doc_id", "size", "place", "print", "wid", "words"]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        for batch in batches:
            keys = batch.column(0).to_numpy()
            lists = [[hashed(w) for w in words(t)] for t in batch.column(1).to_pylist()]
            for part in _groups(lists):
                # Texts behind each other; a window that begins in one and ends in the next isn't one.
                h = np.fromiter((x for i in part for x in lists[i]), np.uint64)
                sizes = np.array([len(lists[i]) for i in part])
                text, first = np.repeat(np.arange(len(part)), sizes), np.cumsum(sizes) - sizes
                ones = np.r_[0, np.cumsum(2 * _holds(known, _mix(h)).astype(np.int64))]
                twos = np.r_[0, np.cumsum(_holds(known, _twos(h)).astype(np.int64))] if len(h) > 1 else np.zeros(1, np.int64)
                for size, need in least.items():
                    if len(h) < size:
                        continue
                    score = ones[size:] - ones[:-size] + twos[size - 1 :] - twos[: len(twos) - size + 1]
                    at = np.flatnonzero((score >= need) & (text[: len(h) - size + 1] == text[size - 1 :]))
                    for lo in range(0, len(at), 4096):
                        some = at[lo : lo + 4096]
                        w = h[some[:, None] + np.arange(size)]
                        wid, prints = window_ids(w), fingerprints(w)
                        fresh = []
                        for x, row in zip(wid.tolist(), _kept(w), strict=True):
                            fresh.append(None if (size, x) in given else row)
                            given.add((size, x))
                        if len(given) > 1_000_000:
                            given.clear()
                        cols = (keys[np.array(part)[text[some]]], np.full(len(some), size), some - first[text[some]], prints.view(np.int64), wid.view(np.int64), fresh)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, WINDOWS)


def _flips(bits: int, most: int) -> list[int]:
    """All numbers of `bits` bits with at most `most` ones."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)]


def blocks_of(windows: DataFrame, flipped: bool = False) -> DataFrame:
    """`windows` with a row for each block of the fingerprint, as (block, key).

    flipped: also a row for each key that differs in FLIPS bits at most (FLIPS_EXACT where `edited` is false): such rows
    meet those of any fingerprint that differs as little in one block, by equality of block and key.
    """
    mask = (1 << BITS) - 1
    key = lambda i: F.shiftrightunsigned("print", BITS * i).bitwiseAND(F.lit(mask)).cast("int")
    out = windows.withColumn("part", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), key(i).alias("key")) for i in range(BLOCKS)))))
    if not flipped:
        return out.select("*", "part.block", "part.key").drop("part")
    some, none = (F.array(*map(F.lit, _flips(BITS, n))) for n in (FLIPS, FLIPS_EXACT))
    out = out.withColumn("flip", F.explode(F.when(F.col("edited"), some).otherwise(none)))
    return out.select("*", "part.block", F.col("part.key").bitwiseXOR(F.col("flip")).alias("key")).drop("part", "flip")


def within_radius(corpus: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct (size, wid, print, item_wid, item_print, edited): windows of both sides within the radius of the item's."""
    radius = F.when(F.col("edited"), F.lit(RADIUS)).otherwise(F.lit(RADIUS_EXACT))
    items = own.select("size", F.col("wid").alias("item_wid"), F.col("print").alias("item_print"), "edited", "print").distinct()
    keyed = blocks_of(items, flipped=True).select("size", "block", "key", "item_wid", "item_print", "edited")
    pairs = blocks_of(corpus.select("size", "wid", "print")).join(keyed, ["size", "block", "key"])
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius
    return pairs.where(near).select("size", "wid", "print", "item_wid", "item_print", "edited").distinct()


def _counted(x: np.ndarray) -> np.ndarray:
    """A hash of each value of a row of `x`, with how many times it stands in the row before."""
    x, at = np.sort(x, 1), np.arange(x.shape[1])
    first = np.c_[np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]] if x.shape[1] else np.ones(x.shape, bool)
    nth = at - np.maximum.accumulate(np.where(first, at, 0), 1)
    with np.errstate(over="ignore"):
        return _mix(x + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, shingles) of the windows (size, words) of a batch, by size: words, then runs of two, as `_counted`."""
    sizes, own = batch.column("size").to_numpy(), batch.column("words")
    first, values = own.offsets.to_numpy().astype(np.int64), own.values.to_numpy().view(np.uint32)
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        for lo in range(0, len(every), step := max(1, STEP // size)):
            at = every[lo : lo + step]
            w = values[first[at][:, None] + np.arange(size)].astype(np.uint64)
            yield size, at, np.concatenate([_counted(w), _counted(_twos(w))], 1)


def _holders(windows: DataFrame, places: int) -> np.ndarray:
    """How many of the windows hold a shingle, by its hash, made by the tasks and put together one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(places, np.uint32)
        for batch in batches:
            for _, _, shingles in _windows_of(batch):
                at, n = np.unique(shingles & np.uint64(places - 1), return_counts=True)
                own[at.astype(np.int64)] += n.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()])], names=["own"])

    out = np.zeros(places, np.uint32)
    for row in windows.select("size", "words").mapInArrow(run, "own binary").toLocalIterator():
        out += np.frombuffer(row.own, np.uint32)
    return out


def _rarest(windows: DataFrame, holders: np.ndarray, at_least: float) -> DataFrame:
    """(size, wid, print, key): the shingles of each window by one of which any window must meet it that is as alike.

    All windows take their shingles in one order, rare ones first, up to the weight that two of them may have apart: the
    first shingle in that order that such windows share is among these of both.
    """
    spark = windows.sparkSession
    shared = spark.sparkContext.broadcast(np.minimum(255, 8 * np.log2(holders + 1.0)).astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            wid, prints = batch.column("wid").to_numpy(), batch.column("print").to_numpy()
            for size, at, shingles in _windows_of(batch):
                order = rank[(shingles & np.uint64(len(rank) - 1)).astype(np.int64)] << np.uint64(56) | shingles >> np.uint64(8)
                # The last bit tells words, which weigh 2, from runs of two.
                order = order & ~np.uint64(1) | (np.arange(order.shape[1]) < size).astype(np.uint64)
                order.sort(1)
                own = 1 + (order & np.uint64(1)).astype(np.int32)
                row, col = np.nonzero(np.cumsum(own, 1) - own <= weight(size) - needed(size, at_least))
                cols = (np.full(len(row), size), wid[at[row]], prints[at[row]], order[row, col].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["size", "wid", "print", "key"])

    return windows.select("size", "wid", "print", "words").mapInArrow(run, "size int, wid bigint, print bigint, key bigint")


def can_be_alike(corpus: DataFrame, own: DataFrame, at_least: float) -> DataFrame:
    """Distinct (size, wid, print, item_wid, item_print, edited): edited windows of both sides, (size, wid, print, words), that
    have one of their rarest shingles in common. All pairs whose similarity is `at_least` do."""
    items = own.where("edited").groupBy("size", "wid", "print").agg(F.first("words").alias("words"))
    words_, places = items.agg(F.sum("size")).first()[0] or 0, 1 << 12
    while places < min(PLACES, 4 * words_):
        places *= 2
    holders = _holders(items, places)
    keyed = cut(_rarest(items, holders, at_least).withColumnsRenamed({"wid": "item_wid", "print": "item_print"}))
    asked = _rarest(corpus.join(F.broadcast(items.select("size").distinct()), "size", "left_semi"), holders, at_least)
    return asked.join(small(keyed, 500_000), ["size", "key"]).select("size", "wid", "print", "item_wid", "item_print", F.lit(True).alias("edited")).distinct()


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each row of `a` has in common with that of `b`, repeated ones counted as often as in both."""
    both = np.sort(np.concatenate([_counted(a), _counted(b)], 1), 1)
    return (both[:, 1:] == both[:, :-1]).sum(1)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`similarity` of each row of `a`, a window, and that of `b`, of the same size."""
    low = 2 * _shared(a, b) + _shared(_twos(a), _twos(b))
    return low / (2 * weight(a.shape[1]) - low)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ((c.offsets.to_numpy(), c.values.to_numpy().view(np.uint32)) for c in batch.columns[:2])
        sizes, values = batch.column(2).to_numpy(), np.zeros(batch.num_rows)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            a, b = (own[first[at].astype(np.int64)[:, None] + np.arange(size)].astype(np.uint64) for first, own in (x, y))
            values[at] = similarities(a, b)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(values)], names=[*batch.schema.names[2:], "similarity"])


def leaked(docs: DataFrame, items: DataFrame, at_least: float = ALIKE) -> DataFrame:
    """(doc_id, item_id, windows, longest_run, best): which documents hold wording of which items.

    A document holds wording of an item if a window of it is as alike as `at_least` to one of the item of its own size
    (best: the highest similarity), or if both share a run of EXACT words (longest_run: words of the longest stretch of
    such runs, 0 without one). windows counts the document's matching windows. All of them are found, whatever their
    fingerprints: edited ones meet by their rarest shingles (see `can_be_alike`), runs kept as they are by equal prints.

    The corpus is read once, whatever the number of items; only windows that share enough shingles with items leave
    the tasks, equal ones with their words once. Items and windows then are tables: they meet by key, small
    sides are broadcast, others shuffle. Positions are gathered for one document and item only. Nulls, empty texts
    and, for items under EXACT words, texts shorter than the item match nothing. Repeated rows count once.
    """
    docs = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text").distinct()
    own = cut(_cut_items(items))
    sizes = own.groupBy("size").agg(F.max("edited").alias("edited"), F.count("*").alias("n")).collect()  # a row a rung, or size below the first
    bits = 1 << 16
    while bits < min(FILTER_BITS, 64 * sum(r.n for r in sizes)):
        bits *= 2
    least = {r.size: needed(r.size, at_least) if r.edited else weight(r.size) for r in sizes}
    found = cut(_cut_documents(docs, _filter_of(items, bits), least))
    distinct = cut(found.where("words is not null").groupBy("size", "wid", "print").agg(F.first("words").alias("words")))
    windows = own.groupBy("size", "wid", "print").agg(F.first("words").alias("words")).withColumnsRenamed({"wid": "item_wid", "print": "item_print", "words": "item_words"})
    same = (F.col("wid") == F.col("item_wid")) & (F.col("print") == F.col("item_print"))
    kept = within_radius(distinct, own.where("not edited")).where(same)
    pairs = kept.unionByName(can_be_alike(distinct, own, at_least)).join(distinct, ["size", "wid", "print"]).join(small(windows), ["size", "item_wid", "item_print"])
    sure = pairs.select("words", "item_words", "size", "wid", "print", "item_wid", "edited").mapInArrow(_compare, "size int, wid bigint, print bigint, item_wid bigint, edited boolean, similarity double").where(F.col("similarity") >= F.when(F.col("edited"), F.lit(at_least)).otherwise(F.lit(1.0)))
    by_item = sure.join(own.select("size", F.col("wid").alias("item_wid"), "edited", "item_id"), ["size", "item_wid", "edited"])
    matched = cut(by_item.groupBy("size", "wid", "print", "item_id").agg(F.max("similarity").alias("similarity"), F.max(~F.col("edited")).alias("kept")))
    hits = found.select("doc_id", "size", "place", "wid", "print").join(small(matched), ["size", "wid", "print"])
    by = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("size", "place").cast("int").alias("windows"), F.sort_array(F.collect_set(F.when(F.col("kept"), F.col("place")))).alias("places"), F.max("similarity").alias("best"))
    run = F.aggregate(
        "places",
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, p: F.struct(p.alias("last"), F.when(p == acc.last + 1, acc.run + 1).otherwise(F.lit(1)).alias("run"), F.greatest(acc.best, F.when(p == acc.last + 1, acc.run + 1).otherwise(F.lit(1))).alias("best")),
        lambda acc: F.when(acc.best > 0, acc.best + (EXACT - 1)).otherwise(F.lit(0)),
    )
    return by.select("doc_id", "item_id", "windows", run.alias("longest_run"), "best")
