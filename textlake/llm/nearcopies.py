"""Grouping near-duplicate records with an LSH forest.

Every text becomes a set of shingles, its set TREES x DEPTH minima under random orders of the shingles. A tree reads
DEPTH of them as a label; rows sorted by label stand beside the rows with which they share the longest prefix. Rows
that share at least `shallow` values are candidates, however many rows do. Candidates pass a two-bit sketch of all
minima, and are then verified exactly on their whole texts.

A region that holds far more than REGION rows is crowded. Where all pairs are asked for, it is compared in pairs of
blocks by several tasks. Where groups are asked for, its rows are first linked to the rows beside them, with which they
share the longest prefix, and to the first of their task; once these links are verified, only rows of different groups
are still compared, so that a crowd of variants of one text costs in proportion to its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.sources.tables import cut, small

WORD = re.compile(r"[^\W_]+")
#: Trees, and values of a label; together they are the minima of a signature and give the sketch of 2 bits each.
TREES, DEPTH = 24, 4
#: Rows of a block of a crowded region; each pair of blocks is compared by itself.
REGION = 4096
#: Rows of the trees, of some 60 bytes each, that a task sorts.
ROWS = 250_000
#: Rows of a region beyond which, where groups are asked for, neighbours are linked before anything else is compared.
CROWD = 1024
#: Standard deviations of the sketch's estimate that a candidate may lie under the threshold (1 of 30,000 pairs at it).
SLACK = 4.0
#: Copies of one class that are expanded into pairs; of a larger class each copy is linked to its least member.
EXPAND = 100
#: Share of the rows, by hash, in which labels are counted to find the hot ones.
WATCHED = 16

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
SIGNED = "id string, class string, s1 bigint, s2 bigint, s3 bigint, labels array<bigint>"


@lru_cache(1 << 18)
def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return WORD.findall(text.lower())


def word_shingles(text: str, n: int) -> np.ndarray:
    """Hashes of every run of `n` words; none for a text of fewer words."""
    h = np.fromiter(map(_hash, words(text)), np.uint64)
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = _mix(out) ^ h[i : len(h) - n + 1 + i]
    return _mix(out)


def letter_shingles(text: str, n: int) -> np.ndarray:
    """Hashes of every run of `n` characters of each word, taken with n - 1 spaces before and one after it."""
    padded = [" " * (n - 1) + w + " " for w in words(text)]
    return np.fromiter((_hash(p[i : i + n]) for p in padded for i in range(len(p) - n + 1)), np.uint64)


KINDS: dict[str, Callable[[str, int], np.ndarray]] = {"word": word_shingles, "letter": letter_shingles}


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set (none of them empty), a row for each, as 32-bit numbers."""
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_XOR)), np.uint32)
    for i, (x, m) in enumerate(zip(_XOR, _MUL, strict=True)):
        v = (flat ^ x) * m
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def _packed(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketch as three 64-bit numbers a row; the labels, DEPTH values of 16 bits in one number for each tree."""
    two = (_mix(minima.astype(np.uint64)) & np.uint64(3)).reshape(-1, 3, 32)
    sketch = (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)
    half = (_mix(minima.astype(np.uint64)) >> np.uint64(40)) & np.uint64(0xFFFF)
    shifts = np.arange(DEPTH - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
    labels = (half.reshape(-1, TREES, DEPTH) << shifts).sum(2, dtype=np.uint64)
    return sketch.view(np.int64), labels.view(np.int64)


def sign(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """(id, class, s1, s2, s3, labels) of the rows (id, text) that have a shingle.

    class stands for the sequence of words. Of one class each task gives labels to its least id only, so that however
    many copies a text has, the trees get it at most once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets = [KINDS[kind](t, n) for t in texts]
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                classes = [xxhash.xxh3_128_hexdigest(" ".join(words(texts[i]))) for i in keep]
                sketch, labels = _packed(signatures([sets[i] for i in keep]))
                own = []
                for c, lab in zip(classes, labels, strict=True):
                    own.append(None if c in seen else lab)
                    seen.add(c)
                columns = [pa.array([ids[i] for i in keep], pa.string()), pa.array(classes, pa.string()), *(pa.array(sketch[:, i]) for i in range(3)), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "s1", "s2", "s3", "labels"])

    # Rows come to a task in any order; the least id of a class is settled by the classes' own minimum, in near_pairs.
    return rows.mapInArrow(run, SIGNED)


def _alike(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of the two-bit fields of rows i and j agree."""
    x = s[i] ^ s[j]
    odd = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return TREES * DEPTH - np.bitwise_count(odd).sum(1, dtype=np.int32)


def _neighbours(label: np.ndarray, shallow: int, deeper: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, in blocks, of rows sorted by label that share at least `shallow` values.

    deeper: wherever more than REGION rows share so many, one value more is asked for, which loses pairs; no query does.
    """
    n = len(label)
    depth = np.full(n, shallow)
    for d in range(shallow, DEPTH) if deeper else ():
        prefix = label >> np.uint64(16 * (DEPTH - d))
        edge = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        size = np.repeat(np.diff(np.r_[edge, n]), np.diff(np.r_[edge, n]))
        depth[(size > REGION) & (depth == d)] = d + 1
    key = label >> (np.uint64(16) * (DEPTH - depth).astype(np.uint64))
    # equal keys at different depths aren't the same region
    at, step = np.arange(n - 1), 1
    while len(at):
        at = at[at + step < n]
        at = at[(key[at] == key[at + step]) & (depth[at] == depth[at + step])]
        if len(at):
            yield at, at + step
        step += 1


def _across(side: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of the rows of side 1 with those of side 0 that are of another group."""
    others = np.flatnonzero(side == 0)
    for i in np.flatnonzero(side == 1):
        j = others[group[others] != group[i]]
        yield np.full(len(j), i), j


def _between(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of two blocks, or of all rows if there is one block only."""
    others = np.flatnonzero(side != side[0])
    for i in np.flatnonzero(side == side[0]):
        j = others if len(others) else np.arange(i + 1, len(side))
        yield np.full(len(j), i), j


def _candidates(threshold: float, shallow: int) -> Callable:
    expected = threshold + (1 - threshold) / 4
    m = TREES * DEPTH
    least = int(np.floor(m * expected - SLACK * np.sqrt(m * expected * (1 - expected))))
    shift = np.uint64(16 * (DEPTH - shallow))

    def region(tree: np.ndarray, label: np.ndarray, part: np.ndarray, side: np.ndarray, ids: np.ndarray, classes: np.ndarray, s: np.ndarray, group: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Candidates among whole regions, or pairs of blocks, sorted by tree, prefix, part, label, class and id."""
        first = np.r_[True, (side[1:] != side[:-1]) if group is not None else np.zeros(len(side) - 1, bool)] | np.r_[True, (tree[1:] != tree[:-1]) | (part[1:] != part[:-1]) | (label[1:] != label[:-1]) | (classes[1:] != classes[:-1])]
        out = []
        for crowded in (False, True):
            own = np.flatnonzero(first & ((part >= 0) == crowded))
            if not len(own):
                continue
            for at in np.split(own, np.flatnonzero((np.diff(tree[own]) != 0) | crowded & ((np.diff(part[own]) != 0) | (np.diff(label[own] >> shift) != 0))) + 1):
                for i, j in _across(side[at], group[at]) if group is not None else _between(side[at]) if crowded else _neighbours(label[at], shallow, deeper=False):
                    good = _alike(s, at[i], at[j]) >= least
                    if good.any():
                        out.append((ids[at[i][good]], ids[at[j][good]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            for a, b in region(*(np.concatenate(x) for x in zip(*parts, strict=True))):
                lo = a < b
                yield pa.RecordBatch.from_arrays([pa.array(np.where(lo, a, b), pa.string()), pa.array(np.where(lo, b, a), pa.string())], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.stack([batch.column(i).to_numpy() for i in (6, 7, 8)], 1).view(np.uint64)
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.array(batch.column(4).to_pylist(), object), np.array(batch.column(5).to_pylist(), object), s, *([np.array(batch.column(9).to_pylist(), object)] if batch.num_columns > 9 else []))
            same = (part[0] == part[0][-1]) & (part[2] == part[2][-1]) & (part[1] >> shift == part[1][-1] >> shift)
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end:  # rows from `end` on may go on in the next batch
                held.append(tuple(x[:end] for x in part))
                yield from flush(held)
                held = []
            held.append(tuple(x[end:] for x in part))
        if held:
            yield from flush(held)

    return run


LABELLED = ("tree", "label", "part", "side", "id", "class", "s1", "s2", "s3")


def _trees(signed: DataFrame, shallow: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """A row for each tree of each labelled row, and the regions (tree, prefix, blocks) of more than about `crowd` rows.

    The size of a region is an estimate, over distinct classes, and decides only where and when pairs are compared.
    """
    trees = signed.where("labels is not null").select("id", "class", "s1", "s2", "s3", F.posexplode("labels").alias("tree", "label"))
    trees = trees.withColumn("prefix", F.shiftrightunsigned("label", 16 * (DEPTH - shallow)))
    watched = trees.where(F.pmod(F.xxhash64("class"), F.lit(WATCHED)) == 0).groupBy("tree", "prefix").agg(F.count_distinct("class").alias("n")).where(F.col("n") > crowd // WATCHED)
    return trees, watched.select("tree", "prefix", F.ceil(F.col("n") * WATCHED / REGION).cast("bigint").alias("blocks"))


def _parts(signed: DataFrame) -> int:
    """Partitions for the trees' rows, of about ROWS rows, however many there are."""
    n = signed.where("labels is not null").count() * TREES
    return max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))


def _compared(spread: DataFrame, threshold: float, shallow: int, parts: int, outside: bool = False) -> DataFrame:
    """Candidates (a, b) inside each (tree, prefix, part); `outside`: only of rows of different groups, see between_groups."""
    ordered = spread.repartition(parts, "tree", "prefix", "part").sortWithinPartitions("tree", "prefix", "part", F.shiftrightunsigned("label", 1), "label", "class", "id")
    return ordered.select(*LABELLED, *(["group"] if outside else [])).mapInArrow(_candidates(threshold, shallow), "a string, b string").distinct()


def candidates(signed: DataFrame, threshold: float, shallow: int) -> DataFrame:
    """Distinct pairs (a, b) of ids, a < b, of different classes that some tree holds for alike."""
    trees, hot = _trees(signed, shallow, 4 * REGION)
    # A prefix that a great part of all texts share goes to several tasks as pairs of blocks of about REGION texts.
    sided = trees.join(small(hot), ["tree", "prefix"], "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")), F.lit(0).cast("bigint")))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.least(k, "side") * F.col("blocks") + F.greatest(k, "side"))
    spread = sided.withColumn("part", F.explode(F.when(F.col("blocks").isNotNull(), pairs).otherwise(F.array(F.lit(-1).cast("bigint")))))
    return _compared(spread, threshold, shallow, _parts(signed))


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each row (tree, prefix, id), as sorted, to the row before it and to the first of its region here."""
    last = first = None
    for batch in batches:
        left, right = [], []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is None or row[:2] != last[:2]:
                first = row
            for other in {first[2], last[2]} - {row[2]} if last and row[:2] == last[:2] else ():
                left.append(min(row[2], other))
                right.append(max(row[2], other))
            last = row
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])


def neighbours(trees: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), two for each row of a crowded region: the row beside it in the first such tree, and a pivot.

    Rows are sorted by their whole label and then the sketch, so that those beside each other share the longest prefix;
    a region of many rows is spread over tasks by the same order.
    """
    crowd = trees.join(small(hot), ["tree", "prefix"]).groupBy("id").agg(F.min(F.struct("tree", "prefix", "label", "s1", "s2", "s3")).alias("own")).select("id", "own.*")
    order = ("tree", "prefix", "label", "s1", "s2", "s3", "id")
    ranged = crowd.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("tree", "prefix", "id").mapInArrow(_beside, "a string, b string").distinct()


def between_groups(trees: DataFrame, hot: DataFrame, groups: DataFrame, threshold: float, shallow: int, parts: int) -> DataFrame:
    """Distinct candidates (a, b) of crowded regions whose rows aren't of one group (key, group) yet.

    Of each region the largest group stays in blocks, each row once; rows of other groups meet all blocks. Only pairs of
    different groups are looked at.
    """
    crowd = trees.join(small(hot), ["tree", "prefix"]).join(groups.withColumnRenamed("key", "id"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    sizes = crowd.groupBy("tree", "prefix", "group").agg(F.count("*").alias("n"))
    main = sizes.groupBy("tree", "prefix").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count("*").alias("groups"), (F.sum("n") - F.max("n")).alias("others")).where("groups > 1")
    rows = crowd.join(small(main), ["tree", "prefix"]).withColumn("own", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")))
    # Rows outside the largest group come in blocks of their own, so that a task holds two blocks at most.
    wide = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("others") / F.lit(float(REGION))).cast("bigint"))
    rows = rows.withColumn("wide", wide)
    inside = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("wide") - 1)).alias("w")).select(*rows.columns, (F.col("own") * F.col("wide") + F.col("w")).alias("part"), F.lit(0).cast("bigint").alias("side"))
    odd = rows.where(F.col("group") != F.col("main"))
    outside = odd.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b")).select(*rows.columns, (F.col("b") * F.col("wide") + F.pmod(F.xxhash64("class", F.lit(2)), F.col("wide"))).alias("part"), F.lit(1).cast("bigint").alias("side"))
    return _compared(inside.unionByName(outside), threshold, shallow, parts, outside=True)


def _verify(kind: str, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(5000)(lambda text: frozenset(KINDS[kind](text, n).tolist()))
        for batch in batches:
            values = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = made(x), made(y)
                both = len(p & q)
                values.append(both / (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    return run


def _signed(rows: DataFrame, kind: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, text); signatures, each class by its least id; (least, id, copies) of the classes of several ids."""
    rows = rows.where("id is not null and text is not null").select(F.col("id").cast("string").alias("id"), "text")
    signed = cut(sign(rows, kind, n))
    classes = signed.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    members = cut(signed.select("id", "class").join(classes, "class").select("least", "id", "copies").distinct())
    # Labels go to any member of a class; its least id stands for it.
    return rows, signed.join(small(members.select("id", "least"), 500_000), "id", "left").withColumn("id", F.coalesce("least", "id")).drop("least"), members


def _sure(found: DataFrame, rows: DataFrame, kind: str, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates `found` (a, b) that are as alike as the threshold."""
    wanted = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(small(wanted, 500_000), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sides = found.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    return sides.mapInArrow(_verify(kind, n), "a string, b string, similarity double").where(F.col("similarity") >= threshold)


def _classes(rows: DataFrame, kind: str, n: int, threshold: float, shallow: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of classes, each by its least id; (least, id, copies) of the classes of several ids."""
    rows, base, members = _signed(rows, kind, n)
    return _sure(cut(candidates(base, threshold, shallow)), rows, kind, n, threshold), members


def near_pairs(rows: DataFrame, kind: str = "word", n: int = 5, threshold: float = 0.8, shallow: int = 3) -> DataFrame:
    """(key_a, key_b, similarity): pairs of rows (id, text), key_a < key_b, with Jaccard similarity >= threshold.

    `rows` has a string `id` and a `text`; other columns are ignored. `kind` and `n` are those of the shingles; ids
    compare by code point. A pair at the threshold is missed by all trees with a probability of (1 - threshold^shallow)^TREES;
    pairs that come out are verified exactly. Rows with null id or text, or without a shingle, are in no pair. Copies,
    texts with the same words in the same order, are one class: it goes through the trees once, and comes out as all
    its pairs up to EXPAND copies, beyond as pairs with its least id; links between different classes are given
    likewise for all copies or for the least ids. Repeated rows of one id count once. An empty table gives no pairs.
    """
    sure, members = _classes(rows, kind, n, threshold, shallow)
    copies = members.where(F.col("copies") <= EXPAND).select("least", "id")
    wide = sure.join(copies.withColumnsRenamed({"least": "a", "id": "a2"}), "a", "left").join(copies.withColumnsRenamed({"least": "b", "id": "b2"}), "b", "left")
    between = wide.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "similarity")
    one, two = copies.withColumnRenamed("id", "a"), copies.withColumnRenamed("id", "b")
    within = one.join(two, "least").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    star = members.where((F.col("copies") > EXPAND) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    every = between.unionByName(within).unionByName(star)
    return every.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "similarity")


def components(pairs: DataFrame) -> DataFrame:
    """(key, group): for every key of `pairs` (key_a, key_b) the least key it is linked to, directly or over others.

    Large-star and small-star steps in turn: each key's links are moved to the least key it sees, until nothing moves.
    Minima are made partly before the shuffle, links are joined back by key, and each step is written to the shared
    folder; links and labels never leave the executors. Null keys are left out, a pair of equal keys is a group of one.
    """
    edges = cut(pairs.where("key_a is not null and key_b is not null").select(F.greatest("key_a", "key_b").alias("u"), F.least("key_a", "key_b").alias("v")).distinct())
    keys = edges.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct()
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return keys.join(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "key"), "key", "left").select("key", F.coalesce("m", "key").alias("group"))


def near_groups(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group, links): one row for every distinct id of `rows`, also those without a partner.

    pairs: what near_pairs made of `rows`. group is the least id of those that links lead to, links the number of
    pairs of the id; ids without a pair are their own group with no links.
    """
    ends = pairs.select(F.explode(F.array("key_a", "key_b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    ids = rows.where("id is not null").select(F.col("id").cast("string").alias("id")).distinct()
    named = components(pairs).withColumnRenamed("key", "id")
    return ids.join(ends, "id", "left").join(named, "id", "left").select("id", F.coalesce("group", "id").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def near_links(rows: DataFrame, kind: str = "word", n: int = 5, threshold: float = 0.8, shallow: int = 3) -> DataFrame:
    """(id, group, links): near_groups over all pairs of `rows`, none of which is made: links come from the classes' sizes.

    An id is linked to all other ids of its class and to all ids of every class that its own is linked to, however large
    they are. The parameters are those of near_pairs.
    """
    sure, members = _classes(rows, kind, n, threshold, shallow)
    sure = cut(sure)
    sizes = members.groupBy("least").agg(F.count_distinct("id").alias("size"))
    ends = sure.select(F.col("a").alias("least"), F.col("b").alias("other")).unionByName(sure.select(F.col("b").alias("least"), F.col("a").alias("other")))
    far = ends.join(sizes.withColumnRenamed("least", "other"), "other", "left").groupBy("least").agg(F.sum(F.coalesce("size", F.lit(1))).alias("far"))
    named = components(sure.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))).withColumnRenamed("key", "least")
    ids = rows.where("id is not null").select(F.col("id").cast("string").alias("id")).distinct()
    own = ids.join(members.select("id", "least").distinct(), "id", "left").withColumn("least", F.coalesce("least", "id"))
    counted = own.join(sizes, "least", "left").join(far, "least", "left").join(named, "least", "left")
    links = F.coalesce("size", F.lit(1)) - 1 + F.coalesce("far", F.lit(0))
    return counted.select("id", F.coalesce("group", "least").alias("group"), links.alias("links"))


def near_classes(rows: DataFrame, kind: str = "word", n: int = 5, threshold: float = 0.8, shallow: int = 3) -> DataFrame:
    """(id, group): every distinct id of `rows` (id, text) with the least id that links lead to, as near_groups gives it.

    Links aren't all made: in crowded regions rows that others already hold together aren't compared, which changes no
    group. Parameters, nulls and copies are those of near_pairs; an id without a partner is its own group.
    """
    whole, base, members = _signed(rows, kind, n)
    trees, hot = _trees(base, shallow, CROWD)
    hot = cut(hot)
    key = lambda df: df.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    found = trees.join(small(hot), ["tree", "prefix"], "left_anti").withColumn("part", F.lit(-1).cast("bigint")).withColumn("side", F.lit(0).cast("bigint"))
    parts = _parts(base)
    links = _compared(found, threshold, shallow, parts)
    crowded = not hot.isEmpty()
    if crowded:
        links = links.unionByName(neighbours(trees, hot)).distinct()
    links = key(cut(_sure(cut(links), whole, kind, n, threshold)))
    if crowded:
        more = between_groups(trees, hot, cut(components(links)), threshold, shallow, parts)
        links = links.unionByName(key(_sure(cut(more), whole, kind, n, threshold)))
    named = components(links).withColumnRenamed("key", "least")
    ids = rows.where("id is not null").select(F.col("id").cast("string").alias("id")).distinct()
    own = ids.join(members.select("id", "least").distinct(), "id", "left").withColumn("least", F.coalesce("least", "id"))
    return own.join(named, "least", "left").select("id", F.coalesce("group", "least").alias("group"))
