"""Repairing text from scanned pages: words whole, characters right, page furniture gone.

Everything is learned from the corpus itself, over all texts, and kept as tables: a lexicon with frequencies, in which a
symmetric-delete index finds candidates for a token that is no word; what is misread as what; how often words follow
each other; and how the lines look that one document repeats from page to page. Texts are repaired in groups of a
bounded size, each of which gets what the tables say about its own words, however large the tables are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.sources.tables import cut, small

# What is read where something else stands, as (read, meant).
CONFUSIONS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("b", "h"), ("c", "e"), ("cl", "d"), ("f", "t"), ("ii", "u"), ("o", "a"), ("ri", "n"), ("rn", "m"), ("vv", "w"), ("l", "i"), ("i", "l"),
)
#: Cost of a confusion, of a digit inside a word of letters, and the most a repair may cost. Any other change of a letter
#: costs 1, or what the corpus says (see `learned_costs`): a change that scanned texts show far more often than others
#: comes down to the cost of a confusion.
CONFUSED, DIGIT, MOST = 0.2, 0.6, 0.65
#: Distinct tokens that must show a change before its cost is learned.
SHOWN = 5
#: Times a word must stand in the corpus to be in the lexicon, and times more often than what it may be misread as.
KNOWN, TIMES = 5, 10
#: Share of a word's places inside sentences where a name has a capital letter.
NAME = 0.3
#: Letters beyond which a token is no word.
LONGEST = 64
#: Characters of the texts that are repaired together; what is known of their words is of that order too.
GROUP = 4_000_000
#: Buckets to which the features of lines are hashed: the header model has one weight for each.
BUCKETS = 1 << 18
#: Words, the most frequent first, that every task knows (some 150 bytes each): a cache, which spares them the joins that
#: all others take part in, and has no say in any result.
CORE = 50_000
#: Bits of a filter of words: 16 for each, at most 16 MB, and the places of a word in it, so that 1 of 200 other words gets
#: through. A fuller filter lets more through and loses nothing.
FILTER_BITS, PLACES = 1 << 27, 3

TOKEN = re.compile(r"[^\W_]+")
#: A word with a capital letter inside a sentence; one right behind it isn't counted. It begins with a blank, for speed.
CAPITAL = re.compile(r" (?<=[a-zß-ÿ0-9,%)] )([A-ZÀ-Ý][^\W_]*)(?: [A-ZÀ-Ý][^\W_]*)?")
HYPHENED = re.compile(r"([^\W\d_]+)-(?=[^\W\d_]{2})")
HYPHENS = "-‐‑\xad¬"
#: Letters read for digits.
NUMERIC = "0-9OolISsBbZzgq"
NUMBER = re.compile(rf"(?<![^\W_])(?=[{NUMERIC}.,]*[0-9])(?=[0-9.,]*[OolISsBbZzgq])[{NUMERIC}]+(?:[.,][{NUMERIC}]+)*(?![^\W_])")
_N = rf"(?:[{NUMERIC}]+|[ivxlcIVXLC1]{{1,7}})"
PAGE = re.compile(rf"[\s\f]*[\[(\-–—|]*\s*(?:[^\W\d_]{{1,5}}[.:]?\s+)?{_N}(?:\s*(?:/|[^\W\d_]{{2}})\s*{_N})?\s*[\])\-–—|]*\s*")
PAGE_WORDS = ("page", "p", "pg", "seite")
PART, GAP, DIGITS = re.compile(r"[^\W_]+|[^\w\s]"), re.compile(r"\S {3,}\S"), re.compile(r"\d+")
LAST, FIRST = re.compile(r"([^\W_]+)$"), re.compile(r"\s*([^\W_]+)")
COUNTS = "kind string, a string, b string, n bigint, clean bigint"


def _emit(rows: dict[tuple[str, str, str], list[int]]) -> Iterator[pa.RecordBatch]:
    items = list(rows.items())
    for lo in range(0, len(items), 50_000):
        part = items[lo : lo + 50_000]
        cols = [[k[0] for k, _ in part], [k[1] for k, _ in part], [k[2] for k, _ in part], [v[0] for _, v in part], [v[1] for _, v in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "a", "b", "n", "clean"])


def is_wrapped(text: str) -> bool:
    """Whether some line of a text goes on in the next one."""
    lines = text.split("\n")
    return any(a and b and a[-1] not in ".!?:|; " for a, b in zip(lines, lines[1:], strict=False))


def glued(text: str) -> list[tuple[str, str]]:
    """The two ends of each word that may be cut at a line's end: its second end begins one of the next few lines."""
    lines, out = text.lower().split("\n"), []
    for i, line in enumerate(lines):
        left = line.rstrip()
        if left[-1:] not in HYPHENS or not left:
            continue
        one = LAST.search(left, max(0, len(left) - LONGEST), len(left) - 1)
        follow = [x for x in lines[i + 1 : i + 9] if x.strip()][:5]
        out += [(one[1], two[1]) for x in follow if one and (two := FIRST.match(x))]
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word how often it stands (clean: in texts without wrapped lines), how often as a name does, and how
    often before a hyphen inside a line; and words that only stand if two lines' ends are one."""
    clean: Counter = Counter()
    other: Counter = Counter()
    names: Counter = Counter()
    wholes: set[str] = set()

    def rows() -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0])
        for counter, is_clean in ((clean, 1), (other, 0)):
            for chunk, n in counter.items():
                for w in TOKEN.findall(chunk):
                    if not w.isdigit():
                        v = out[("word", w.lower(), "")]
                        v[0] += n
                        v[1] += n * is_clean
                if "-" in chunk:
                    for w in HYPHENED.findall(chunk):
                        out[("left", w.lower(), "")][0] += n
        for w, n in names.items():
            out[("name", w.lower(), "")][0] += n
        for w in wholes:
            out[("glue", w, "")][0] = 0
        for c in (clean, other, names, wholes):
            c.clear()
        yield from _emit(out)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            wrapped = is_wrapped(text)
            (other if wrapped else clean).update(text.split())
            names.update(CAPITAL.findall(text))
            if wrapped:
                wholes.update(a + b for a, b in glued(text))
        if len(clean) + len(other) > 1_000_000:
            yield from rows()
    yield from rows()


def cost(read: str, meant: str, most: float = MOST, learned: dict[tuple[str, str], float] | None = None) -> float:
    """Weighted edit distance: CONFUSED for what is easily misread, DIGIT for a digit inside a word, what is `learned` of a
    change (read, meant) of one letter, in or out too, and 1 for any other."""
    learned = learned or {}
    n, m = len(read), len(meant)
    digit = DIGIT if m > 4 and meant.isalpha() else 1.0
    best = [[math.inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        least = math.inf
        for j in range(m + 1):
            here = best[i][j]
            if here > most:
                continue
            least = min(least, here)
            if i < n and j < m:
                x, y = read[i], meant[j]
                step = 0.0 if x == y else learned.get((x, y), digit if x.isdigit() else 1.0)
                best[i + 1][j + 1] = min(best[i + 1][j + 1], here + step)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], here + learned.get((read[i], ""), 1.0))
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], here + learned.get(("", meant[j]), 1.0))
            for a, b in CONFUSIONS:
                if read.startswith(a, i) and meant.startswith(b, j):
                    best[i + len(a)][j + len(b)] = min(best[i + len(a)][j + len(b)], here + CONFUSED)
        if i and least is math.inf and i < n and all(x > most for x in best[i + 1]):
            break
    return best[n][m]


def _keys(word: str, units: tuple[str, ...]) -> set[str]:
    """What is left of a word with one letter deleted, or with up to three of the `units` deleted.

    A token within MOST of a word differs by up to three confusions, or by one other change: with what was read deleted from
    the one and what was meant from the other, equal strings are left, so that every such pair meets, at any length.
    """
    out = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    spots = [(i, i + len(u)) for i in range(len(word)) for u in units if word.startswith(u, i)]
    last: list[tuple[str, int]] = [("", 0)]  # what stands before the end of the last deleted unit, and that end
    for _ in range(int(MOST / CONFUSED)):
        last = [(left + word[end:i], j) for left, end in last for i, j in spots if i >= end]
        out.update(left + word[end:] for left, end in last)
    return out


READ, MEANT = (tuple(sorted({c[k] for c in CONFUSIONS})) for k in (0, 1))


def _change(read: str, meant: str) -> tuple[str, str] | None:
    """The one letter that was changed, put in or left out; None if it is more."""
    if read == meant or abs(len(read) - len(meant)) > 1:
        return None
    i = next((k for k, (x, y) in enumerate(zip(read, meant, strict=False)) if x != y), min(len(read), len(meant)))
    a, b = (1, 1) if len(read) == len(meant) else (1, 0) if len(read) > len(meant) else (0, 1)
    return (read[i : i + a], meant[i : i + b]) if read[i + a :] == meant[i + b :] else None


@dataclass
class Lexicon:
    """What is known of the words of some texts: counts, candidates of what is no word, and what follows what."""

    words: dict[str, int]
    ordinary: set[str]
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    lines: np.ndarray | None = None
    siblings: dict[str, list[str]] = field(default_factory=dict)
    before_hyphen: dict[str, int] = field(default_factory=dict)
    known: dict[str, list[tuple[float, str]]] = field(default_factory=dict)
    #: Words of all the lexicon that candidates name, with their counts.
    counts: dict[str, int] = field(default_factory=dict)
    #: What stands between blanks and needs no repair, whatever the group: a doubtful token is known where it stands.
    fine: set[str] = field(default_factory=set)
    #: What stands between blanks without a misread number, whatever the group.
    numberless: set[str] = field(default_factory=set)
    #: What needs repair between blanks, and tokens that stay as they are, in texts of the group.
    ill: set[str] = field(default_factory=set)
    settled: set[str] = field(default_factory=set)
    #: Words as features of lines, and the weights and buckets of features, as far as they were asked for.
    looks: dict[str, str] = field(default_factory=dict)
    weights: dict[str | tuple[str, str], float] = field(default_factory=dict)
    buckets: dict[str | tuple[str, str], int] = field(default_factory=dict)

    def candidates(self, token: str) -> list[tuple[float, str]]:
        """What a token that is no word may have been, (cost, word), the cheapest first; nothing for a word."""
        return [] if token in self.words else self.known.get(token, [])

    def repair(self, token: str, before: str, after: str) -> str | None:
        """The word a token was misread from, if any: of those that cost least the one the neighbours speak for."""
        low = token.lower()
        if low in self.siblings:
            own = self.pairs.get((before, low), 0) + self.pairs.get((low, after), 0)
            for x in self.siblings[low]:
                if not own and self.pairs.get((before, x), 0) and self.pairs.get((x, after), 0):
                    return x
            return None
        found = self.candidates(low)
        if not found or len(low) < 3 and not any(c.isdigit() for c in low) and not (self.pairs.get((before, found[0][1]), 0) or self.pairs.get((found[0][1], after), 0)):
            return None
        least = [w for c, w in found if c <= found[0][0] + 1e-9]
        return max(least, key=lambda w: (self.pairs.get((before, w), 0) + self.pairs.get((w, after), 0), self.counts.get(w, 0)))

    def doubts(self, chunk: str) -> bool:
        """Whether anything between two blanks may need repair. Words that exist are doubted in wrapped texts only."""
        return NUMBER.search(chunk) is not None or any(self.candidates(t.lower()) for t in TOKEN.findall(chunk))

    def settles(self, token: str) -> bool:
        """Whether a token stays as it is, whatever stands around it."""
        low = token.lower()
        return low not in self.siblings and not self.candidates(low) or len(low) < 2 or token.isdigit() or not token.isalpha() and NUMBER.fullmatch(token) is not None

    def seen(self, word: str) -> str:
        """A word as a feature of a line: itself, repaired, or a star; a mark is itself."""
        if word not in self.looks:
            if len(self.looks) > 500_000:
                self.looks.clear()
            self.looks[word] = self._seen(word)
        return self.looks[word]

    def weight(self, feature: str | tuple[str, str]) -> float:
        """What a feature of a line says for a header."""
        if feature not in self.weights:
            if len(self.weights) > 500_000:
                self.weights.clear()
            self.weights[feature] = float(self.lines[bucket(feature)])
        return self.weights[feature]

    def bucket(self, feature: str | tuple[str, str]) -> int:
        """The bucket of a feature of a line, remembered."""
        if feature not in self.buckets:
            if len(self.buckets) > 500_000:
                self.buckets.clear()
            self.buckets[feature] = bucket(feature)
        return self.buckets[feature]

    def _seen(self, word: str) -> str:
        if not word[0].isalnum():
            return word
        low = word.lower()
        if low.isdigit():
            return "#"
        if low in self.words:
            return low
        found = self.candidates(low)
        return found[0][1] if found else "#" if NUMBER.fullmatch(word) else "*"


def bucket(feature: str | tuple[str, str]) -> int:
    """The bucket of a feature of a line."""
    return xxhash.xxh3_64_intdigest(feature if isinstance(feature, str) else " ".join(feature)) % BUCKETS


def line_features(line: str, lexicon: Lexicon) -> set[str | tuple[str, str]]:
    """What tells a running header from a line of the body: its words and marks, and what follows what."""
    looks = lexicon.looks
    merged = ["^"]
    for t in PART.findall(line):
        x = looks.get(t) or lexicon.seen(t)
        if x != "*" or merged[-1] != "*":
            merged.append(x)
    merged.append("$")
    out: set[str | tuple[str, str]] = set(zip(merged, merged[1:], strict=False))
    out.update(merged)
    first = line.lstrip()[:1]
    out.add(("starts", "lower" if first.islower() else "upper" if first.isupper() else "other"))
    if "   " in line and GAP.search(line):
        out.add(("wide", "gap"))
    letters = list(filter(str.isalpha, line))
    out.add("capitals" if letters and sum(map(str.isupper, letters)) > 0.5 * len(letters) else ("small", "letters"))
    return out


def _shape(line: str) -> str:
    """A line without what changes from page to page."""
    return DIGITS.sub("#", " ".join(line.split())).lower()


def is_page_number(line: str) -> bool:
    """Whether a line holds only a page number, even a misread one."""
    s = line.strip()
    if not s or len(s) > 24 or not PAGE.fullmatch(s):
        return False
    words = re.findall(r"[^\W\d_]+", s)
    if any(c.isdigit() for c in s):
        lead = re.match(r"[\[(\-–—|\s]*([^\W\d_]{1,5})[.:]?\s", s)
        if lead and not (lead[1].lower() in PAGE_WORDS or len(lead[1]) == 4 and cost(lead[1].lower(), "page") <= MOST):
            return len(s.split()) == 1
        return True
    return len(words) == 1 and re.fullmatch("[ivxlc]+", words[0]) is not None or bool(re.match(r"(?i)[\[(\-–\s]*(?:p|page)[.:]?\s+\w+", s))


FACTS = "g int, kind string, a string, b string, n bigint, ordinary boolean, before bigint, cands array<struct<cost double, word string, n bigint>>"


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _places(word: str, bits: int) -> list[int]:
    """Where a word stands in a filter."""
    h = _hash(word)
    return [(h + i * (h >> 32 | 1)) % bits for i in range(PLACES)]


def _filter(words: DataFrame) -> bytes:
    """A bit map of the words (word), made by the tasks and put together one at a time."""
    n, bits = words.count(), 1 << 16
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bytearray(bits // 8)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for h in _places(w, bits):
                    own[h >> 3] |= 1 << (h & 7)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(own)])], names=["own"])

    out = np.zeros(bits // 8, np.uint8)
    for row in words.select("word").mapInArrow(run, "own binary").toLocalIterator():
        out |= np.frombuffer(row.own, np.uint8)
    return out.tobytes()


def _in(bits: bytes, word: str) -> bool:
    return all(bits[h >> 3] >> (h & 7) & 1 for h in _places(word, len(bits) * 8))


def _keyed(words: DataFrame, units: tuple[str, ...], bits: bytes | None = None) -> DataFrame:
    """(word, key) for what deletions leave of each word, as a hash; with `bits` only what that filter knows."""
    shared = words.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known) * 8 if known else 1
        for batch in (b.slice(lo, 2000) for b in batches for lo in range(0, b.num_rows, 2000)):
            out, keys = [], []
            for word in batch.column(0).to_pylist():
                own = {_hash(k) for k in _keys(word, units)}
                if known:
                    own = {h for h in own if known[(h % size) >> 3] >> (h % size & 7) & 1}
                out += [word] * len(own)
                keys += [h - (1 << 64) if h >> 63 else h for h in own]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(keys, pa.int64())], names=["word", "key"])

    return words.select("word").mapInArrow(run, "word string, key bigint")


def _spread(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` over all cores: few bytes make much work here, so that sizes alone would gather them in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def near(tokens: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(token, word, cost, change): tokens (word) with the ordinary words (word) that one change or a few confusions part
    them from. Both meet by what deletions leave; the cost is that of the fixed confusions."""
    index = cut(_keyed(_spread(ordinary, "word"), MEANT))
    keys = index.select(F.col("key").alias("k")).distinct()

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()])], names=["own"])

    n, size = keys.count(), 1 << 16
    while size < min(FILTER_BITS, 16 * n):
        size *= 2
    bits = np.zeros(size // 8, np.uint8)
    for row in keys.mapInArrow(bits_of, "own binary").toLocalIterator():
        bits |= np.frombuffer(row.own, np.uint8)
    asked = _keyed(_spread(tokens, "word"), READ, bits.tobytes()).withColumnRenamed("word", "token")
    pairs = asked.join(index, "key").where("token != word").select("token", "word").distinct()

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [cost(a, b) if abs(len(a) - len(b)) <= 3 else math.inf for a, b in zip(x, y, strict=True)]
            change = ["\0".join(c) if (c := _change(a, b)) else None for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array(change, pa.string())], names=["token", "word", "cost", "change"])

    return _spread(pairs, "token").mapInArrow(costs, "token string, word string, cost double, change string").where(F.col("change").isNotNull() | (F.col("cost") <= MOST))


def learned_costs(found: DataFrame, counts: DataFrame, scanned: float) -> DataFrame:
    """(change, learned): what a change of one letter costs, from how much more often tokens that are no words show it in
    scanned texts than in others.

    scanned: the share of all words that stands in scanned texts. A change 16 times as frequent there as it would be by
    chance costs as little as a confusion, one as frequent as by chance costs 1; changes that fewer than SHOWN tokens show
    aren't learned. There are as many changes as pairs of letters, whatever the corpus.
    """
    odd = counts.where(F.col("n") < KNOWN).select(F.col("word").alias("token"), "n", "clean")
    shown = found.where("change is not null").select("token", "change").distinct().join(odd, "token")
    sums = shown.groupBy("change").agg(F.count("*").alias("tokens"), F.sum(F.col("n") - F.col("clean")).alias("bad"), F.sum("clean").alias("good"))
    scanned = min(0.999, max(0.001, scanned))
    by_chance = F.col("good") * scanned / (1 - scanned) + 0.5
    cheap = F.greatest(F.lit(CONFUSED), 1 - 0.2 * F.log2(F.col("bad") / by_chance))
    return sums.where((F.col("tokens") >= SHOWN) & (F.col("bad") >= SHOWN)).select("change", F.least(F.lit(1.0), cheap).alias("learned")).where("learned < 1")


@dataclass
class Knowledge:
    """What the corpus teaches, as tables: facts about words, pairs of words, and the weights of the header model."""

    facts: DataFrame
    core: Lexicon
    #: Filters of what is no word but may have been one; of what the core doesn't know; of what only its neighbours settle.
    odd: bytes
    rest: bytes
    unsure: bytes
    #: Pairs of words that stand often enough, and a filter of them.
    pairs: DataFrame | None = None
    paired: bytes | None = None


def _group_of(texts: DataFrame, groups: int) -> DataFrame:
    """Texts with the group they are repaired in; equal texts under other keys go to other groups."""
    return texts.withColumn("g", F.pmod(F.xxhash64("field", "record_key", "text"), F.lit(groups)).cast("int"))


def _groups(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, math.ceil(size / GROUP), min(2 * texts.sparkSession.sparkContext.defaultParallelism, size // 200_000))


def _pairs(texts: DataFrame, watched: bytes) -> DataFrame:
    """(a, b, n): pairs of words that nothing but a blank parts, a mark behind the second one aside, one of them watched."""
    shared = texts.sparkSession.sparkContext.broadcast(watched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        known: dict[str, tuple[str, bool]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            every = list(pairs.items())
            for lo in range(0, len(every), 50_000):
                part = every[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p, _ in part], pa.string()), pa.array([p[1] for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["a", "b", "n"])
            pairs.clear()
            known.clear()

        none = ("", "", False)

        def look(chunk: str) -> tuple[str, str, bool]:
            bare = chunk.strip(",.;:")
            found = (chunk if chunk.isalnum() else "", bare if bare.isalnum() else "", bare.isalnum() and not bare.isdigit() and _in(shared.value, bare))
            return found if found[1] else none

        for batch in batches:
            for text in batch.column(0).to_pylist():
                chunks = text.lower().split()
                for chunk in set(chunks).difference(known):
                    known[chunk] = look(chunk)
                seen = [none, *map(known.__getitem__, chunks), none]
                at = [i for i, x in enumerate(seen) if x[2]]
                pairs.update([(x, y) for i in at if (x := seen[i][0]) and (y := seen[i + 1][1])])
                pairs.update([(p[0], seen[i][1]) for i in at if not (p := seen[i - 1])[2] and p[0]])
            if len(pairs) + len(known) > 1_000_000:
                yield from rows()
        yield from rows()

    return texts.select("text").mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 3")


def _needs(texts: DataFrame, known: Knowledge, doubted: bool = False) -> DataFrame:
    """(kind, g, a, b, c, text) of the groups of `texts` (g, field, record_key, text): words that the core doesn't know (kind
    need), contexts of tokens that only their neighbours settle (kind ask), and pairs of words that may decide something
    (kind pair). With `doubted` also the texts that need something (kind text: field, record_key and text).

    A text without wrapped lines, without a token that may have been a word and without an odd number needs nothing: it
    is sound whatever else is known. A pair that the filter of pairs doesn't know decides nothing.
    """
    shared = texts.sparkSession.sparkContext.broadcast((known.odd, known.rest, known.unsure, known.paired, known.core.siblings if known.paired else {}, frozenset(known.core.words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, rest, unsure, paired, siblings, core = shared.value
        state: dict[str, tuple[bool, bool, bool]] = {}
        #: What stands between two blanks: its words, those of the rest, and the places of those that ask for neighbours.
        chunks: dict[str, tuple[list[str], list[str], list[int]]] = {}
        #: What is odd, what asks for something, and what is and does neither.
        ill: set[str] = set()
        asking: set[str] = set()
        plain: set[str] = set()
        contexts: dict[tuple[str, str, str], list[tuple[str, str, str, str]]] = {}
        out: set[tuple[str, int, str, str, str]] = set()
        together: dict[tuple[str, str], bool] = {}

        def stands(a: str, b: str) -> bool:
            key = (a, b)
            if key not in together:
                together[key] = bool(paired) and _in(paired, f"{a} {b}")
            return together[key]

        def batch_of(cols: list) -> pa.RecordBatch:
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "g", "a", "b", "c", "text"])

        def rows() -> Iterator[pa.RecordBatch]:
            every = list(out)
            for lo in range(0, len(every), 50_000):
                part = every[lo : lo + 50_000]
                yield batch_of([*zip(*part, strict=True), [None] * len(part)])
            for held in (out, state, chunks, ill, asking, plain, contexts, together):
                held.clear()

        def of(w: str) -> tuple[bool, bool, bool]:
            if w in core or w.isdigit():  # the filters are of other words
                return (False, False, False)
            if w not in state:
                state[w] = (_in(odd, w), _in(rest, w), bool(paired) and _in(unsure, w))
            return state[w]

        def look(chunk: str) -> None:
            words = [w.lower() for w in TOKEN.findall(chunk)]
            told = [of(w) for w in words]
            wanted = [w for w, x in zip(words, told, strict=True) if x[1]]
            places = [k for k, (w, x) in enumerate(zip(words, told, strict=True)) if x[2] or w in siblings]
            chunks[chunk] = (words, wanted, places)
            is_odd = any(x[0] for x in told) or NUMBER.search(chunk) is not None
            if is_odd:
                ill.add(chunk)
            if wanted or places:
                asking.add(chunk)
            elif not is_odd:
                plain.add(chunk)

        def around(left: str, chunk: str, right: str) -> list[tuple[str, str, str, str]]:
            """(kind, a, b, c) of what the words between two blanks ask of their neighbours."""
            own, _, places = chunks[chunk]
            found = []
            for k in places:
                w, before, after = own[k], own[k - 1] if k else left, own[k + 1] if k + 1 < len(own) else right
                if of(w)[2]:
                    found.append(("ask", before, w, after))
                # Pairs that decide whether a word that exists was misread from another one.
                for x in siblings.get(w, ()):
                    if stands(before, x) and stands(x, after):
                        found += [("pair", before, x, ""), ("pair", x, after, ""), ("pair", before, w, ""), ("pair", w, after, "")]
            return found

        for batch in batches:
            kept: list[int] = []
            for row, (g, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                wrapped = is_wrapped(text)
                every = text.split()
                several = set(every) - plain
                for chunk in several.difference(chunks):
                    look(chunk)
                if not wrapped and several.isdisjoint(ill):
                    continue
                kept.append(row)
                told = several & asking
                out.update([("need", g, w, "", "") for c in told for w in chunks[c][1]])
                at = [i for i, c in enumerate(every) if c in told and chunks[c][2]] if told else ()
                last = len(every) - 1
                for i in at:
                    key = (every[i - 1] if i else "", every[i], every[i + 1] if i < last else "")
                    found = contexts.get(key)
                    if found is None:
                        left = next((w[-1] for j in range(i - 1, -1, -1) if (w := chunks[every[j]][0])), "")
                        right = next((w[0] for j in range(i + 1, last + 1) if (w := chunks[every[j]][0])), "")
                        found = around(left, every[i], right)
                        # Beyond neighbours without words others may stand elsewhere.
                        if (not i or chunks[key[0]][0]) and (i == last or chunks[key[2]][0]):
                            contexts[key] = found
                    if found:
                        out.update([(kind, g, *x) for kind, *x in found])
                if wrapped:
                    low = None
                    for a, b in glued(text):
                        w = a + b
                        is_odd, is_rest, is_unsure = of(w)
                        if is_rest:
                            out.add(("need", g, w, "", ""))
                        if stands(a, b):
                            out.add(("pair", g, a, b, ""))
                        if is_unsure:
                            low = low or TOKEN.findall(text.lower())
                            at = next((i for i in range(len(low) - 1) if low[i] == a and low[i + 1] == b), None)
                            if at is not None:
                                out.add(("ask", g, low[at - 1] if at else "", w, low[at + 2] if at + 2 < len(low) else ""))
            if doubted and kept:
                part = batch.take(pa.array(kept))
                yield batch_of([["text"] * len(kept), part.column(0), part.column(2), part.column(3), [None] * len(kept), part.column(1)])
            if len(out) + len(state) + len(chunks) + len(contexts) + len(together) > 1_500_000:
                yield from rows()
        yield from rows()

    return texts.select("g", "text", *(("field", "record_key") if doubted else ())).mapInArrow(run, "kind string, g int, a string, b string, c string, text string")


def _facts(known: Knowledge, needs: DataFrame) -> DataFrame:
    """FACTS of each group: what is known of its words beyond the core, and how often the pairs stand that it may ask for."""
    word = needs.where("kind = 'need'").select("g", F.col("a").alias("word")).distinct().join(known.facts, "word")
    facts = word.select("g", F.lit("word").alias("kind"), F.col("word").alias("a"), F.lit("").alias("b"), "n", "ordinary", "before", "cands")
    if known.pairs is None:
        return facts
    asks = needs.where("kind = 'ask'").select("g", "a", F.col("b").alias("word"), "c").distinct().join(known.facts.select("word", "cands"), "word")
    either = asks.select("g", "a", "c", F.explode(F.concat(F.array("word"), F.transform("cands", lambda x: x["word"]))).alias("x"))
    wanted = either.select("g", F.explode(F.array(F.struct("a", F.col("x").alias("b")), F.struct(F.col("x").alias("a"), F.col("c").alias("b")))).alias("p")).select("g", "p.*")
    wanted = wanted.unionByName(needs.where("kind = 'pair'").select("g", "a", "b")).distinct()
    pairs = wanted.join(known.pairs, ["a", "b"]).select("g", F.lit("pair").alias("kind"), "a", "b", "n", F.lit(False).alias("ordinary"), F.lit(0).cast("bigint").alias("before"), F.array().cast("array<struct<cost double, word string, n bigint>>").alias("cands"))
    return facts.unionByName(pairs)


def _add(own: Lexicon, word: str, n: int | None, ordinary: bool, before: int, cands: list[dict]) -> None:
    """Puts one word's facts into a lexicon."""
    found = [(x["cost"], x["word"]) for x in sorted(cands or (), key=lambda x: (x["cost"], -x["n"], x["word"]))]
    own.counts.update((x["word"], x["n"]) for x in cands or ())
    if n is None:
        own.known[word] = found
        return
    own.words[word] = n
    if ordinary:
        own.ordinary.add(word)
        if found:
            own.siblings[word] = [w for _, w in found]
    if before:
        own.before_hyphen[word] = before


def _without(own: Lexicon, words: list[str]) -> None:
    """Takes words out of a lexicon again."""
    for held in (own.words, own.siblings, own.before_hyphen):
        for w in words:
            held.pop(w, None)
    own.ordinary.difference_update(words)
    for held in (own.known, own.counts, own.pairs, own.ill, own.settled):
        held.clear()


def _in_groups(texts: DataFrame, facts: DataFrame, core: Lexicon, make, schema: str) -> DataFrame:  # noqa: ANN001
    """make(lexicon, texts) of each group: its texts (g, field, record_key, text), and the core with the group's own facts."""
    shared = texts.sparkSession.sparkContext.broadcast(core)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, words = shared.value, []
        for kind, a, b, n, ordinary, before, cands in zip(*(right.column(c).to_pylist() for c in ("kind", "a", "b", "n", "ordinary", "before", "cands")), strict=True):
            if kind == "pair":
                own.pairs[a, b] = n
            elif a not in own.words:
                words.append(a)
                _add(own, a, n, ordinary, before, cands)
        try:
            return make(own, left)
        finally:
            _without(own, words)

    return texts.groupBy("g").cogroup(facts.groupBy("g")).applyInArrow(run, schema)


def _header_lines(lexicon: Lexicon, texts: pa.Table) -> pa.Table:
    """How often each bucket of line features stands in lines that a document repeats, and in others; -1 counts lines."""
    every: Counter = Counter()
    heads: Counter = Counter()
    for text in texts.column("text").to_pylist():
        if not is_wrapped(text):
            continue
        lines = [x for x in text.replace("\f", "").split("\n") if x.strip() and not is_page_number(x)]
        shapes = [_shape(x) for x in lines]
        times = Counter(shapes)
        for line, shape in zip(lines, shapes, strict=True):
            repeated = times[shape] > 1
            is_head = repeated and len(TOKEN.findall(line)) > 1
            if repeated and not is_head:
                continue
            found = {*map(lexicon.bucket, line_features(line, lexicon)), -1}
            every.update(found)
            if is_head:
                heads.update(found)
    return pa.table({"bucket": pa.array(list(every), pa.int32()), "n": pa.array(list(every.values()), pa.int64()), "head": pa.array([heads[f] for f in every], pa.int64())})


def learn(texts: DataFrame, documents: DataFrame | None = None) -> Knowledge:
    """What all `texts` (field, record_key, text) teach about words, and whole `documents` of them about repeated lines.

    Words that stand KNOWN times make the lexicon, whatever their number. Those that also stand in texts that weren't
    scanned as often as can be expected, and are no names, are the ordinary ones that a token may be repaired to. All
    joins are by equality of words, of pairs, or of what deletions leave of words.
    """
    spark = texts.sparkSession
    texts = texts.where("text is not null").select("field", F.col("record_key").cast("string").alias("record_key"), "text")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    counted = texts.select("text").mapInArrow(_count_words, COUNTS).groupBy(F.col("a").alias("word")).agg(of("word").alias("n"), F.sum("clean").alias("clean"), of("name").alias("name"), of("left").alias("before"))
    counts = cut(counted)
    kept = counts.where(F.col("n") >= KNOWN)
    sums = kept.agg(F.sum("clean").alias("clean"), F.sum("n").alias("n")).first()
    # A word belongs to the body of the language if it also stands where nothing was scanned, as often as can be
    # expected; without such texts, frequency alone decides.
    share = (sums.clean or 0) / sums.n if sums.n else 0.0
    good = (F.col("clean") >= 0.25 * share * F.col("n")) & (F.col("name") < NAME * F.col("n")) & ~F.col("word").rlike(r"\p{N}") & (F.length("word") > 1) & (F.length("word") <= LONGEST)
    lexicon = kept.select("word", "n", "before", good.alias("ordinary"))
    ordinary = lexicon.where("ordinary").select("word")
    tokens = counts.where((F.length("word") <= LONGEST) & ~F.col("word").rlike(r"^\p{N}+$")).select("word")
    found = cut(near(tokens, ordinary))
    costs = learned_costs(found, counts, 1 - share)
    cheap = {tuple(r.change.split("\0")): r.learned for r in costs.collect()}  # a row a pair of letters that several tokens show
    shared = spark.sparkContext.broadcast(cheap)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [cost(a, b, learned=shared.value) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.float64())], names=["token", "word", "cost"])

    again = found.where(F.col("cost") > MOST).join(F.broadcast(costs.select("change")), "change", "left_semi") if cheap else found.where("false")
    priced_ = again.select("token", "word").mapInArrow(priced, "token string, word string, cost double")
    sure = found.select("token", "word", "cost").unionByName(priced_).where(F.col("cost") <= MOST).groupBy("token", "word").agg(F.min("cost").alias("cost"))
    sized = sure.join(lexicon.select("word", "n"), "word")
    cands = cut(sized.groupBy("token").agg(F.collect_list(F.struct("cost", "word", "n")).alias("cands"), F.max("n").alias("most")))
    every = lexicon.join(cands.withColumnRenamed("token", "word"), "word", "full_outer")
    # What is misread from a word that stands far more often, and isn't ordinary, is no word.
    wrong = F.col("n").isNull() | ~F.col("ordinary") & F.coalesce(F.col("most") >= TIMES * F.col("n"), F.lit(False))
    none = F.array().cast("array<struct<cost double, word string, n bigint>>")
    facts = cut(every.select("word", F.when(~wrong, F.col("n")).alias("n"), (~wrong & F.coalesce("ordinary", F.lit(False))).alias("ordinary"), F.when(~wrong, F.col("before")).otherwise(0).alias("before"), F.when(wrong | F.col("ordinary"), F.coalesce("cands", none)).otherwise(none).alias("cands")))
    siblings = facts.where("ordinary and size(cands) > 0")
    watched = siblings.select(F.explode(F.concat(F.array("word"), F.transform("cands", lambda x: x["word"]))).alias("word")).unionByName(_swapped(ordinary)).distinct()
    core = Lexicon({}, set())
    for r in facts.where("n is not null").orderBy(F.desc("n"), "word").limit(CORE).collect():
        _add(core, r.word, r.n, r.ordinary, r.before, [x.asDict() for x in r.cands])
    core.counts.clear()
    beyond = facts.join(F.broadcast(spark.createDataFrame([(w,) for w in core.words], "word string")), "word", "left_anti")
    lone = F.size(F.filter("cands", lambda x: x["cost"] <= F.array_min(F.transform("cands", lambda y: y["cost"])) + 1e-9)) == 1
    known = Knowledge(facts, core, _filter(facts.where("n is null and size(cands) > 0")), _filter(beyond), _filter(beyond.where("size(cands) > 0").where(F.col("n").isNotNull() | ~lone | (F.length("word") < 3))))
    counted_pairs = _pairs(texts, _filter(watched))
    exact = counted_pairs.join(small(watched.withColumnRenamed("word", "a").withColumn("_a", F.lit(1)), 500_000), "a", "left").join(small(watched.withColumnRenamed("word", "b").withColumn("_b", F.lit(1)), 500_000), "b", "left")
    real = lexicon.select("word")
    pairs = cut(exact.where("_a = 1 or _b = 1").select("a", "b", "n").join(small(real.withColumnRenamed("word", "a"), 500_000), "a", "left_semi").join(small(real.withColumnRenamed("word", "b"), 500_000), "b", "left_semi"))
    if documents is not None:
        own = documents.where("text is not null").select(F.lit("").alias("field"), F.lit("").alias("record_key"), "text")
        own = _group_of(own, _groups(own))
        made = _in_groups(own, _facts(known, _needs(own, known)), core, _header_lines, "bucket int, n bigint, head bigint")
        rows = made.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("head").alias("head")).where("n >= 3").collect()  # a row a bucket
        by = {r.bucket: (r.head, r.n - r.head) for r in rows}
        heads, bodies = by.pop(-1, (0, 0))
        if heads and bodies:
            core.lines = np.zeros(BUCKETS)
            for f, (h, b) in by.items():
                core.lines[f] = math.log((h + 0.2) / (heads + 1)) - math.log((b + 0.2) / (bodies + 1))
    known.pairs, known.paired = pairs, _filter(pairs.select(F.concat_ws(" ", "a", "b").alias("word")))
    return known


def _swapped(ordinary: DataFrame) -> DataFrame:
    """(word): ordinary words one of whose letters is misread as the same sign as that of another one: their neighbours decide."""
    swaps = sorted({(a, b) for r, a in CONFUSIONS for q, b in CONFUSIONS if r == q and a != b and len(a) == len(b) == 1})
    alike = None
    for a, b in swaps:
        at = ordinary.where(F.contains("word", F.lit(a))).select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).where(F.substr("word", "i", F.lit(1)) == a)
        own = at.select("word", F.concat(F.substr("word", F.lit(1), F.col("i") - 1), F.lit(b), F.substr("word", F.col("i") + 1)).alias("other"))
        alike = own if alike is None else alike.unionByName(own)
    return alike.join(small(ordinary.withColumnRenamed("word", "other"), 500_000), "other", "left_semi").select("word").distinct()


def is_furniture(line: str, lexicon: Lexicon) -> bool:
    """Whether a line looks like those that documents repeat from page to page."""
    s = line.strip()
    if not s or lexicon.lines is None or s[0].islower():
        return False
    # The short last line of a paragraph looks a little like a header; only names bring a full stop into one.
    weights = lexicon.weights
    return math.fsum([weights[f] if f in weights else lexicon.weight(f) for f in line_features(line, lexicon)]) > (8.0 if s[-1] in ".!?" else 3.0)


@dataclass
class Repaired:
    """A text made whole, and what was found on its lines."""

    text: str
    damage: list[tuple[int, str]]


def _join(left: str, mark: str, right: str, lexicon: Lexicon) -> bool:
    """Whether the two ends of a word cut at a line's end are written without the hyphen."""
    if mark in "\xad¬":
        return True
    if right[0].isupper():
        return False
    a, b, whole = left.lower(), right.lower(), (left + right).lower()
    n = lexicon.words.get(whole, 0)
    compound = lexicon.pairs.get((a, b), 0)
    if n or lexicon.candidates(whole):
        return n >= compound
    ok = lambda x: x in lexicon.ordinary or bool(lexicon.candidates(x))
    return not (ok(a) and ok(b)) and lexicon.before_hyphen.get(a, 0) < max(KNOWN, 0.5 * lexicon.words.get(a, 0))


def repair(text: str, lexicon: Lexicon) -> Repaired:
    """One text as continuous paragraphs, with its damage by line (from 1, lines split at line feeds)."""
    lines = text.split("\n")
    damage: list[tuple[int, str]] = []
    wrapped = is_wrapped(text)
    body: list[int] = []
    for i, line in enumerate(lines):
        if wrapped and is_page_number(line):
            damage.append((i + 1, "page_number"))
        elif wrapped and is_furniture(line, lexicon):
            damage.append((i + 1, "running_header"))
        else:
            body.append(i)
    stream = [(i, lines[i].replace("\f", "").rstrip()) for i in body]
    # Words cut at the ends of lines.
    out_lines = {i: s for i, s in stream}
    filled = [i for i, s in stream if s.strip()]
    glued: dict[int, bool] = {}
    ends: dict[int, str] = {}
    for i, j in zip(filled, filled[1:], strict=False):
        if out_lines[i][-1] not in HYPHENS:
            continue
        m = re.search(rf"([^\W_]+)([{HYPHENS}])$", out_lines[i][-60:])
        r = re.match(r"\s*([^\W_]+)", out_lines[j])
        if m and r:
            glued[i] = _join(m[1], m[2], r[1], lexicon)
            if glued[i]:
                damage.append((i + 1, "split_word"))
            ends[i] = m[2]
    # Misread characters, of words as they are once joined.
    pieces: list[tuple[int, str, bool]] = []  # line, text, whether it goes on without a space
    for i in filled:
        s = out_lines[i]
        pieces.append((i, s[: -len(ends[i])] if i in ends and glued[i] else s, i in ends))
    running, starts, at = [], [], 0
    for k, (i, s, on) in enumerate(pieces):
        starts.append(at)
        running.append(s)
        if not on and k + 1 < len(pieces):
            running.append("\n" if pieces[k + 1][0] != i + 1 and any(not lines[x].strip() for x in range(i + 1, pieces[k + 1][0])) else " ")
            at += 1
        at += len(s)
    whole = "".join(running)
    fixes: list[tuple[int, int, str]] = []
    tokens = TOKEN.findall(whole)
    settled = lexicon.settled
    several = set(tokens) - settled
    settled.update([t for t in several if lexicon.settles(t)])
    several -= settled
    spans: list[tuple[int, int]] = []
    for n in [n for n, t in enumerate(tokens) if t in several] if several else ():
        token = tokens[n]
        meant = lexicon.repair(token, tokens[n - 1].lower() if n else "", tokens[n + 1].lower() if n + 1 < len(tokens) else "")
        if meant:
            spans = spans or [m.span() for m in TOKEN.finditer(whole)]
            fixes.append((*spans[n], meant if token[0].islower() or not token[0].isalpha() else meant[:1].upper() + meant[1:] if not token.isupper() or len(token) == 1 else meant.upper()))
    several = set(whole.split()) - lexicon.numberless
    lexicon.numberless.update([c for c in several if not NUMBER.search(c)])
    for m in NUMBER.finditer(whole) if not several <= lexicon.numberless else ():
        low = m[0].lower()
        if low in lexicon.words and low[0].isalpha():
            continue
        fixes.append((m.start(), m.end(), m[0].translate(str.maketrans("OolISsBbZzgq", "001155862299"))))
    for a, b, meant in fixes:
        old = whole[a:b]
        k = next((x for x in range(min(len(old), len(meant))) if old[x].lower() != meant[x].lower()), 0)
        damage.append((pieces[bisect_right(starts, min(a + k, len(whole) - 1)) - 1][0] + 1, "misread"))
    fixed, last = [], 0
    for a, b, meant in sorted(fixes):
        if a >= last:
            fixed += [whole[last:a], meant]
            last = b
    fixed.append(whole[last:])
    return Repaired("".join(fixed).replace("\n", "\n\n"), sorted(set(damage)))


OUT = "field string, record_key string, line_no int, damage string"


def _repaired(texts_too: bool):  # noqa: ANN202
    def make(lexicon: Lexicon, texts: pa.Table) -> pa.Table:
        fine = lexicon.fine
        for held in (fine, lexicon.numberless):
            if len(held) > 1_000_000:
                held.clear()

        def sound(text: str) -> bool:
            if is_wrapped(text):
                return False
            several = set(text.split()) - fine
            if not several.isdisjoint(lexicon.ill):
                return False
            for chunk in several:
                if lexicon.doubts(chunk):
                    lexicon.ill.add(chunk)
                    return False
                fine.add(chunk)
            return True

        cols: list[list] = [[], [], [], []]
        for name, key, text in zip(*(texts.column(c).to_pylist() for c in ("field", "record_key", "text")), strict=True):
            r = Repaired(text, []) if sound(text) else repair(text, lexicon)
            for line, kind in r.damage:
                for col, x in zip(cols, (name, key, line, kind), strict=True):
                    col.append(x)
            if texts_too:
                for col, x in zip(cols, (name, key, 0, r.text), strict=True):
                    col.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["field", "record_key", "line_no", "damage"])

    return make


def _doubted(needs: DataFrame) -> DataFrame:
    """The texts (g, field, record_key, text) that need something; all others are sound and have no damage."""
    return needs.where("kind = 'text'").select(F.col("g").alias("g"), F.col("a").alias("field"), F.col("b").alias("record_key"), F.col("text").alias("text"))  # columns of their own, as facts come from `needs` too


def _whole(texts: DataFrame, known: Knowledge, texts_too: bool) -> DataFrame:
    rows = texts.where("text is not null").select("field", F.col("record_key").cast("string").alias("record_key"), "text")
    grouped = _group_of(rows, _groups(rows))
    needs = cut(_needs(grouped, known, doubted=not texts_too))
    if not texts_too:
        grouped = _doubted(needs)
    return _in_groups(grouped, _facts(known, needs), known.core, _repaired(texts_too), OUT)


def damaged(texts: DataFrame, known: Knowledge) -> DataFrame:
    """(field, record_key, line_no, damage) for every damaged line of `texts` (field, record_key, text).

    damage is split_word, misread, running_header or page_number; lines count from 1. Headers and page numbers are
    looked for where a text has wrapped lines. Nulls and empty texts have no damage; repeated rows repeat theirs.
    """
    return _whole(texts, known, False)


def repaired(texts: DataFrame, known: Knowledge) -> DataFrame:
    """(field, record_key, text): every text of `texts` (field, record_key, text) as continuous paragraphs.

    A blank line parts paragraphs. Null texts are left out, an empty text stays empty.
    """
    return _whole(texts, known, True).where("line_no = 0").select("field", "record_key", F.col("damage").alias("text"))
