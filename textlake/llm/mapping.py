"""Mapping freely typed values to the entries of a reference list: token repair, then soft TF-IDF.

Values and entries are tables throughout. The distinct tokens of all values meet the words of the entries by what is
left of both with letters deleted; exact edit distance decides on repairs. Entries that share a weighty word with a
value are then scored by soft TF-IDF and by the spelling of the whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.sources.tables import cut, small

# Words that say nothing about which entry is meant.
FILLERS = "caps cap capsules chapter cont contd continued d forte iu inj mcg mg ml no oral part r section sec s tab tabs tablets tm".split()
#: Similarity that a repaired token needs, and the least final score of a match: names of one word, invented like the
#: reference's own, need more than names of several common words.
REPAIR, ACCEPT, ACCEPT_PHRASE = 0.62, 0.69, 0.48
#: Most edits of a repair.
REACH = 3
#: Length up to which words meet by deletions from the whole; longer ones meet by their first or last AFFIX letters, one
#: of which has one edit at most where the word has REACH.
WHOLE, AFFIX = 12, 6
#: Least soft TF-IDF of an entry that can be meant.
LEAST = 0.3
#: Bits of the filter of what the entries' words leave with letters deleted: 16 for each, at most 16 MB. A fuller filter
#: sends more to the join and loses nothing.
FILTER_BITS = 1 << 27
#: Words in another order count as this share of their soft TF-IDF score where the spelling of the whole differs.
SHUFFLED = 0.85

SIZE = re.compile(r"\d+[a-z]{0,3}|[a-z]{0,2}\d+[a-z]?mg")


def folded(text: str) -> str:
    """`text` in lower case without accents, trade marks or the difference of ks and x."""
    text = unicodedata.normalize("NFKD", re.sub(r"[™®©℠]", " ", text).lower())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn").replace("&", " and ")
    return text


def distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Edits between two strings: insertion, deletion, substitution, and exchange of neighbours, each 1.

    Beyond `most` any greater number may come out.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """1 less the edits as a share of the longer string; 0 for two empty ones, and maybe for what is under `least`."""
    longer = max(len(a), len(b))
    return max(0.0, 1 - distance(a, b, int((1 - least) * longer + 1e-9)) / longer) if longer else 0.0


@lru_cache(100_000)
def _filler(token: str) -> bool:
    """Whether a token is a number, a size or a filler, or a filler with one slip of the pen."""
    return token.isdigit() or bool(SIZE.fullmatch(token)) or token in FILLERS or 4 <= len(token) <= 6 and token[0] in "cti" and any(len(f) >= 4 and distance(token, f) <= 1 for f in ("caps", "tabs"))


def _letters(token: str) -> str:
    """Digits inside a word as the letters they stand for; ks as x."""
    if not token.isdigit() and re.search(r"[a-z]", token) and not SIZE.fullmatch(token):
        token = token.replace("0", "o").replace("1", "i").replace("5", "s")
    return token.replace("ks", "x")


def readings(value: str) -> list[list[str]]:
    """The ways to cut a value into words: as typed and with hyphens left out, each without what stands in brackets.

    Each stands for further readings, in which two neighbours or all words are one (see `_joined`): there are as many as
    words, so they are weighed and scored together and never listed.
    """
    text = folded(value)
    text = re.sub(r"[(\[][^)\]]*[)\]]?", " ", text)
    text = re.sub(r"^\W*(section|part|chapter)[\s_]+([0-9]+|[a-z]|[ivx]+)(?![a-z0-9])", " ", text)
    text = re.sub(r"^\W*[ivx]+\.\s", " ", text)
    text = re.sub(r"_cont_d_?$|_continued_?s?$", " ", text)
    if re.search(r"tinued$", text):
        text = re.sub(r"_c\w*tinued$", " ", text)
    out: list[list[str]] = []
    for cut in (re.sub(r"['’`´]", "", text), re.sub(r"['’`´\-]", "", text)):
        raw = [t for t in re.findall(r"[^\W_]+", cut) if not _filler(t)]
        tokens = [_letters(t) for t in raw]
        if tokens and tokens not in out:
            out.append(tokens)
    return out


def _joined(tokens: list[str]) -> list[str]:
    """Each two neighbours as one word."""
    return [a + b for a, b in zip(tokens, tokens[1:], strict=False)]


def reach(length: int) -> int:
    """Edits that a word of this length may be away from its repair."""
    return min(REACH, max(1, int(length * (1 - REPAIR))))


def _deletes(word: str, most: int) -> set[str]:
    last = out = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def token_keys(token: str) -> set[int]:
    """The keys under which a token looks for words."""
    n, out = len(token), set()
    if n <= WHOLE + REACH:
        out |= {"=" + d for d in _deletes(token, reach(n))}
    if n > WHOLE - REACH:
        for size in range(AFFIX - 1, AFFIX + 2):
            out |= {"<" + d for d in _deletes(token[:size], 1)} | {">" + d for d in _deletes(token[-size:], 1)}
    return {xxhash.xxh3_64_intdigest(k) for k in out}


def word_keys(word: str) -> set[int]:
    """The keys under which a word of the entries is found by every token within its reach."""
    if len(word) <= WHOLE:
        out = {"=" + d for d in _deletes(word, reach(len(word)))}
    else:
        out = {"<" + d for d in _deletes(word[:AFFIX], 1)} | {">" + d for d in _deletes(word[-AFFIX:], 1)}
    return {xxhash.xxh3_64_intdigest(k) for k in out}


def _signed(keys: set[int]) -> list[int]:
    return [k - (1 << 64) if k >> 63 else k for k in sorted(keys)]


def _keyed(rows: DataFrame, make, bits: bytes | None = None) -> DataFrame:  # noqa: ANN001
    """(kind, word, key) for each key of the rows (kind, word); with `bits` only for keys that the filter knows."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known) * 8 if known else 0
        for batch in (b.slice(lo, 2000) for b in batches for lo in range(0, b.num_rows, 2000)):
            kinds, words, keys = [], [], []
            for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = make(word)
                if known:
                    own = {k for k in own if known[(k % size) >> 3] >> (k & 7) & 1}
                kinds += [kind] * len(own)
                words += [word] * len(own)
                keys += _signed(own)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(keys, pa.int64())], names=["kind", "word", "key"])

    return rows.mapInArrow(run, "kind string, word string, key bigint")


def _filter_of(keyed: DataFrame) -> bytes:
    """A bit map of the keys, put together a task at a time."""
    n, bits = keyed.count(), 1 << 16
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()])], names=["own"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keyed.select("key").mapInArrow(run, "own binary").toLocalIterator():
        out |= np.frombuffer(row.own, np.uint8)
    return out.tobytes()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [similarity(t, w, REPAIR) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["kind", "token", "word", "alike"])


def repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(kind, token, word, alike): the words of `vocabulary` (kind, word) that the tokens (kind, token) may be.

    A word of the vocabulary is its own. Any other token is joined to every word within its reach whose similarity is
    REPAIR or more; both sides are made distinct, and meet by the hash of what deletions leave, so that no token is
    compared with the whole vocabulary.
    """
    tokens, vocabulary = tokens.select("kind", "token").distinct(), vocabulary.select("kind", "word").distinct()
    own = vocabulary.select("kind", F.col("word").alias("token"), "word")
    exact = tokens.join(small(own), ["kind", "token"]).select("kind", "token", "word", F.lit(1.0).alias("alike"))
    keyed = cut(_keyed(vocabulary, word_keys))
    asked = _keyed(_spread(tokens.join(small(own.drop("word")), ["kind", "token"], "left_anti"), "token"), token_keys, _filter_of(keyed)).withColumnRenamed("word", "token")
    pairs = asked.join(keyed, ["kind", "key"]).select("kind", "token", "word").distinct()
    near = _spread(pairs, "token").mapInArrow(_alike, "kind string, token string, word string, alike double").where(F.col("alike") >= REPAIR)
    return exact.unionByName(near)


def _spread(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` over all cores: few bytes make much work here, so that sizes alone would gather them in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for no, tokens in enumerate(readings(value)):
                every = sorted({*tokens, *_joined(tokens), "".join(tokens)})
                for col, x in zip(cols, (kind, value, no, tokens, every), strict=True):
                    col.append(x)
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), strings, strings), strict=True)], names=["kind", "value", "reading", "tokens", "every"])


def _name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], []]
        for kind, ref, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = readings(name)[:1]
            # A name counts in its own words, and all joined.
            for tokens in own + [["".join(own[0])]] if own and len(own[0]) > 1 else own:
                for col, x in zip(cols, (kind, ref, tokens), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["kind", "ref_id", "tokens"])


def names_of(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (kind, name_id, ref_id, whole, words, parts) and words (kind, word, weight, unknown) of the entries.

    weight says how rare a word is among all names of its kind, unknown is the weight of a word that no name has; parts
    are the weights of a name's words as shares of its length.
    """
    listed = entries.where("ref_id is not null and kind is not null").select("kind", F.col("ref_id").cast("bigint"), F.explode(F.array_union(F.array("entry_name"), F.coalesce("also_known_as", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    names = listed.distinct().mapInArrow(_name_words, "kind string, ref_id bigint, tokens array<string>").distinct()
    names = cut(names.withColumn("name_id", F.xxhash64("kind", "ref_id", "tokens")))
    sizes = names.groupBy("kind").agg(F.count("*").alias("names"))
    held = names.select("kind", "name_id", F.explode("tokens").alias("word"))
    words = held.distinct().groupBy("kind", "word").agg(F.count("*").alias("n")).join(sizes, "kind").select("kind", "word", F.log1p(F.col("names") / F.col("n")).alias("weight"), F.log1p("names").alias("unknown"))
    words = cut(words)
    weighed = held.groupBy("kind", "name_id", "word").agg(F.count("*").alias("times")).join(words, ["kind", "word"])
    own = weighed.groupBy("kind", "name_id").agg(F.sqrt(F.sum(F.col("times") * F.pow("weight", F.lit(2)))).alias("norm"), F.collect_list(F.struct("word", (F.col("weight") * F.col("times")).alias("w"))).alias("own"))
    whole = names.select("kind", "name_id", "ref_id", F.array_join("tokens", "").alias("whole"))
    return cut(whole.join(own, ["kind", "name_id"]).select("kind", "name_id", "ref_id", "whole", F.transform("own", lambda x: x.word).alias("words"), F.transform("own", lambda x: x.w / F.col("norm")).alias("parts"))), words


def _around(own: list[float], joined: list[float]) -> list[float]:
    """Sums of `own` as it stands, and of `own` with each two neighbours replaced by the value of `joined`."""
    left, right = [0.0, *accumulate(own)], [0.0, *accumulate(reversed(own))][::-1]
    return [left[-1], *(left[i] + x + right[i + 2] for i, x in enumerate(joined))]


def _wanted(own: list[float], joined: list[float], several: bool, norm: float) -> list[bool]:
    """Which words of a value, weighing `own`, and neighbours as one, weighing `joined`, can bring a name to LEAST.

    Of the words that lead to a name, take the heaviest: what it and all lighter ones give in some reading is their length
    at most, times `norm`, the most length that a name has; if `several` may be the same word of a name, the sum of them.
    """
    power = 1 if several else 2
    ranked, ranked_joined = sorted(own), sorted(joined)
    sums = [0.0, *accumulate(x**power for x in ranked)]
    square, *squares = _around([x * x for x in own], [x * x for x in joined])
    least = math.sqrt(min([square, *squares]))
    out = []
    for x in own:
        at = bisect_right(ranked_joined, x)
        most = sums[bisect_right(ranked, x)] + (ranked_joined[at - 1] ** power if at else 0.0)
        out.append(most ** (1 / power) * norm >= LEAST * least - 1e-9)
    for x, length in zip(joined, squares, strict=True):
        out.append((sums[bisect_right(ranked, x)] + x**power) ** (1 / power) * norm >= LEAST * math.sqrt(length) - 1e-9)
    return out


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs by place (words, then neighbours as one; -1: all as one), weights by place, and the words by which alone a
    name can come to LEAST."""
    for batch in batches:
        kept, weighed, wanted = [], [], []
        for tokens, found, unknown, norm in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True):
            by, n, all_ = {f["token"]: f["found"] for f in found}, len(tokens), "".join(tokens)
            places = [*tokens, *_joined(tokens)]
            best = [max(by[t], key=lambda x: (x["alike"], x["word"])) if by.get(t) else None for t in places]
            weights = [b["weight"] if b else unknown * min(1.0, len(t) / 5) for t, b in zip(places, best, strict=True)]
            # Whether two places of one reading may be the same word.
            once: dict[str, int] = {}
            several = False
            for i, t in enumerate(places):
                for x in by.get(t) or ():
                    if i < n:
                        several |= x["word"] in once
                        once[x["word"]] = i
                    else:
                        several |= once.get(x["word"], i - n) not in (i - n, i - n + 1)
            heavy = {t for t, ok in zip(places, _wanted(weights[:n], weights[n:], several, norm), strict=True) if ok}
            spots = [*enumerate(places), *([(-1, all_)] if n > 2 else [])]
            kept.append([{"at": i, "word": x["word"], "alike": x["alike"]} for i, t in spots for x in by.get(t) or ()])
            weighed.append(weights)
            wanted.append(sorted({x["word"] for t in {*heavy, all_} for x in by.get(t) or ()}))
        pairs = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string()), ("alike", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept, pairs), pa.array(weighed, pa.list_(pa.float64())), pa.array(wanted, pa.list_(pa.string()))], names=[*batch.schema.names[:4], "repairs", "weights", "wanted"])


def _scored(accept: dict[str, float]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for kind, tokens, fixed, weights, whole, words, parts in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                part, n = dict(zip(words, parts, strict=True)), len(tokens)
                best, as_one = [0.0] * len(weights), 0.0
                for x in fixed:
                    if x["word"] in part:
                        if x["at"] < 0:
                            as_one = max(as_one, part[x["word"]] * x["alike"])
                        else:
                            best[x["at"]] = max(best[x["at"]], part[x["word"]] * x["alike"])
                given, squares = [w * b for w, b in zip(weights, best, strict=True)], [w * w for w in weights]
                softs = (x / math.sqrt(y) for x, y in zip(_around(given[:n], given[n:]), _around(squares[:n], squares[n:]), strict=True))
                # All readings spell the same whole, so that the one with the most soft TF-IDF scores best.
                soft = min(1.0, max(as_one, *softs))
                least = 2 * accept.get(kind, ACCEPT) - soft
                score = 0.0
                if soft >= LEAST and least <= 1:
                    score = (soft + max(similarity("".join(tokens), whole, max(0.0, least, soft * SHUFFLED)), soft * SHUFFLED)) / 2
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], names=["kind", "value", "ref_id", "score"])

    return run


def match(values: DataFrame, entries: DataFrame, accept: dict[str, float] | None = None) -> DataFrame:
    """(kind, value, ref_id, score) for every distinct (kind, value): the entry meant, or 0.

    entries: (ref_id, kind, entry_name, also_known_as). Each value is read in several ways (see `readings`); each
    distinct token of all values is repaired to words of the names of its kind by edit distance, and the names that share
    a weighty word are ranked by soft TF-IDF: the product of the token weights (how rare a word is among names) times
    the similarity of the repair. The score is the mean of that and of the similarity of the whole spelling. A score
    under `accept` of the kind, else under ACCEPT, an empty value or one of fillers only gives ref_id 0 and score 0, however
    long the others are. Of equal scores the smallest ref_id wins. Null values and entries without
    name or kind are left out. Values are made distinct first, so that hot ones count once; weights are those of all
    names, whatever their number, and every name is scored that can come to LEAST.
    """
    values = values.where("kind is not null and value is not null").select("kind", "value").distinct()
    names, words = names_of(entries)
    read = cut(_spread(values, "kind", "value").mapInArrow(_read, "kind string, value string, reading int, tokens array<string>, every array<string>"))
    tokens = read.select("kind", F.explode("every").alias("token"))
    found = repairs(tokens, words).join(small(words.select("kind", "word", "weight")), ["kind", "word"])
    by_token = found.groupBy("kind", "token").agg(F.collect_list(F.struct("word", "alike", "weight")).alias("found"))
    length = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x * x, F.sqrt)
    kinds = words.groupBy("kind").agg(F.max("unknown").alias("unknown")).join(names.groupBy("kind").agg(F.max(length).alias("norm")), "kind")
    rows = read.join(small(kinds), "kind")
    each = rows.select("kind", "value", "reading", F.explode("every").alias("token")).join(by_token, ["kind", "token"])
    held = each.groupBy("kind", "value", "reading").agg(F.collect_list(F.struct("token", "found")).alias("found"))
    weighed = cut(rows.join(held, ["kind", "value", "reading"]).select("kind", "value", "reading", "tokens", "found", "unknown", "norm").mapInArrow(_weigh, "kind string, value string, reading int, tokens array<string>, repairs array<struct<at int, word string, alike double>>, weights array<double>, wanted array<string>"))
    holders = names.select("kind", "name_id", F.explode("words").alias("word"))
    pairs = weighed.select("kind", "value", "reading", F.explode("wanted").alias("word")).join(small(holders), ["kind", "word"]).select("kind", "value", "reading", "name_id").distinct()
    both = pairs.join(weighed, ["kind", "value", "reading"]).join(small(names), ["kind", "name_id"])
    score = _spread(both, "value", "name_id").select("kind", "value", "ref_id", F.col("kind").alias("own"), "tokens", F.filter("repairs", lambda x: F.array_contains("words", x["word"])).alias("repairs"), "weights", "whole", "words", "parts").mapInArrow(_scored(accept or {}), "kind string, value string, ref_id bigint, score double")
    least = F.lit(ACCEPT)
    for kind, own in (accept or {}).items():
        least = F.when(F.col("kind") == kind, F.lit(own)).otherwise(least)
    top = score.where(F.col("score") >= least).groupBy("kind", "value").agg(F.max(F.struct("score", (-F.col("ref_id")).alias("ref"))).alias("top"))
    return values.join(top, ["kind", "value"], "left").select("kind", "value", F.coalesce(-F.col("top.ref"), F.lit(0).cast("bigint")).alias("ref_id"), F.coalesce("top.score", F.lit(0.0)).alias("score"))
