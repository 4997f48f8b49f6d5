"""Mixing sources to target weights: capped water-filling over token counts, seeded whole and fractional repetitions."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.sources.tables import cut, small

#: Where the vocabulary files of public tokenizers lie, and the one whose tokens are counted.
TOKENIZERS, VOCABULARY = os.environ.get("TEXTLAKE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Equal parts of the range of the documents' seeded hashes in which the tokens of a source are cumulated.
PARTS = 4096
SEED = 7


def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): the tokens of each whole text; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(folder, name)
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def water_fill(sizes: dict[str, float], shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Repetitions (epochs) of each source: the largest mix without a source above its cap that meets the shares.

    The total is what all sources together hold. A source whose share asks for more than its cap allows is clamped at
    the cap, and what it leaves is spread over the others in proportion to their shares, again and again until no
    source is above its cap; if all are, the mix is smaller. A source without size or share gets no repetition.
    This is the rule in plain form; `plan` finds the same level by one sort, whatever the number of sources.
    """
    total = sum(sizes.values())
    open_ = {s for s in shares if shares[s] > 0 and sizes.get(s, 0) > 0 and caps.get(s, 0) > 0}
    given: dict[str, float] = {}
    left = float(total)
    while open_:
        whole = sum(shares[s] for s in open_)
        wanted = {s: left * shares[s] / whole for s in open_}
        over = {s for s in open_ if wanted[s] > caps[s] * sizes[s]}
        if not over:
            given |= wanted
            break
        for s in sorted(over):
            given[s] = caps[s] * sizes[s]
            left -= given[s]
        open_ -= over
        left = max(left, 0.0)
    return {s: given.get(s, 0.0) / sizes[s] if sizes.get(s, 0) > 0 else 0.0 for s in shares}


def plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, repeats): one row for each source that is aimed at.

    counted: (doc_id, source, tokens). Sources compare by their exact name; those of only one table get no repetition:
    nothing of a source without target is used, and a source without documents leaves its share to the others. Null
    sources have no target. Of several rows for a source the first by share and cap holds. Null shares and caps count
    as 0. Tokens are summed over all documents, partly before the shuffle.

    Sources are clamped in order of what their cap allows for a share of 1: the first that its cap doesn't clamp gives
    the level at which all later ones stand, so that one sort of the sources (no documents) does for any number.
    """
    held = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    aims = targets.where("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))).alias("own"))
    rows = aims.join(held, "source", "left").select("source", F.col("own.share").alias("target_share"), F.col("own.cap").alias("max_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    # A few rows for sources without end; they needn't be many to be sorted in one task.
    rows = cut(rows)
    open_ = rows.where("target_share > 0 and tokens > 0 and max_repeats > 0").withColumn("room", F.col("tokens") * F.col("max_repeats"))
    sums = rows.agg(F.sum("tokens").alias("total"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("room") / F.col("target_share"), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("target_share").over(after)
    levels = open_.join(F.broadcast(sums)).withColumn("level", level).where(F.col("level") <= F.col("room") / F.col("target_share")).agg(F.min_by("level", F.col("room") / F.col("target_share")).alias("level"))
    given = open_.join(F.broadcast(levels)).select("source", (F.least("room", F.coalesce(F.col("level") * F.col("target_share"), "room")) / F.col("tokens")).alias("repeats"))
    return rows.join(given, "source", "left").select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"), "documents", "tokens", F.coalesce("repeats", F.lit(0.0)).alias("repeats"))


def mix(counted: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used, at least once.

    Every document of a source is used as often as its repetitions have whole turns. For the rest, documents are taken
    in order of a seeded hash as long as they don't bring the source above its planned tokens: each source misses its
    plan by less than one document. Copies are never above the cap. The hash depends on the seed, the id and the source
    only, so that the choice is the same on any cluster. Tokens are cumulated over PARTS ranges of the hash first; only
    the range that holds the end of the plan is sorted, so that no source is gathered in one task. Repeated rows of one
    id, and documents with null id, are taken in turn by their tokens.
    """
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), F.lit(1 << 40))
    aims = small(planned.where("repeats > 0").select("source", "max_repeats", F.least(F.floor("repeats"), "max_repeats").cast("int").alias("whole"), (F.when(F.floor("repeats") < F.col("max_repeats"), F.col("repeats") - F.floor("repeats")).otherwise(0.0) * F.col("tokens")).alias("rest")))
    rows = counted.select("doc_id", "source", "tokens", hashed.alias("at")).withColumn("part", F.floor(F.col("at") / F.lit((1 << 40) // PARTS)).cast("int")).join(aims, "source")
    sums = rows.groupBy("source", "part").agg(F.sum("tokens").alias("own"))  # at most PARTS rows a source
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("source", "part", "own", F.coalesce(F.sum("own").over(run), F.lit(0)).alias("before"))
    ends = cut(begun.join(aims.select("source", "rest"), "source").where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("own") > F.col("rest"))).select("source", F.col("part").alias("end_part"), "before"))
    known = rows.join(small(ends), "source", "left")
    within = Window.partitionBy("source").orderBy("at", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = known.where("part = end_part").withColumn("more", (F.col("before") + F.sum("tokens").over(within) <= F.col("rest")).cast("int"))
    # A source whose plan ends with all its documents has no part in which it ends.
    other = known.where("end_part is null or part != end_part").withColumn("more", F.when(F.col("end_part").isNull(), F.col("rest") > 0).otherwise(F.col("part") < F.col("end_part")).cast("int"))
    copies = F.least("max_repeats", F.col("whole") + F.col("more"))
    return other.unionByName(edge).select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def report(counted: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, target_share, actual_share, repeats, max_copies, documents, used_documents, tokens, used_tokens)."""
    planned = plan(counted, targets)
    used = mix(counted, planned, seed).groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("max_copies"))
    rows = planned.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    share = F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy()))  # one row for each target
    return rows.select("source", "target_share", share.alias("actual_share"), "repeats", F.coalesce("max_copies", F.lit(0)).alias("max_copies"), "documents", F.coalesce("used_documents", F.lit(0)).alias("used_documents"), "tokens", "used_tokens")
