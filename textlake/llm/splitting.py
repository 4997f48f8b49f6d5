"""Splitting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary from the strongest to the weakest; the text may be cut after each match.
LEVELS = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…।॥؟۔።፧։။។៕།༎][\"'’”»)\]]*\s+|[。！？｡၊။។៕།༎][」』）”]*\s*"),
    re.compile(r"[,;:،፣፤]\s+|[，、；：]\s*"),
    re.compile(r"\s+"),
]
#: Characters that one step of the last resort, cutting inside an unbroken run, takes at most.
RUN = 64
#: Long texts that a task holds as Python strings at once, with their pieces.
ROWS = 256

SCHEMA = "chunk_id bigint, piece_no int, char_start int, char_end int, chunk_text string"


def _joined(text: str, at: int) -> bool:
    """Whether the character at `at` belongs to the one before it (accents, joiners, variation selectors)."""
    return unicodedata.category(text[at]) in ("Mn", "Mc", "Me", "Cf") or text[at - 1] == "‍"


def _atoms(text: str, start: int, end: int, room: int, level: int, out: list[tuple[int, int]], above: int) -> None:
    """Appends (start, strength of the boundary before it) for segments of text[start:end] of at most `room` characters.

    A segment that fits is not taken apart further: merging, weakest boundaries first, would put it together again
    before any boundary around it is touched, since every part of it fits.
    """
    if end - start <= room:
        out.append((start, above))
        return
    if level == len(LEVELS):
        step = max(1, min(RUN, room // 2))
        while start < end:
            out.append((start, above))
            above, nxt = 0, min(end, start + step)
            while start + 1 < nxt < end and _joined(text, nxt):
                nxt -= 1
            if nxt == start + 1 and nxt < end and _joined(text, nxt):  # a cluster longer than the step is cut
                nxt = min(end, start + step)
            start = nxt
        return
    strength = len(LEVELS) - level
    for m in LEVELS[level].finditer(text, start, end):
        if m.end() < end:
            _atoms(text, start, m.end(), room, level + 1, out, above)
            start, above = m.end(), strength
    _atoms(text, start, end, room, level + 1, out, above)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets [start, end) of the pieces of `text`, each of at most `limit` characters (code points).

    Each piece but the first begins `overlap` characters before its own part, or where the letter that stands there has
    all its accents behind it: such a letter is cut only if it is longer than the overlap itself. Adjacent segments wait in a
    heap; the weakest boundary is merged first (of equals, the smaller union, then the earlier) as long as the union
    and its overlap fit. An overlap above half the limit counts as half of it, so that pieces always advance; a limit
    under 1 counts as 1. A text that fits is one piece; an empty text has none.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    found: list[tuple[int, int]] = []
    _atoms(text, 0, n, limit - overlap, 0, found, len(LEVELS))
    starts = [s for s, _ in found]
    strength = [b for _, b in found]
    ends = [*starts[1:], n]
    k = len(starts)
    prev, nxt, version = list(range(-1, k - 1)), list(range(1, k + 1)), [0] * k
    heap: list[tuple[int, int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < k and ends[j] - starts[i] + (overlap if starts[i] else 0) <= limit:
            heapq.heappush(heap, (strength[j], ends[j] - starts[i], i, j, version[i], version[j]))

    for i in range(k - 1):
        offer(i)
    while heap:
        _, _, i, j, vi, vj = heapq.heappop(heap)
        if version[i] != vi or version[j] != vj:
            continue
        ends[i], nxt[i] = ends[j], nxt[j]
        version[i] += 1
        version[j] = -1
        if nxt[i] < k:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < k:
        begin = max(0, starts[i] - overlap)
        while 0 < begin < starts[i] and _joined(text, begin):
            begin += 1
        out.append((begin, ends[i]))
        i = nxt[i]
    return out


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """`chunks` as (chunk_id, text, max_chars, overlap_chars): the limit of the section up to " > ", else of DEFAULT.

    Sections compare without case and outer white space; of several limits for one section the smallest holds. Null
    sections take DEFAULT; without a DEFAULT row their limits are null.
    """
    name = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    least = (
        limits.where(F.col("max_chars").isNotNull())
        .select(name(F.col("section_name")).alias("_name"), F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).alias("_own"))
        .groupBy("_name")
        .agg(F.min("_own").alias("_own"))
    )
    default = least.where("_name = 'default'").agg(F.first("_own").alias("_default"))  # one row, whatever the table
    return (
        chunks.select(F.col("chunk_id"), F.col("chunk_text").alias("text"), name(F.substring_index("section_name", " > ", 1)).alias("_name"))
        .join(least, "_name", "left")
        .join(F.broadcast(default))  # a cross join with that row
        .select("chunk_id", "text", F.coalesce("_own.max_chars", "_default.max_chars").alias("max_chars"), F.coalesce("_own.overlap_chars", "_default.overlap_chars").alias("overlap_chars"))
    )


def split_oversized(chunks: DataFrame, limits: DataFrame, keep_whole: bool = False) -> DataFrame:
    """The pieces (chunk_id, piece_no, char_start, char_end, chunk_text) of every chunk longer than its limit.

    Offsets count code points in the chunk's own text, the end is exclusive, piece_no counts from 0. With
    `keep_whole` the other chunks come out too, as one piece each. Only oversized texts reach Python; there is no
    shuffle, whatever chunk or section is hot. Nulls: a null text has no pieces, a null id stays null, a null section
    takes DEFAULT, a null limit means no limit. Empty texts are never oversized. Repeated rows come out repeatedly.
    Other columns of either table are ignored.
    """
    rows = with_limits(chunks, limits)
    long = F.col("max_chars").isNotNull() & (F.length("text") > F.greatest(F.col("max_chars"), F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            cols: list[list] = [[], [], [], [], []]
            for key, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for no, (a, b) in enumerate(pieces(text, limit, overlap)):
                    for col, value in zip(cols, (key, no, a, b, text[a:b]), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["chunk_id", "piece_no", "char_start", "char_end", "chunk_text"])

    out = rows.where(long).select(F.col("chunk_id").cast("bigint"), "text", "max_chars", "overlap_chars").mapInArrow(run, SCHEMA)
    if keep_whole:
        whole = rows.where((F.length("text") > 0) & ~F.coalesce(long, F.lit(False)))
        out = out.unionByName(whole.select(F.col("chunk_id").cast("bigint"), F.lit(0).alias("piece_no"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.col("text").alias("chunk_text")))
    return out
