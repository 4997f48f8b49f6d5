"""From texts to blocks, headings, sections and spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.sources.tables import small

SENTENCE = r"([^.!?]+[.!?]+)"
BULLET = r"^\s*([•*◦–-]|\d+\.|[a-z]\))\s+(.+)$"
HEADING = r"^(#{1,6})\s+(.+)$"
SEPARATOR = r"^\|[\s:-]+\|$"


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_id, text): every line, also blank ones, numbered from 0."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("block_id", "text"))


def markdown_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_id, text, level, font_size, font_weight): lines that aren't blank; headings are larger and bold."""
    level = F.length(F.regexp_extract("text", HEADING, 1))
    body = lines(rows, key, text).where(F.trim("text") != "").withColumn("block_id", (F.row_number().over(Window.partitionBy(key).orderBy("block_id")) - 1).cast("int"))
    shown = F.when(level > 0, F.trim(F.regexp_extract("text", HEADING, 2))).otherwise(F.trim("text"))
    return body.select(key, "block_id", shown.alias("text"), level.alias("level"), F.when(level > 0, 18 - 2 * level).otherwise(F.lit(12)).alias("font_size"), F.when(level > 0, 700).otherwise(400).alias("font_weight"))


def page_blocks(pages: DataFrame, key: str) -> DataFrame:
    """markdown_blocks of the pages (key, page_num, text) of each document, numbered through, with page_num."""
    level = F.length(F.regexp_extract("text", HEADING, 1))
    each = pages.select(key, "page_num", F.posexplode(F.split("text", "\n")).alias("_line", "text")).where(F.trim("text") != "")
    numbered = each.withColumn("block_id", (F.row_number().over(Window.partitionBy(key).orderBy("page_num", "_line")) - 1).cast("int"))
    shown = F.when(level > 0, F.trim(F.regexp_extract("text", HEADING, 2))).otherwise(F.trim("text"))
    return numbered.select(key, "page_num", "block_id", shown.alias("text"), level.alias("level"))


def layout_blocks(pages: DataFrame, key: str) -> DataFrame:
    """(key, block_id, text, font_size, font_weight) of pages (key, cells, elements): the cells, or where there are none the
    elements; a block without size or weight has 12 and 400."""
    each = pages.select(key, F.posexplode(F.when(F.size("cells") > 0, F.col("cells")).otherwise(F.col("elements"))).alias("block_id", "b"))
    return each.select(key, "block_id", "b.text", F.coalesce("b.font_size", F.lit(12.0)).alias("font_size"), F.coalesce("b.font_weight", F.lit(400)).alias("font_weight"))


def heading_candidates(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks (key, block_id, text, font_weight) that may be headings, with how many of six signals speak for each.

    The case of a heading is asked for, and three signals in all: case, fewer than 80 characters, no mark of a
    sentence's end, nothing before or after it, a weight of at least the upper median of its text, a block's start.
    """
    order = Window.partitionBy(key).orderBy("block_id")
    # The upper median from counts of the few weights there are, so that no text's blocks are gathered.
    counts = blocks.groupBy(key, "font_weight").agg(F.count("*").alias("_n"))
    run, whole = Window.partitionBy(key).orderBy("font_weight"), Window.partitionBy(key)
    reached = counts.withColumn("_upto", F.sum("_n").over(run)).withColumn("_half", F.floor(F.sum("_n").over(whole) / 2))
    weights = reached.where(F.col("_upto") > F.col("_half")).groupBy(key).agg(F.min("font_weight").alias("_median"))
    empty = lambda c: c.isNull() | (F.trim(c) == "")
    seen = blocks.withColumn("_before", F.lag("text").over(order)).withColumn("_after", F.lead("text").over(order)).join(weights, key)
    t = F.trim("text")
    case = T.all_capitals(t) | T.title_case(t)
    signals = F.lit(1) + case.cast("int") + (F.length(t) < 80).cast("int") + (~t.rlike(r"[.!?;:]$")).cast("int") + (empty(F.col("_before")) | empty(F.col("_after"))).cast("int") + (F.col("font_weight") >= F.col("_median")).cast("int")
    return seen.where((t != "") & case).select(key, "block_id", t.alias("text"), T.header_words(t).alias("words"), signals.alias("signals"), F.round(F.least(F.lit(0.9), signals / 6 + 0.3), 6).alias("confidence")).where("signals >= 3")


def categories(headers: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(header, category, confidence): the category of each distinct header in words.

    synonyms: (category, synonym, ord). Equal counts 1, either within the other 0.8; the longest synonym wins, then the
    earlier. A header without words matches nothing.
    """
    asked = headers.select("header").distinct()
    inside = F.expr("length(header) > 0 and (contains(header, synonym) or contains(synonym, header))")
    met = asked.join(small(synonyms, 5000), inside)
    best = met.groupBy("header").agg(F.max_by(F.struct("category", F.when(F.col("header") == F.col("synonym"), 1.0).otherwise(0.8).alias("confidence")), F.struct(F.length("synonym"), -F.col("ord"))).alias("best"))
    return asked.join(best, "header", "left").select("header", F.coalesce("best.category", F.lit("other")).alias("category"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"))


def boundaries(blocks: DataFrame, heads: DataFrame, synonyms: DataFrame, key: str) -> DataFrame:
    """(key, start_block, end_block, heading, category, confidence): each heading (key, block_id, text) up to the next one, or
    to the end of the blocks (key, block_id), with its category; other, 0.3, where no synonym fits."""
    ends = blocks.groupBy(key).agg((F.max("block_id") + 1).alias("_end"))
    named = heads.select(key, "block_id", F.col("text").alias("heading"), T.header_words("text").alias("header"))
    known = categories(named.select("header"), synonyms)
    nxt = F.lead("block_id").over(Window.partitionBy(key).orderBy("block_id"))
    placed = named.withColumn("_next", nxt).join(ends, key).join(known, "header", "left")
    none = F.coalesce("category", F.lit("other")) == "other"
    return placed.select(key, F.col("block_id").alias("start_block"), F.coalesce("_next", "_end").alias("end_block"), "heading", F.coalesce("category", F.lit("other")).alias("category"), F.when(none, F.lit(0.3)).otherwise(F.col("confidence")).alias("confidence"))


def sections_of(blocks: DataFrame, heads: DataFrame, key: str, page: str | None = None) -> DataFrame:
    """(key, section_no, heading, start_block, end_block, content): blocks from each heading up to the next; with the name of
    a column of pages also page_start and page_end.

    What stands before the first heading, or all of a text without one, is section 0 with a null heading.
    """
    flagged = blocks.join(heads.select(key, "block_id", F.lit(1).alias("_head")), [key, "block_id"], "left")
    order = Window.partitionBy(key).orderBy("block_id")
    owned = flagged.withColumn("section_no", F.sum(F.coalesce("_head", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("block_id", F.trim("text").alias("text"))))
    grouped = owned.groupBy(key, "section_no").agg(F.min(F.when(F.col("_head") == 1, F.struct("block_id", "text"))).alias("_h"), F.min("block_id").alias("start_block"), (F.max("block_id") + 1).alias("end_block"), parts.alias("_p"), *([F.min(page).alias("page_start"), F.max(page).alias("page_end")] if page else []))
    return grouped.select(key, *(["page_start", "page_end"] if page else []), F.col("section_no").cast("bigint").alias("section_no"), F.col("_h.text").alias("heading"), "start_block", "end_block", F.array_join(F.filter(F.transform("_p", lambda p: p["text"]), lambda x: x != ""), "\n").alias("content"))


def sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sequence_num, text): runs up to marks, of more than ten characters; numbers count all runs."""
    out = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))).alias("sequence_num", "text"))
    return out.withColumn("text", F.trim("text")).where(F.length("text") > 10)


def bullets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sequence_num, text): lines with a bullet, number or letter in front, of more than five characters."""
    found = lines(rows, key, text).withColumn("item", F.trim(F.regexp_extract("text", BULLET, 2))).where(F.length("item") > 5)
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("block_id")) - 1).cast("int").alias("sequence_num"), F.col("item").alias("text"))


def table_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, text): lines with bars that are no separators; a blank line begins another table."""
    order = Window.partitionBy(key).orderBy("block_id")
    cut = lines(rows, key, text).withColumn("table_no", F.sum((F.trim("text") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = cut.where(F.contains("text", F.lit("|")) & ~F.trim("text").rlike(SEPARATOR) & (F.length(F.trim("text")) > 5))
    return kept.select(key, F.col("table_no").cast("int").alias("table_no"), (F.row_number().over(Window.partitionBy(key, "table_no").orderBy("block_id")) - 1).cast("int").alias("row_no"), F.trim("text").alias("text"))


CAPTION = r"(?is)(?:^|\n)((?:figure|fig\.|table|chart|diagram)\s+\d+[.:].+|(?:note|footnote|warning|caution):.+)"


def captions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, text): figure and table captions and notes at line starts, up to the end of their paragraph, of more
    than ten characters."""
    parts = rows.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("paragraph", "_p"))
    return parts.select(key, "paragraph", T.squeeze(F.regexp_extract("_p", CAPTION, 1)).alias("text")).where(F.length("text") > 10)


def spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_type, sequence_num, text): sentences, bullets, table rows and captions of each text."""
    own = rows.where(F.col(text).isNotNull())
    kinds = {"sentence": sentences(own, key, text), "bullet": bullets(own, key, text), "table_row": table_rows(own, key, text).withColumn("sequence_num", F.row_number().over(Window.partitionBy(key).orderBy("table_no", "row_no")) - 1), "caption": captions(own, key, text).withColumn("sequence_num", F.col("paragraph"))}
    out = None
    for kind, df in kinds.items():
        one = df.select(key, F.lit(kind).alias("text_type"), F.col("sequence_num").cast("int").alias("sequence_num"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def backfill(rows: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """The spans of the rows that have none in `stored` (key) yet."""
    return spans(rows.join(stored.select(key).distinct(), key, "left_anti"), key, text)


def line_headers(rows: DataFrame, key: str, text: str, headers: DataFrame) -> DataFrame:
    """(key, line_no, header): lines that are a known header (header, ord), with or without a colon, hold one or lie in one.

    An exact header wins, then the first by its order. A list of some thousand headers is broadcast, as parts of
    strings can't be joined by equality.
    """
    each = lines(rows, key, text).withColumn("_u", F.upper(F.trim("text"))).where(F.col("_u") != "").withColumn("_u", F.trim(F.regexp_replace("_u", ":$", ""))).where(F.col("_u") != "")
    distinct = each.select("_u").distinct()
    met = distinct.join(small(headers.select(F.upper("header").alias("header"), "ord"), 5000), F.expr("contains(_u, header) or contains(header, _u)"))
    best = met.groupBy("_u").agg(F.min_by("header", F.struct(F.col("_u") != F.col("header"), "ord")).alias("header"))
    return each.join(best, "_u").select(key, F.col("block_id").alias("line_no"), "header")


def page_sections(rows: DataFrame, key: str, text: str, headers: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """(key, section): the last known header of each page's text, and " > " and the first part whose wording the text holds."""
    last = line_headers(rows, key, text, headers).groupBy(key).agg(F.max_by("header", "line_no").alias("_h"))
    low = F.lower(text)
    part = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w)), F.lit(name)) for name, ws in parts.items()))
    return rows.select(key, part.alias("_s")).join(last, key, "left").select(key, F.concat_ws(" > ", "_h", "_s").alias("section")).where("section != ''")


def attach_images(sections: DataFrame, images: DataFrame, key: str, header: str, words: list[str]) -> DataFrame:
    """`sections` with `images`: all of their document's (key, images), where the header holds one of the words, else none."""
    about = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(header), w))
    return sections.join(images, key, "left").withColumn("images", F.when(F.coalesce(about, F.lit(False)), F.coalesce("images", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


#: What a text is cut at, the widest first; the last resort is between any two characters.
PARTINGS = ("\n\n", "\n", ". ", " ", "")


def _recursive(text: str, size: int, overlap: int, partings: tuple[str, ...] = PARTINGS) -> list[str]:
    """Pieces of at most `size` characters: parts at the widest parting are packed, too long ones are cut at the next."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sign, rest = partings[0], partings[1:]
    if not sign:
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)]
    if sign not in text:
        return _recursive(text, size, overlap, rest)
    parts = text.split(sign)
    parts = [p + sign for p in parts[:-1]] + parts[-1:]
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part) > size:
            out += ["".join(held)] if held else []
            out += _recursive(part, size, overlap, rest)
            held = []
            continue
        if sum(map(len, held)) + len(part) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    return [p for p in [*out, "".join(held)] if p.strip()]


def recursive_chunks(rows: DataFrame, key: str, text: str, large: str | None = None, sizes: tuple[int, int] = (1200, 2000), overlap: int = 200) -> DataFrame:
    """(key, piece_no, text): pieces of at most sizes[0] characters, sizes[1] where the column `large` is true, cut at
    paragraphs, lines, sentences, words or characters, with whole parts of up to `overlap` characters repeated.

    Packing goes from piece to piece within one text, which no column expression can say; texts go through it in Arrow
    batches and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, pieces = [], [], []
            for k, t, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, piece in enumerate(_recursive(t, sizes[bool(wide)], overlap)):
                    keys.append(k)
                    numbers.append(i)
                    pieces.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], names=[key, "piece_no", "text"])

    own = rows.where(F.col(text).isNotNull()).select(key, text, (F.col(large) if large else F.lit(False)).alias("_wide"))
    return own.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, piece_no int, text string")


def stride(rows: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, piece_no, char_start, char_end, text): pieces of a fixed size, each beginning `overlap` before the last's end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    out = rows.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no") * step
    return out.select(key, "piece_no", start.alias("char_start"), F.least(start + size, F.length("_t")).alias("char_end"), F.substring(F.col("_t"), start + 1, F.lit(size)).alias("text"))


def carried_sections(pages: DataFrame, key: str, order: str, found: str) -> DataFrame:
    """Pages with `section`: the last one found so far."""
    return pages.withColumn("section", F.last(found, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def image_names(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, source, name): each picture of a row (original_filename, document_hash, image_paths) with the name it is kept
    under: the file's stem, eight digits of its hash and its number."""
    each = rows.select(key, "original_filename", "document_hash", F.posexplode("image_paths").alias("n", "source"))
    stem = F.regexp_replace("original_filename", r"\.[^.]*$", "")
    return each.select(key, "n", "source", F.concat(stem, F.lit("_"), F.substring("document_hash", 1, 8), F.lit("_img"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".png")).alias("name"))


def first_page_names(rows: DataFrame, key: str, text: str, file: str) -> DataFrame:
    """(key, name): the first of a text's first twenty lines that gives a name: after Pr at its start, under a line with
    PRODUCT MONOGRAPH, or all in capitals and no heading; else the file's name."""
    each = rows.select(key, F.posexplode(F.slice(F.split(text, "\n"), 1, 21)).alias("n", "_x")).withColumn("_t", F.trim("_x"))
    each = each.withColumn("_next", F.lead("_t").over(Window.partitionBy(key).orderBy("n")))
    size = F.length("_t")
    found = F.when(F.col("_t").startswith("Pr") & size.between(6, 51), F.trim(F.substring("_t", 3, 60))).when(F.contains(F.upper("_t"), F.lit("PRODUCT MONOGRAPH")) & F.length("_next").between(4, 49), F.col("_next")).when(F.col("_t").rlike(r"\p{Lu}") & ~F.col("_t").rlike(r"\p{Ll}") & size.between(4, 49) & ~F.col("_t").rlike("PAGE|TABLE|PART|SECTION"), F.col("_t"))
    best = each.where("n < 20").withColumn("name", found).where("name is not null").groupBy(key).agg(F.min_by("name", "n").alias("name"))
    return rows.select(key, file).join(best, key, "left").select(key, F.coalesce("name", file).alias("name"))
