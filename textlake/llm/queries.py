"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import leakage, lookalikes, mapping, mixture, nearcopies, scans, sentences, splitting
from textlake.sources.tables import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that come out in pieces."""
    made = splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))
    return made.where("piece_no = 1").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All chunks within their limits."""
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"), keep_whole=True)


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, scans.Lexicon]:
    """(field, record_key, text) of chunks and parsed documents, and what they teach."""
    chunks = table(spark, d, "chunks").select(F.lit("chunk_text").alias("field"), F.col("chunk_id").cast("string").alias("record_key"), F.col("chunk_text").alias("text"))
    parsed = table(spark, d, "parsed_documents").select(F.lit("raw_text").alias("field"), F.col("document_hash").alias("record_key"), F.col("raw_text").alias("text"))
    texts = chunks.unionByName(parsed)
    return texts, scans.learn(texts, parsed)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The damaged lines of scanned texts."""
    return scans.damaged(*_scanned(spark, d)).distinct()


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """All texts as continuous paragraphs."""
    return scans.repaired(*_scanned(spark, d))


def _near(spark: SparkSession, d: str, operator: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """`operator` over the chunks, and over the spellings of drug names."""
    chunks = table(spark, d, "chunks").select(F.col("chunk_id").cast("string").alias("id"), F.col("chunk_text").alias("text"))
    names = table(spark, d, "monograph_sections").select(F.col("drug_name").alias("id"), F.col("drug_name").alias("text")).distinct()
    return operator(chunks, "word", 3, 0.7, 3), operator(names, "letter", 3, 0.6, 2)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate chunks, and of spellings of drug names."""
    chunks, names = _near(spark, d, nearcopies.near_pairs)
    return chunks.select(F.lit("chunk_text").alias("field"), "key_a", "key_b").unionByName(names.select(F.lit("drug_name").alias("field"), "key_a", "key_b")).distinct()


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """(field, span_key, text, type) of stored and extracted spans."""
    stored = table(spark, d, "fact_spans").select(F.lit("sentence_text").alias("field"), F.col("fact_span_id").alias("span_key"), F.col("sentence_text").alias("text"), F.col("source_type").alias("type"))
    fresh = table(spark, d, "extracted_spans").select(F.lit("text").alias("field"), F.col("span_id").alias("span_key"), "text", F.col("text_type").alias("type"))
    return stored.unionByName(fresh)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk and every spelling of a drug name with its group of near-duplicates."""
    chunks, names = _near(spark, d, nearcopies.near_classes)
    return chunks.select(F.lit("chunk_text").alias("field"), "id", "group").unionByName(names.select(F.lit("drug_name").alias("field"), "id", "group"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk and every spelling of a drug name with its group and its number of near-duplicates."""
    chunks, names = _near(spark, d, nearcopies.near_links)
    return chunks.select(F.lit("chunk_text").alias("field"), "id", "group", "links").unionByName(names.select(F.lit("drug_name").alias("field"), "id", "group", "links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of all spans."""
    spans = _spans(spark, d)
    return sentences.split(spans, sentences.train(spans)).distinct()


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """(field, kind, row_id, value) of the four typed fields."""
    sections, names = table(spark, d, "section_mappings"), table(spark, d, "drug_names")
    fields = ((sections, "original_header", "section"), (sections, "normalized_name", "section"), (names, "brand_name", "brand"), (names, "generic_name", "generic"))
    out = None
    for df, name, kind in fields:
        one = df.where(F.col(name).isNotNull()).select(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.col("id").alias("row_id"), F.col(name).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry meant by each typed value, or 0."""
    typed = _typed(spark, d)
    meant = mapping.match(typed, table(spark, d, "canonical_entries"), {"section": mapping.ACCEPT_PHRASE})
    return typed.join(meant, ["kind", "value"]).select("field", "row_id", "ref_id").distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, by field, with the rows that hold them."""
    typed = _typed(spark, d)
    meant = mapping.match(typed, table(spark, d, "canonical_entries"), {"section": mapping.ACCEPT_PHRASE}).where("ref_id = 0")
    return typed.join(meant, ["kind", "value"]).groupBy("field", "value").agg(F.count("*").alias("rows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items with which they share 13 words in a row."""
    hits = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.where(F.col("longest_run") >= leakage.EXACT).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """For every item that leaked, in part or edited: documents, longest run of its words, best similarity."""
    hits = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest_run").alias("longest_run"), F.max("best").alias("best"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their tokens, counted once."""
    return cut(mixture.with_tokens(table(spark, d, "documents")))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mix of all sources."""
    counted = _counted(spark, d)
    return mixture.mix(counted, mixture.plan(counted, table(spark, d, "source_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.report(_counted(spark, d), table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that read the same but are stored with other characters."""
    return lookalikes.same_look(table(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its one form."""
    return lookalikes.canonical(table(spark, d, "documents"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the group of those that read the same."""
    return lookalikes.look_groups(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_texts, p3_found, p3_groups, p3_links, p4_found, p5_found, p5_unmatched, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_groups, p8_texts)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables."""
    return {
        "p1_found": r"""
            SELECT DISTINCT c.chunk_id FROM chunks c
            LEFT JOIN chunk_limits l ON lower(trim(l.section_name)) = lower(trim(split_part(c.section_name, ' > ', 1)))
            CROSS JOIN (SELECT max_chars AS other FROM chunk_limits WHERE section_name = 'DEFAULT') o
            WHERE length(c.chunk_text) > coalesce(l.max_chars, o.other)""",
        "p6_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+12], ' ') AS g FROM d, range(1, 100000) r(k) WHERE k <= len(w) - 12),
            iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+12], ' ') AS g FROM i, range(1, 100000) r(k) WHERE k <= len(w) - 12)
            SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    }
