"""Queries over tables: scans, predicates, joins, aggregates, windows, sets, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import lookup, retrieve, upkeep
from textlake.plans.base import ASKED, JUNK, query
from textlake.sources.tables import table

LINE = "TIMESTAMP '2024-01-01'"


@query("s10_projection_scan", "SELECT id, drug_name, section_name, page_start FROM monograph_sections WHERE page_start >= 10")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """A scan of four columns; the filter reaches the files."""
    return table(spark, d, "monograph_sections").where("page_start >= 10").select("id", "drug_name", "section_name", "page_start")


@query("s12_multi_get", "SELECT chunk_id, file_path, page_num FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_id % 50 = 0)")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Rows by a list of ids."""
    chunks = table(spark, d, "chunks")
    return chunks.join(chunks.where("chunk_id % 50 = 0").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "file_path", "page_num")


@query("s16_file_lookup", "SELECT f.file_path, f.file_hash, f.ingestion_version FROM files f JOIN (SELECT DISTINCT file_path FROM chunks) c USING (file_path)")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """The record of every file that has chunks."""
    return table(spark, d, "files").join(table(spark, d, "chunks").select("file_path"), "file_path", "left_semi").select("file_path", "file_hash", "ingestion_version")


@query("pred1_three_names", f"WITH {ASKED.cte} SELECT DISTINCT query_id, id FROM monograph_sections s JOIN asked a ON lower(s.drug_name) = lower(a.name) OR lower(s.brand_name) = lower(a.name) OR lower(s.generic_name) = lower(a.name)")
def pred1(spark: SparkSession, d: str) -> DataFrame:
    """Sections by any of three names."""
    return lookup.by_any_name(ASKED.df(spark), table(spark, d, "monograph_sections")).select("query_id", "id").distinct()


@query("pred3_contains_any", "SELECT fact_span_id, sentence_text FROM fact_spans WHERE len(list_filter(['half-life', 'placenta', 'overdose'], lambda w: contains(lower(sentence_text), w))) > 0")
def pred3(spark: SparkSession, d: str) -> DataFrame:
    """Spans that hold any of several phrases, without case."""
    words = F.array(*map(F.lit, ("half-life", "placenta", "overdose")))
    return table(spark, d, "fact_spans").where(F.exists(words, lambda w: F.contains(F.lower("sentence_text"), w))).select("fact_span_id", "sentence_text")


@query("pred5_in_list", "SELECT fact_span_id, assertion_type FROM fact_spans WHERE assertion_type IN ('FACT', 'CONDITIONAL')")
def pred5(spark: SparkSession, d: str) -> DataFrame:
    """Spans of two types."""
    return table(spark, d, "fact_spans").where(F.col("assertion_type").isin("FACT", "CONDITIONAL")).select("fact_span_id", "assertion_type")


@query("pred8_junk", f"SELECT chunk_id, coalesce({JUNK.format(x='chunk_text')}, false) AS junk FROM chunks")
def pred8(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are lines of contents or bare numbers."""
    return table(spark, d, "chunks").select("chunk_id", F.coalesce(T.is_junk("chunk_text"), F.lit(False)).alias("junk"))


@query("pred9_or_all", "WITH m AS (SELECT chunk_id, file_path, coalesce(section_name LIKE '%WARN%', false) AS m FROM chunks) SELECT chunk_id, file_path FROM (SELECT *, bool_or(m) OVER (PARTITION BY file_path) AS a FROM m) WHERE m OR NOT a")
def pred9(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of warnings, or all chunks of files that have none."""
    return retrieve.or_all(table(spark, d, "chunks"), "file_path", F.contains("section_name", F.lit("WARN"))).select("chunk_id", "file_path")


@query("pred14_preview", "SELECT id, substring(content_text, 1, 200) || '...' AS preview, length(content_text) AS n FROM monograph_sections")
def pred14(spark: SparkSession, d: str) -> DataFrame:
    """The beginning and the length of every section."""
    return table(spark, d, "monograph_sections").select("id", T.preview("content_text").alias("preview"), F.length("content_text").cast("bigint").alias("n"))


@query("pred17_case_folded", "SELECT count(*) AS n FROM drug_names WHERE lower(generic_name) = 'velmotrazine' OR lower(brand_name) = 'velmotrazine'")
def pred17(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a name, without case."""
    return table(spark, d, "drug_names").where((F.lower("generic_name") == "velmotrazine") | (F.lower("brand_name") == "velmotrazine")).agg(F.count("*").alias("n"))


@query("j1_chunks_of_files", "SELECT c.chunk_id, f.file_hash, f.ingestion_version FROM chunks c JOIN files f USING (file_path)")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the record of their file."""
    return table(spark, d, "chunks").join(table(spark, d, "files"), "file_path").select("chunk_id", "file_hash", "ingestion_version")


@query("j2_spans_of_sections", "SELECT f.fact_span_id, s.section_name, s.page_start FROM fact_spans f JOIN monograph_sections s ON f.section_id = s.id")
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Spans with their section."""
    sections = table(spark, d, "monograph_sections").select(F.col("id").alias("section_id"), "section_name", "page_start")
    return table(spark, d, "fact_spans").join(sections, "section_id").select("fact_span_id", "section_name", "page_start")


@query("j3_sections_without_spans", "SELECT id FROM monograph_sections s WHERE NOT EXISTS (SELECT 1 FROM fact_spans f WHERE f.section_id = s.id)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Sections from which no span was taken."""
    return table(spark, d, "monograph_sections").join(table(spark, d, "fact_spans").select(F.col("section_id").alias("id")), "id", "left_anti").select("id")


@query("j4_documents_known", "SELECT document_hash FROM parsed_documents WHERE document_hash IN (SELECT document_hash FROM monograph_sections)")
def j4(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents that have sections."""
    return table(spark, d, "parsed_documents").join(table(spark, d, "monograph_sections").select("document_hash"), "document_hash", "left_semi").select("document_hash")


@query("j5_needs_ingest", "SELECT p.file_path, p.document_hash AS file_hash, CASE WHEN f.file_path IS NULL THEN 'new' WHEN p.document_hash IS DISTINCT FROM f.file_hash THEN 'changed' ELSE 'older' END AS reason FROM parsed_documents p LEFT JOIN files f USING (file_path) WHERE f.file_path IS NULL OR p.document_hash IS DISTINCT FROM f.file_hash OR f.ingestion_version < 3")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Files that are new, changed or were read by an older version."""
    found = table(spark, d, "parsed_documents").select("file_path", F.col("document_hash").alias("file_hash"))
    return upkeep.needs_ingest(found, table(spark, d, "files"), 3)


@query("j6_nearest_names", r"""WITH t AS (SELECT DISTINCT lower(brand_name) AS word FROM drug_names WHERE regexp_full_match(brand_name, '[A-Za-z]+')), n AS (SELECT DISTINCT lower(entry_name) AS name FROM canonical_entries WHERE kind = 'brand' AND regexp_full_match(entry_name, '[A-Za-z]+')),
    m AS (SELECT word, name, levenshtein(word, name) AS distance FROM t JOIN n ON abs(length(word) - length(name)) <= 2 AND levenshtein(word, name) <= 2)
    SELECT word, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, name) AS r FROM m) WHERE r = 1""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    """For each typed brand the listed one within two edits."""
    typed = table(spark, d, "drug_names").where(F.col("brand_name").rlike("^[A-Za-z]+$")).select(F.lower("brand_name").alias("word"))
    names = table(spark, d, "canonical_entries").where((F.col("kind") == "brand") & F.col("entry_name").rlike("^[A-Za-z]+$")).select(F.lower("entry_name").alias("name"))
    return lookup.nearest_names(typed, names).withColumn("distance", F.col("distance").cast("bigint"))


@query("j12_first_text_of_file", "SELECT file_path, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY page_num NULLS FIRST, char_start NULLS FIRST, chunk_id) AS r FROM chunks) WHERE r = 1")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of each file; one aggregate, no correlated look-up."""
    return table(spark, d, "chunks").groupBy("file_path").agg(F.min(F.struct("page_num", "char_start", "chunk_id")).alias("m")).select("file_path", F.col("m.chunk_id").alias("chunk_id"))


@query("a1_section_stats", "SELECT normalized_name, count(*) AS mappings, sum(usage_count) AS total FROM section_mappings GROUP BY normalized_name")
def a1(spark: SparkSession, d: str) -> DataFrame:
    """Mappings and uses of each section name."""
    return table(spark, d, "section_mappings").groupBy("normalized_name").agg(F.count("*").alias("mappings"), F.sum("usage_count").alias("total")).orderBy(F.desc("total"), "normalized_name")


@query("a3_distinct_counts", "SELECT count(DISTINCT file_path) AS files, count(DISTINCT section_name) AS sections, count(*) AS chunks FROM chunks")
def a3(spark: SparkSession, d: str) -> DataFrame:
    """Counts of distinct values."""
    return table(spark, d, "chunks").agg(F.count_distinct("file_path").alias("files"), F.count_distinct("section_name").alias("sections"), F.count("*").alias("chunks"))


@query("a5_count_and_sample", "SELECT count(*) AS n, min(chunk_text) AS sample FROM chunks WHERE contains(lower(chunk_text), 'overdose') OR contains(lower(chunk_text), 'placenta')")
def a5(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks hold either word, with the least of them."""
    low = F.lower("chunk_text")
    return table(spark, d, "chunks").where(F.contains(low, F.lit("overdose")) | F.contains(low, F.lit("placenta"))).agg(F.count("*").alias("n"), F.min("chunk_text").alias("sample"))


@query("a6_page_span", "SELECT document_hash, min(page_start) AS first_page, max(coalesce(page_end, page_start)) AS last_page FROM monograph_sections GROUP BY document_hash")
def a6(spark: SparkSession, d: str) -> DataFrame:
    """First and last page of each document's sections."""
    return table(spark, d, "monograph_sections").groupBy("document_hash").agg(F.min("page_start").alias("first_page"), F.max(F.coalesce("page_end", "page_start")).alias("last_page"))


@query("a8_span_stats", "SELECT lower(trim(source_type)) AS source_type, count(*) AS n, round(avg(length(sentence_text)), 2) AS mean_length FROM fact_spans GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    """Spans and their mean length by type."""
    return table(spark, d, "fact_spans").groupBy(F.lower(F.trim("source_type")).alias("source_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("sentence_text")), 2).alias("mean_length"))


@query("a11_ingest_summary", "SELECT count(*) AS documents, count_if(parse_success) AS parsed, sum(page_count) AS pages, count_if(raw_text IS NULL OR trim(raw_text) = '') AS empty FROM parsed_documents")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """What parsing came to."""
    return table(spark, d, "parsed_documents").agg(F.count("*").alias("documents"), F.count_if("parse_success").alias("parsed"), F.sum("page_count").alias("pages"), F.count_if(F.expr("raw_text is null or trim(raw_text) = ''")).alias("empty"))


@query("a14_metric_means", "SELECT metric, round(avg(value), 6) AS mean, avg(value) >= 0.5 AS reached FROM (SELECT 'confidence' AS metric, confidence AS value FROM section_mappings UNION ALL SELECT 'common', CASE WHEN is_common THEN 1.0 ELSE 0.0 END FROM section_mappings) GROUP BY metric")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Means of metrics against a target."""
    rows = table(spark, d, "section_mappings").select("confidence", F.when(F.col("is_common"), 1.0).otherwise(0.0).alias("common"))
    return rows.unpivot([], ["confidence", "common"], "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), (F.avg("value") >= 0.5).alias("reached"))


@query("a16_upper_median", "SELECT source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """The upper median length of each source: distinct values are counted first, so that no group is ever gathered."""
    counted = table(spark, d, "documents").where("n_chars is not null").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source")
    run = counted.withColumn("upto", F.sum("c").over(w.orderBy("n_chars"))).withColumn("half", F.floor(F.sum("c").over(w) / 2))
    return run.where(F.col("upto") > F.col("half")).groupBy("source").agg(F.min("n_chars").alias("median"))


@query("a17_hierarchy", "SELECT upper(trim(split_part(section_name, ' > ', 1))) AS base, list_sort(list(DISTINCT trim(split_part(section_name, ' > ', 2)))) AS variants FROM chunks WHERE section_name IS NOT NULL GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their subsections; distinct pairs are made before grouping."""
    pairs = table(spark, d, "chunks").where("section_name is not null").select(F.upper(F.trim(F.split_part("section_name", F.lit(" > "), F.lit(1)))).alias("base"), F.trim(F.split_part("section_name", F.lit(" > "), F.lit(2))).alias("v")).distinct()
    return pairs.groupBy("base").agg(F.sort_array(F.collect_list("v")).alias("variants"))


@query("a20_filtered_counts", "SELECT count_if(contains(lower(sentence_text), 'mg')) AS doses, count_if(contains(lower(sentence_text), 'weeks') OR contains(lower(sentence_text), 'days')) AS times, count(*) AS n FROM fact_spans")
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Several counts in one pass."""
    low = F.lower("sentence_text")
    return table(spark, d, "fact_spans").agg(F.count_if(F.contains(low, F.lit("mg"))).alias("doses"), F.count_if(F.contains(low, F.lit("weeks")) | F.contains(low, F.lit("days"))).alias("times"), F.count("*").alias("n"))


@query("w1_next_boundary", "SELECT chunk_id, coalesce(lead(char_start) OVER (PARTITION BY file_path ORDER BY char_start, chunk_id), char_end) AS next_start FROM chunks")
def w1(spark: SparkSession, d: str) -> DataFrame:
    """Where the next chunk of the file begins."""
    w = Window.partitionBy("file_path").orderBy("char_start", "chunk_id")
    return table(spark, d, "chunks").select("chunk_id", F.coalesce(F.lead("char_start").over(w), F.col("char_end")).alias("next_start"))


@query("w3_carried_section", "SELECT chunk_id, last_value(section_name IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY char_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM chunks")
def w3(spark: SparkSession, d: str) -> DataFrame:
    """The last section named so far in the file."""
    w = Window.partitionBy("file_path").orderBy("char_start", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "chunks").select("chunk_id", F.last("section_name", ignorenulls=True).over(w).alias("section"))


@query("w4_running_offset", "SELECT chunk_id, coalesce(sum(length(chunk_text) - 200) OVER (PARTITION BY file_path ORDER BY char_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running FROM chunks")
def w4(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the chunks before, less the overlap of each."""
    w = Window.partitionBy("file_path").orderBy("char_start", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "chunks").select("chunk_id", F.coalesce(F.sum(F.length("chunk_text") - 200).over(w), F.lit(0)).alias("running"))


@query("w5_enumerated", "SELECT chunk_id, row_number() OVER (PARTITION BY file_path ORDER BY page_num NULLS FIRST, char_start NULLS FIRST, chunk_id) - 1 AS chunk_index FROM chunks")
def w5(spark: SparkSession, d: str) -> DataFrame:
    """The place of each chunk in its file."""
    w = Window.partitionBy("file_path").orderBy("page_num", "char_start", "chunk_id")
    return table(spark, d, "chunks").select("chunk_id", (F.row_number().over(w) - 1).cast("bigint").alias("chunk_index"))


@query("w6_first_wins", "SELECT min(fact_span_id) AS fact_span_id, sentence_text FROM fact_spans WHERE sentence_text IS NOT NULL GROUP BY sentence_text")
def w6(spark: SparkSession, d: str) -> DataFrame:
    """The first span of each text, as an aggregate: copies meet partly before the shuffle."""
    return table(spark, d, "fact_spans").where("sentence_text is not null").groupBy("sentence_text").agg(F.min("fact_span_id").alias("fact_span_id"))


@query("w7_max_score", "WITH b AS (SELECT normalized_name, max(confidence) AS score, min(id) AS place FROM section_mappings WHERE normalized_name IS NOT NULL AND confidence IS NOT NULL GROUP BY normalized_name) SELECT b.normalized_name, min(m.id) AS id, b.score, b.place FROM b JOIN section_mappings m ON m.normalized_name = b.normalized_name AND m.confidence = b.score GROUP BY ALL")
def w7(spark: SparkSession, d: str) -> DataFrame:
    """Of each name the mapping of the highest confidence, with the place of its first."""
    rows = table(spark, d, "section_mappings").where("normalized_name is not null and confidence is not null")
    return upkeep.max_score(rows, "normalized_name", "confidence", "id").select("normalized_name", "id", F.col("confidence").alias("score"), "place")


@query("w10_bottom_three", "SELECT section_group, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY section_group ORDER BY confidence, id) AS r FROM section_mappings WHERE confidence IS NOT NULL) WHERE r <= 3")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """The three lowest of each group."""
    return lookup.first_per(table(spark, d, "section_mappings").where("confidence is not null"), ["section_group"], ["confidence", "id"], 3).select("section_group", "id", "confidence")


@query("w11_sliding_minute", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 4) AS total FROM events")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the last 60 seconds, by type of event. Each event also goes to the minute after its own, so that a task
    sorts one type's two minutes, however few types there are."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_id", "event_type", "value", ts.alias("_ts"))
    minute = F.floor(F.col("_ts") / 60_000_000)
    spread = rows.withColumn("_own", minute).withColumn("_minute", F.explode(F.array(minute, minute + 1)))
    w = Window.partitionBy("event_type", "_minute").orderBy("_ts").rangeBetween(-59_999_999, 0)
    return spread.withColumn("total", F.round(F.sum("value").over(w), 4)).where("_minute = _own").select("event_id", "total")


@query("t3_priority_order", "SELECT id, CASE WHEN lower(section_name) LIKE '%indication%' THEN 1 WHEN lower(section_name) LIKE '%dose%' THEN 2 WHEN lower(section_name) LIKE '%warning%' THEN 3 ELSE 4 END AS place FROM monograph_sections")
def t3(spark: SparkSession, d: str) -> DataFrame:
    """Sections in the order of a list of priorities."""
    low = F.lower("section_name")
    place = F.when(F.contains(low, F.lit("indication")), 1).when(F.contains(low, F.lit("dose")), 2).when(F.contains(low, F.lit("warning")), 3).otherwise(4)
    return table(spark, d, "monograph_sections").select("id", place.alias("place")).orderBy("place", "id")


@query("u1_union_distinct", "SELECT DISTINCT lower(trim(name)) AS name FROM (SELECT drug_name AS name FROM monograph_sections UNION ALL SELECT generic_name FROM drug_names UNION ALL SELECT drug_name FROM fact_spans) WHERE name IS NOT NULL")
def u1(spark: SparkSession, d: str) -> DataFrame:
    """All names of three tables; each table's are made distinct before they meet."""
    parts = [table(spark, d, t).where(F.col(c).isNotNull()).select(F.lower(F.trim(c)).alias("name")).distinct() for t, c in (("monograph_sections", "drug_name"), ("drug_names", "generic_name"), ("fact_spans", "drug_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("u5_section_sets", "SELECT document_hash, list_sort(list(DISTINCT section_name)) AS sections FROM monograph_sections WHERE section_name IS NOT NULL GROUP BY document_hash")
def u5(spark: SparkSession, d: str) -> DataFrame:
    """The section names of each document."""
    return table(spark, d, "monograph_sections").where("section_name is not null").groupBy("document_hash").agg(F.sort_array(F.collect_set("section_name")).alias("sections"))


@query("d1_count_up", "SELECT original_header, sum(usage_count) AS usage_count, min(created_at) AS created_at, max(updated_at) AS updated_at FROM section_mappings GROUP BY original_header")
def d1(spark: SparkSession, d: str) -> DataFrame:
    """Counters of headers after the mappings of a later batch came in."""
    rows = table(spark, d, "section_mappings")
    late = F.expr(f"coalesce(created_at >= {LINE}, false)")
    return upkeep.count_up(rows.where(~late), rows.where(late), "original_header", "usage_count", "created_at", "updated_at")


@query("d2_latest_wins", "SELECT file_hash, file_path, ingestion_version FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY ingestion_version DESC NULLS LAST, file_path) AS r FROM files) WHERE r = 1")
def d2(spark: SparkSession, d: str) -> DataFrame:
    """For each content the record of the highest version, after an upsert of newer on older ones."""
    files = table(spark, d, "files")
    return upkeep.latest(files.where("ingestion_version <= 1"), files.where("ingestion_version > 1 or ingestion_version is null"), ["file_hash"], [("ingestion_version", True), "file_path"]).select("file_hash", "file_path", "ingestion_version")


KEY = ["section_id", "sentence_index", "source_type"]


@query("d3_insert_ignore", f"""WITH t AS (SELECT DISTINCT section_id, sentence_index, source_type FROM fact_spans WHERE created_at < {LINE}), b AS (SELECT *, row_number() OVER (PARTITION BY section_id, sentence_index, source_type ORDER BY fact_span_id) AS r FROM fact_spans WHERE created_at >= {LINE})
    SELECT b.fact_span_id FROM b LEFT JOIN t ON b.section_id = t.section_id AND b.sentence_index = t.sentence_index AND b.source_type = t.source_type WHERE b.r = 1 AND t.section_id IS NULL""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    """The spans of a batch that a table of earlier ones takes in."""
    rows = table(spark, d, "fact_spans")
    return upkeep.insert_ignore(rows.where(f"created_at < {LINE}"), rows.where(f"created_at >= {LINE}"), KEY, ["fact_span_id"]).select("fact_span_id")


ID31 = "(('0x' || substr(sha256({x}), 1, 8))::BIGINT & 2147483647)"


@query("d4_salted_ids", "WITH r AS (SELECT chunk_id, coalesce(file_path, '') || ':' || coalesce(page_num, 0) AS k FROM chunks), n AS (SELECT *, row_number() OVER (PARTITION BY " + ID31.format(x="k") + " ORDER BY chunk_id) AS n FROM r) SELECT chunk_id, CASE WHEN n = 1 THEN " + ID31.format(x="k") + " ELSE " + ID31.format(x="k || ':retry1:' || chunk_id") + " END AS row_id FROM n")
def d4(spark: SparkSession, d: str) -> DataFrame:
    """Ids from the content, salted where they collide."""
    content = F.concat(F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce("page_num", F.lit(0)).cast("string"))
    return upkeep.salted_ids(table(spark, d, "chunks"), content, F.concat(content, F.lit(":retry1:"), F.col("chunk_id").cast("string")), ["chunk_id"]).select("chunk_id", "row_id")


@query("d5_delete_by_key", "SELECT chunk_id FROM chunks WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM files WHERE ingestion_version >= 2)")
def d5(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are left when those of renewed files are gone."""
    return upkeep.delete_keys(table(spark, d, "chunks"), table(spark, d, "files").where("ingestion_version >= 2"), ["file_path"]).select("chunk_id")


@query("d8_merged_lists", "SELECT lower(trim(drug_name)) AS drug, list_sort(list(DISTINCT section_name) FILTER (section_name IS NOT NULL)) AS sections, count(*) AS n, sum(char_count) AS chars, bool_or(has_chemical_structure) AS structure FROM monograph_sections WHERE drug_name IS NOT NULL GROUP BY 1")
def d8(spark: SparkSession, d: str) -> DataFrame:
    """One record for each drug."""
    rows = table(spark, d, "monograph_sections").where("drug_name is not null").withColumn("drug", F.lower(F.trim("drug_name")))
    return upkeep.merged_lists(rows, "drug", {"sections": F.col("section_name")}, {"n": F.lit(1), "chars": F.col("char_count")}, {"structure": F.col("has_chemical_structure")})
