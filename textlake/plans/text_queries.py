"""Queries over texts: functions, structure, lexical and vector search, retrieval, evidence, streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.operators import intent, lexical, lookup, retrieve, structure, vectors
from textlake.plans.base import ASKED, JUNK, QUESTIONS, STOP, STOP_SQL, Literal, clean_header, query, similarity, squeeze, trigrams
from textlake.sources.tables import shared_folder, small, table
from textlake.streaming import ingest

HEADERS = "SELECT DISTINCT original_header AS h FROM section_mappings WHERE original_header IS NOT NULL"


def _headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "section_mappings").where("original_header is not null").select(F.col("original_header").alias("h")).distinct()


@query("f1_clean_header", f"SELECT h, {clean_header('h')} AS cleaned FROM ({HEADERS})")
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Headings without numbers and punctuation."""
    return _headers(spark, d).select("h", T.clean_header("h").alias("cleaned"))


@query("f2_header_key", rf"SELECT h, regexp_replace({clean_header('h')}, '[\s-]+', '_', 'g') AS key FROM ({HEADERS})")
def f2(spark: SparkSession, d: str) -> DataFrame:
    """Headings as identifiers."""
    return _headers(spark, d).select("h", T.header_key("h").alias("key"))


@query("f4_header_words", f"SELECT h, {squeeze("regexp_replace(replace(lower(h), '&', 'and'), '[^a-z ]', '', 'g')")} AS words FROM ({HEADERS})")
def f4(spark: SparkSession, d: str) -> DataFrame:
    """Headings as plain words."""
    return _headers(spark, d).select("h", T.header_words("h").alias("words"))


@query("f5_case", r"SELECT h, regexp_matches(h, '\p{Lu}') AND NOT regexp_matches(h, '\p{Ll}') AND length(h) > 2 AS capitals, regexp_matches(h, '\p{Lu}') AND NOT regexp_matches(h, '(^|[^\p{L}])\p{Ll}') AND NOT regexp_matches(h, '\p{L}\p{Lu}') AS title FROM (" + HEADERS + ")")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """Which headings are in capitals or title case."""
    return _headers(spark, d).select("h", T.all_capitals("h").alias("capitals"), T.title_case("h").alias("title"))


@query("f6_plain_query", f"""WITH {QUESTIONS.cte} SELECT query_id, replace(replace(replace({squeeze("regexp_replace(trim(lower(text)), '[?.!,;:]+$', '')")}, 'what''s', 'what is'), 'whats', 'what is'), '''s', ' is') AS plain FROM questions""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    """Questions in one form."""
    return QUESTIONS.df(spark).select("query_id", T.plain_query("text").alias("plain"))


@query("f7_trigram_similarity", f"SELECT id, round({similarity('original_header', 'normalized_name')}, 6) AS similarity FROM section_mappings WHERE original_header IS NOT NULL AND normalized_name IS NOT NULL")
def f7(spark: SparkSession, d: str) -> DataFrame:
    """How alike both names of a mapping are."""
    rows = table(spark, d, "section_mappings").where("original_header is not null and normalized_name is not null")
    return rows.select("id", F.round(T.trigram_similarity("original_header", "normalized_name"), 6).alias("similarity"))


@query("f8_edit_distance", "SELECT id, levenshtein(original_header, display_name) AS edits FROM section_mappings WHERE regexp_full_match(original_header, '[ -~]*') AND regexp_full_match(display_name, '[ -~]*')")
def f8(spark: SparkSession, d: str) -> DataFrame:
    """Edits between both names, for ASCII ones."""
    rows = table(spark, d, "section_mappings").where(F.col("original_header").rlike("^[ -~]*$") & F.col("display_name").rlike("^[ -~]*$"))
    return rows.select("id", F.levenshtein("original_header", "display_name").cast("bigint").alias("edits"))


@query("f10_hashes", "SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 8) AS short, ('0x' || substr(sha256(text), 1, 8))::BIGINT & 2147483647 AS id31 FROM documents")
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), T.short_hash("text").alias("short"), T.id31("text").alias("id31"))


@query("f13_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """A rough number of tokens."""
    return table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query("f16_keywords", rf"""WITH {QUESTIONS.cte} SELECT query_id, list_sort(list_distinct(k)) AS words, len(list_distinct(k)) AS n FROM (SELECT query_id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({STOP_SQL}, w)), lambda w: regexp_replace(regexp_replace(w, '^[?.!,;:]+', ''), '[?.!,;:]+$', '')), lambda w: w <> '') AS k FROM questions)""")
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Words that carry a question."""
    return QUESTIONS.df(spark).select("query_id", T.keywords("text", STOP).alias("k")).select("query_id", F.sort_array("k").alias("words"), F.size("k").cast("bigint").alias("n"))


@query("f27_basename", r"SELECT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS name, lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM files")
def f27(spark: SparkSession, d: str) -> DataFrame:
    """Names and suffixes of files."""
    return table(spark, d, "files").select("file_path", T.basename("file_path").alias("name"), F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))


SYN = Literal("syn", "category string, synonym string, ord int", [(c, s, i) for i, (c, s) in enumerate((c, s) for c, ss in V.SYNONYMS.items() for s in ss)])


@query("e3_categories", f"""WITH {SYN.cte}, h AS (SELECT DISTINCT {squeeze("regexp_replace(replace(lower(h), '&', 'and'), '[^a-z ]', '', 'g')")} AS header FROM ({HEADERS})),
    m AS (SELECT header, category, CASE WHEN header = synonym THEN 1.0 ELSE 0.8 END AS confidence, row_number() OVER (PARTITION BY header ORDER BY length(synonym) DESC, ord) AS r FROM h JOIN syn ON length(header) > 0 AND (contains(header, synonym) OR contains(synonym, header)))
    SELECT h.header, coalesce(m.category, 'other') AS category, coalesce(m.confidence, 0.0)::DOUBLE AS confidence FROM h LEFT JOIN m ON m.header = h.header AND m.r = 1""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    """Categories of headings by their synonyms."""
    return structure.categories(_headers(spark, d).select(T.header_words("h").alias("header")), SYN.df(spark))


@query("e5_sections", r"""WITH l AS (SELECT id, unnest(string_split(content_markdown, chr(10))) AS t, generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM monograph_sections WHERE content_markdown IS NOT NULL),
    b AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS block_id, t, regexp_matches(t, '^(#{1,6})\s+(.+)$') AS head FROM l WHERE trim(t) <> ''),
    s AS (SELECT *, sum(head::INT) OVER (PARTITION BY id ORDER BY block_id) AS section_no FROM b)
    SELECT id, section_no, min(block_id) AS start_block, max(block_id) + 1 AS end_block, count(*) AS blocks FROM s GROUP BY id, section_no""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    """Sections of markdown, from each heading to the next."""
    blocks = structure.markdown_blocks(table(spark, d, "monograph_sections").where("content_markdown is not null"), "id", "content_markdown")
    out = structure.sections_of(blocks, blocks.where("level > 0"), "id")
    return out.select("id", "section_no", "start_block", "end_block", (F.col("end_block") - F.col("start_block")).alias("blocks"))


@query("e6_sentences", r"SELECT id, i - 1 AS sequence_num, trim(s) AS text FROM (SELECT id, unnest(regexp_extract_all(content_text, '([^.!?]+[.!?]+)', 1)) AS s, generate_subscripts(regexp_extract_all(content_text, '([^.!?]+[.!?]+)', 1), 1) AS i FROM monograph_sections) WHERE length(trim(s)) > 10")
def e6(spark: SparkSession, d: str) -> DataFrame:
    """Runs of text up to marks."""
    return structure.sentences(table(spark, d, "monograph_sections"), "id", "content_text")


@query("e7_bullets", r"""WITH l AS (SELECT id, unnest(string_split(content_text, chr(10))) AS t, generate_subscripts(string_split(content_text, chr(10)), 1) AS n FROM monograph_sections)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS sequence_num, trim(regexp_extract(t, '^\s*([•*◦–-]|\d+\.|[a-z]\))\s+(.+)$', 2)) AS text FROM l WHERE length(trim(regexp_extract(t, '^\s*([•*◦–-]|\d+\.|[a-z]\))\s+(.+)$', 2))) > 5""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    """Items of lists."""
    return structure.bullets(table(spark, d, "monograph_sections"), "id", "content_text")


@query("e8_table_rows", r"""WITH l AS (SELECT chunk_id, unnest(string_split(chunk_text, chr(10))) AS t, generate_subscripts(string_split(chunk_text, chr(10)), 1) AS n FROM chunks),
    k AS (SELECT *, sum((trim(t) = '')::INT) OVER (PARTITION BY chunk_id ORDER BY n) AS table_no FROM l)
    SELECT chunk_id, table_no, row_number() OVER (PARTITION BY chunk_id, table_no ORDER BY n) - 1 AS row_no, trim(t) AS text FROM k WHERE contains(t, '|') AND NOT regexp_matches(trim(t), '^\|[\s:-]+\|$') AND length(trim(t)) > 5""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables; a blank line begins another table."""
    return structure.table_rows(table(spark, d, "chunks"), "chunk_id", "chunk_text")


@query("e11_stride", "SELECT chunk_id, p AS piece_no, p * 1000 AS char_start, least(p * 1000 + 1200, length(chunk_text)) AS char_end, substring(chunk_text, p * 1000 + 1, 1200) AS text FROM (SELECT chunk_id, chunk_text, unnest(range(0, greatest(0, ceil((length(chunk_text) - 1200) / 1000.0)::INT) + 1)) AS p FROM chunks WHERE length(chunk_text) > 0)")
def e11(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a fixed size."""
    return structure.stride(table(spark, d, "chunks"), "chunk_id", "chunk_text", 1200, 200)


SECTION = "id, lower(trim(section_name)) AS sec, page_start, content_text"
NAMED = f"(SELECT DISTINCT query_id, section, s.id FROM monograph_sections s JOIN asked a ON lower(s.drug_name) = lower(a.name) OR lower(s.brand_name) = lower(a.name) OR lower(s.generic_name) = lower(a.name))"
EXACT = f"SELECT n.query_id, s.id, row_number() OVER (PARTITION BY n.query_id ORDER BY s.page_start NULLS LAST, s.id) AS rank FROM {NAMED} n JOIN monograph_sections s USING (id) WHERE (n.section IS NULL OR lower(trim(s.section_name)) = lower(trim(n.section))) AND NOT coalesce({JUNK.format(x='s.content_text')}, false)"
FUZZY = f"SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT n.query_id, s.id, round({similarity('s.section_name', 'n.section')}, 6) AS similarity FROM {NAMED} n JOIN monograph_sections s USING (id) WHERE n.section IS NOT NULL) WHERE similarity > 0.2) WHERE rank <= 10"


@query("r2_exact_path", f"WITH {ASKED.cte} {EXACT}")
def r2(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a name, and of a section if one is asked for."""
    return retrieve.exact(ASKED.df(spark), table(spark, d, "monograph_sections")).select("query_id", "id", "rank")


@query("r3_fuzzy_path", f"WITH {ASKED.cte} {FUZZY}")
def r3(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a name whose heading is like the one asked for."""
    return retrieve.fuzzy(ASKED.df(spark), table(spark, d, "monograph_sections")).select("query_id", "id", "similarity", "rank")


@query("r1_cascade", f"WITH {ASKED.cte}, e AS ({EXACT}), f AS ({FUZZY}), u AS (SELECT query_id, id, rank, 'EXACT' AS path, 0 AS o FROM e UNION ALL SELECT query_id, id, rank, 'FUZZY', 1 FROM f), b AS (SELECT *, min(o) OVER (PARTITION BY query_id) AS m FROM u) SELECT a.query_id, coalesce(b.path, 'NONE') AS path, b.id, b.rank FROM asked a LEFT JOIN b ON a.query_id = b.query_id AND b.o = b.m")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """The first path that finds anything, for each question."""
    asked, sections = ASKED.df(spark), table(spark, d, "monograph_sections")
    return retrieve.first_path(asked, [("EXACT", retrieve.exact(asked, sections)), ("FUZZY", retrieve.fuzzy(asked, sections))])


WORDS = Literal("wanted", "query_id bigint, name string, words array<string>", [(1, "velmotrazine", ["half-life", "clearance"]), (2, "Velmotrazine", ["placenta"]), (3, "velmotrazine", ["no such words"])])


@query("r5_attribute_spans", f"WITH {WORDS.cte} SELECT query_id, fact_span_id FROM fact_spans f JOIN wanted w ON lower(f.drug_name) = lower(w.name) WHERE assertion_type IN ('FACT', 'CONDITIONAL') AND len(list_filter(words, lambda x: contains(lower(sentence_text), lower(x)))) > 0")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a name that state facts with any of some words."""
    return retrieve.spans_with(WORDS.df(spark), table(spark, d, "fact_spans"), ["FACT", "CONDITIONAL"]).select("query_id", "fact_span_id")


@query("r8_images", "SELECT lower(drug_name) AS name, list_sort(list(DISTINCT p)) AS images FROM (SELECT drug_name, unnest(image_paths) AS p FROM monograph_sections WHERE has_chemical_structure) WHERE drug_name IS NOT NULL GROUP BY 1")
def r8(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of the sections with a structure, by name."""
    rows = table(spark, d, "monograph_sections").where("has_chemical_structure and drug_name is not null").select(F.lower("drug_name").alias("name"), F.explode("image_paths").alias("p"))
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("p")).alias("images"))


@query("r13_lists", "SELECT 'drug' AS kind, drug_name AS value FROM monograph_sections WHERE drug_name IS NOT NULL UNION SELECT 'section', section_name FROM monograph_sections WHERE section_name IS NOT NULL")
def r13(spark: SparkSession, d: str) -> DataFrame:
    """All names and sections there are."""
    s = table(spark, d, "monograph_sections")
    return s.select(F.explode(F.array(F.struct(F.lit("drug").alias("kind"), F.col("drug_name").alias("value")), F.struct(F.lit("section").alias("kind"), F.col("section_name").alias("value")))).alias("x")).select("x.*").where("value is not null").distinct()


@query("r15_similar_headers", f"""WITH q AS (SELECT id AS query_id, original_header AS t FROM section_mappings WHERE id % 50 = 0 AND original_header IS NOT NULL), h AS ({HEADERS}),
    qg AS (SELECT query_id, unnest({trigrams('t')}) AS g, len({trigrams('t')}) AS nq FROM q), hg AS (SELECT h, unnest({trigrams('h')}) AS g, len({trigrams('h')}) AS nh FROM h),
    s AS (SELECT query_id, h, round(count(*) / (nq + nh - count(*)), 6) AS similarity FROM qg JOIN hg USING (g) GROUP BY query_id, h, nq, nh)
    SELECT query_id, h, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, h) AS rank FROM s WHERE similarity > 0.3) WHERE rank <= 10""")
def r15(spark: SparkSession, d: str) -> DataFrame:
    """The ten headings most like each of a stated set."""
    asked = table(spark, d, "section_mappings").where("id % 50 = 0 and original_header is not null").select(F.col("id").alias("query_id"), F.col("original_header").alias("text"))
    rows = _headers(spark, d).select("h", F.col("h").alias("header"))
    return lookup.alike(asked, rows, "header", 0.3, 10, "h").select("query_id", "h", "similarity", "rank")


@query("r27_resolved_names", rf"WITH {QUESTIONS.cte}, w AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM questions) SELECT DISTINCT query_id, entry_name AS name FROM w JOIN canonical_entries c ON lower(c.entry_name) = w.w WHERE length(w.w) >= 3")
def r27(spark: SparkSession, d: str) -> DataFrame:
    """Listed names that stand in a question."""
    return intent.resolved(QUESTIONS.df(spark), table(spark, d, "canonical_entries").select(F.col("entry_name").alias("name")))


@query("r28_context", f"WITH {ASKED.cte}, e AS ({EXACT}) SELECT query_id, string_agg('[' || upper(coalesce(s.section_name, 'unknown')) || ']' || chr(10) || coalesce(s.content_text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS sources FROM e JOIN monograph_sections s USING (id) WHERE rank <= 20 GROUP BY query_id")
def r28(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty hits of each question as one text: the twenty are the size of a context."""
    return retrieve.context(retrieve.exact(ASKED.df(spark), table(spark, d, "monograph_sections")).where("rank <= 20"), "content_text", "section_name")


VEC = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query("v1_exact_knn", f"SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id, round({VEC.format(a='q.embedding', b='r.embedding')}, 6) AS distance FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0)) WHERE rank <= 10")
def v1(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors to each of a stated set."""
    rows, asked = _vectors(spark, d)
    return vectors.knn(rows, asked, 10)


@query("v2_scoped_knn", f"SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id, round({VEC.format(a='q.embedding', b='r.embedding')}, 6) AS distance FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.label = r.label)) WHERE rank <= 10")
def v2(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the same label."""
    rows, asked = _vectors(spark, d)
    return vectors.knn(rows, asked, 10, "label")


@query("v3_cell_knn")
def v3(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours over 32 cells of which 20 are probed: the vectors are close to random, so that fewer lose more
    than a tenth. The next query holds their recall against v1."""
    rows, asked = _vectors(spark, d)
    centres = vectors.cells(rows, 32)
    return vectors.knn_in_cells(vectors.with_cells(rows, centres), asked, centres, 10, 20)


@query("v3_recall", "SELECT true AS enough")
def v3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether 0.9 of the exact neighbours are found in the cells, over all questions."""
    found = v3(spark, d).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return v1(spark, d).join(found, ["query_id", "vec_id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("v4_diverse")
def v4(spark: SparkSession, d: str) -> DataFrame:
    """Eight diverse ones of the forty nearest."""
    rows, asked = _vectors(spark, d)
    near = vectors.knn(rows, asked, 40).join(rows.select("vec_id", "embedding"), "vec_id").join(small(asked.select("query_id", F.col("embedding").alias("query"))), "query_id")
    return vectors.diverse(near.select("query_id", "vec_id", "query", "embedding"), 8)


@query("f14_cosine", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = (SELECT min(vec_id) FROM embeddings)")
def f14(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector to the first."""
    rows = table(spark, d, "embeddings")
    one = rows.agg(F.min_by("embedding", "vec_id").alias("_first"))
    return rows.join(F.broadcast(one)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("_first")), 6).alias("cosine"))


TERMS = Literal("asked_terms", "query_id bigint, text string", [(1, "blood pressure"), (2, "liver observation patients"), (3, "placenta"), (4, "zzz nothing"), (5, "half life hours")])


@query("x1_bm25", """WITH """ + TERMS.cte + r""", d AS (SELECT fact_span_id, regexp_extract_all(lower(sentence_text), '([a-z0-9]+)', 1) AS w FROM fact_spans WHERE sentence_text IS NOT NULL),
    n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d), t AS (SELECT fact_span_id, len(w) AS l, term, count(*) AS tf FROM (SELECT fact_span_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY term), q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM asked_terms), k AS (SELECT query_id, count(*) AS k FROM q GROUP BY query_id),
    s AS (SELECT q.query_id, t.fact_span_id, count(*) AS c, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.l / n.m))), 6) AS score FROM q JOIN t USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY q.query_id, t.fact_span_id)
    SELECT query_id, fact_span_id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, fact_span_id) AS rank FROM s JOIN k ON s.query_id = k.query_id AND s.c = k.k) WHERE rank <= 60""")
def x1(spark: SparkSession, d: str) -> DataFrame:
    """The sixty best spans with all words of a question."""
    spans = table(spark, d, "fact_spans").where("sentence_text is not null").withColumn("_text", F.col("sentence_text"))
    return lexical.rank(lexical.index(spans, "fact_span_id", "sentence_text"), TERMS.df(spark), spans, "fact_span_id", 60)


@query("x2_inverted_index", r"SELECT fact_span_id, term, count(*) AS tf FROM (SELECT fact_span_id, unnest(regexp_extract_all(lower(sentence_text), '([a-z0-9]+)', 1)) AS term FROM fact_spans) GROUP BY ALL")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """How often each word stands in each span."""
    return lexical.index(table(spark, d, "fact_spans"), "fact_span_id", "sentence_text").select("fact_span_id", "term", "tf")


@query("pred10_close_enough", f"WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id, round({VEC.format(a='q.embedding', b='r.embedding')}, 6) AS distance FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)) WHERE rank <= 20) SELECT query_id, vec_id, rank FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS m FROM h) WHERE rank <= 3 OR distance <= 1.2 * m")
def pred10(spark: SparkSession, d: str) -> DataFrame:
    """Hits as far as 1.2 times the nearest, at least three."""
    rows, asked = _vectors(spark, d)
    hits = vectors.knn(rows, asked, 21).where("query_id != vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where("rank <= 20")
    return retrieve.close_enough(hits, 3, 20).select("query_id", "vec_id", "rank")


@query("g1_evidence", rf"""WITH {TERMS.cte}, s AS (SELECT query_id, string_agg(lower(sentence_text), ' ' ORDER BY fact_span_id) AS t FROM (SELECT query_id, fact_span_id, sentence_text, row_number() OVER (PARTITION BY query_id ORDER BY fact_span_id) AS r FROM asked_terms JOIN fact_spans ON contains(lower(sentence_text), string_split(text, ' ')[1])) WHERE r <= 3 GROUP BY query_id),
    k AS (SELECT query_id, list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) > 2 AND NOT list_contains({STOP_SQL}, w))) AS k FROM asked_terms)
    SELECT query_id, s.t IS NOT NULL AND (len(k) = 0 OR len(list_filter(k, lambda w: contains(s.t, w))) / len(k) >= 0.3) AS enough, round(coalesce(len(list_filter(k, lambda w: contains(s.t, w))) / len(k), 0.0), 6) AS overlap FROM k LEFT JOIN s USING (query_id)""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first three spans with a question's first word hold enough of its words."""
    asked = TERMS.df(spark)
    spans = table(spark, d, "fact_spans").select("fact_span_id", "sentence_text")
    hits = spans.join(small(asked.withColumn("_w", F.get(F.split("text", " "), F.lit(0))), 10_000), F.expr("contains(lower(sentence_text), _w)"))
    top = lookup.first_per(hits, ["query_id"], ["fact_span_id"], 3, "rank").select("query_id", "rank", F.col("sentence_text").alias("text"), F.lit(None).cast("double").alias("score"))
    return retrieve.evidence(asked, top, STOP)


ANSWERS = Literal("answers", "answer_id bigint, answer string", [(1, "It helps [Source: a.pdf, Page 3, Section: USES] and [source: b.pdf, page Unknown, section: X]."), (2, "No citation."), (3, "See [Source: a.pdf, Page 9, Section: USES].")])
CITED = Literal("cited", "answer_id bigint, file string, page string", [(1, "a.pdf", "3"), (1, "b.pdf", "unknown"), (3, "a.pdf", "3")])


@query("g5_uncited", r"""WITH """ + ANSWERS.cte + ", " + CITED.cte + r""", c AS (SELECT answer_id, unnest(regexp_extract_all(answer, '(?i)\[source:\s*[^,\]]+,\s*page\s*(\d+|unknown),\s*section:\s*[^\]]+\]')) AS w, generate_subscripts(regexp_extract_all(answer, '(?i)\[source:\s*[^,\]]+,\s*page\s*(\d+|unknown),\s*section:\s*[^\]]+\]'), 1) - 1 AS n FROM answers),
    p AS (SELECT answer_id, trim(regexp_extract(w, '(?i)\[source:\s*([^,\]]+)', 1)) AS file, lower(regexp_extract(w, '(?i)page\s*(\d+|unknown)', 1)) AS page, n FROM c)
    SELECT p.* FROM p LEFT JOIN cited USING (answer_id, file, page) WHERE cited.answer_id IS NULL""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    """Citations that none of the sources bears out."""
    return retrieve.uncited(ANSWERS.df(spark), CITED.df(spark)).select("answer_id", "file", "page", "n")


@query("g12_section_audit", "SELECT k AS keyword, count_if(contains(lower(section_name), k)) AS n FROM monograph_sections CROSS JOIN (VALUES ('dose'), ('warning'), ('children')) v(k) GROUP BY k")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """How many sections have each word in their name, in one pass."""
    low = F.lower("section_name")
    counts = table(spark, d, "monograph_sections").agg(*(F.count_if(F.contains(low, F.lit(k))).alias(k) for k in ("dose", "warning", "children")))
    return counts.unpivot([], ["dose", "warning", "children"], "keyword", "n")


@query("k1_incremental_ingest", "SELECT file_hash, max(ingestion_version) AS version FROM files WHERE file_hash IS NOT NULL GROUP BY file_hash")
def k1(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the files table that keeps each content's latest row, run to its end twice: the second run adds nothing.

    The kept table itself says what was taken, so that no state grows with the stream.
    """
    base = shared_folder(spark).rstrip("/") + f"/stream-{os.urandom(6).hex()}"
    schema = table(spark, d, "files").select("file_hash", "ingestion_version").schema
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/files.parque[t]").where("file_hash is not null")
        ingest.replace_changed(rows, f"{base}/out", "file_hash", f"{base}/state", "ingestion_version")
    return ingest.current(spark, f"{base}/out").select("file_hash", F.col("ingestion_version").alias("version"))


@query("k2_minute_windows", "SELECT time_bucket(INTERVAL 1 minute, ts) AS starts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute <= (SELECT max(ts) FROM events) - INTERVAL 1 hour")
def k2(spark: SparkSession, d: str) -> DataFrame:
    """Events by minute, as a stream gives them out: the windows that the watermark of an hour has passed."""
    base = shared_folder(spark).rstrip("/") + f"/stream-{os.urandom(6).hex()}"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    made = ingest.windowed(events, "ts", "value", "1 minute").select(F.col("window.start").alias("starts"), "n", "total")
    ingest.run_once(made, f"{base}/out", f"{base}/state")
    return spark.read.schema(made.schema).parquet(f"{base}/out").select("starts", "n", F.round("total", 4).alias("total"))
