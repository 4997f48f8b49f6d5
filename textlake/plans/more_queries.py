"""More rows of the survey: retrieval by words, coverage, aliases, variants, folds, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.operators import intent, lexical, lookup, retrieve, structure, upkeep, vectors
from textlake.plans.base import ASKED, JUNK, QUESTIONS, Literal, query, squeeze
from textlake.plans.text_queries import EXACT, TERMS, VEC, _vectors
from textlake.sources.tables import table


@query("s6_markdown_blocks", r"""WITH l AS (SELECT id, unnest(string_split(content_markdown, chr(10))) AS t, generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM monograph_sections)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS block_id, length(regexp_extract(t, '^(#{1,6})\s+(.+)$', 1)) AS level, CASE WHEN regexp_matches(t, '^(#{1,6})\s+(.+)$') THEN trim(regexp_extract(t, '^(#{1,6})\s+(.+)$', 2)) ELSE trim(t) END AS text, CASE WHEN regexp_matches(t, '^(#{1,6})\s+(.+)$') THEN 18 - 2 * length(regexp_extract(t, '^(#{1,6})\s+(.+)$', 1)) ELSE 12 END AS font_size FROM l WHERE trim(t) <> ''""")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Lines of markdown as blocks, headings larger."""
    return structure.markdown_blocks(table(spark, d, "monograph_sections").where("content_markdown is not null"), "id", "content_markdown").select("id", "block_id", "level", "text", "font_size")


@query("s13_file_in_order", "SELECT chunk_id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY page_num NULLS LAST, char_start NULLS LAST, chunk_id) AS place FROM chunks WHERE file_path LIKE '%master%'")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of some files in reading order; nulls last."""
    order = [F.asc_nulls_last("page_num"), F.asc_nulls_last("char_start"), "chunk_id"]
    return lookup.first_per(table(spark, d, "chunks").where(F.contains("file_path", F.lit("master"))), ["file_path"], order, 1 << 30, "place").select("chunk_id", "file_path", "place")


@query("d13_grouped_json", "SELECT upper(trim(split_part(section_name, ' > ', 1))) AS base, to_json(list_sort(list(DISTINCT trim(section_name)))) AS variants FROM chunks WHERE section_name IS NOT NULL GROUP BY 1")
def d13(spark: SparkSession, d: str) -> DataFrame:
    """The variants of each base section as JSON."""
    pairs = table(spark, d, "chunks").where("section_name is not null").select(F.upper(F.trim(F.split_part("section_name", F.lit(" > "), F.lit(1)))).alias("base"), F.trim("section_name").alias("v")).distinct()
    return pairs.groupBy("base").agg(F.to_json(F.sort_array(F.collect_list("v"))).alias("variants"))


@query("d10_keep_where_true", "SELECT document_hash, bool_or(has_chemical_structure) AS positive, CASE WHEN bool_or(has_chemical_structure) THEN min(drug_name) FILTER (has_chemical_structure) END AS name FROM monograph_sections GROUP BY document_hash")
def d10(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a structure, their name kept only where there is one."""
    s = table(spark, d, "monograph_sections")
    return s.groupBy("document_hash").agg(F.bool_or("has_chemical_structure").alias("positive"), F.min(F.when(F.col("has_chemical_structure"), F.col("drug_name"))).alias("name"))


@query("a7_ordered_concat", "SELECT section_id, string_agg(trim(sentence_text), chr(10) ORDER BY sentence_index, fact_span_id) FILTER (trim(sentence_text) <> '') AS content FROM fact_spans WHERE section_id IS NOT NULL AND trim(sentence_text) <> '' GROUP BY section_id")
def a7(spark: SparkSession, d: str) -> DataFrame:
    """The spans of each section as one text; a section has as many as its pages hold."""
    s = table(spark, d, "fact_spans").where("section_id is not null and trim(sentence_text) != ''")
    parts = F.sort_array(F.collect_list(F.struct("sentence_index", "fact_span_id", F.trim("sentence_text").alias("t"))))
    return s.groupBy("section_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("content"))


@query("a10_method_histogram", "SELECT suggested_by, count(*) AS n, count_if(is_common) AS common, round(count_if(is_common) / count(*), 6) AS share FROM section_mappings GROUP BY suggested_by")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """Mappings by how they were made, with the share of common ones."""
    return table(spark, d, "section_mappings").groupBy("suggested_by").agg(F.count("*").alias("n"), F.count_if("is_common").alias("common"), F.round(F.count_if("is_common") / F.count("*"), 6).alias("share"))


@query("a19_health", "SELECT count(*) AS sections, count(DISTINCT drug_name) AS names, count_if(content_text IS NULL) AS empty, count(*) = 0 AS degraded FROM monograph_sections")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts."""
    from textlake.retriever import Retriever

    return Retriever(spark, d).health()


CTX = Literal("more", "query_id bigint, text string", [(1, "what are the effects"), (2, "use in pregnancy"), (3, "dose"), (4, "list all interactions")])


@query("t12_context_size", f"""WITH {CTX.cte}, n AS (SELECT count(*) AS n FROM chunks), b AS (SELECT query_id, lower(text) AS t, CASE WHEN n < 3000 THEN 5 WHEN n < 6000 THEN 8 WHEN n < 12000 THEN 10 ELSE 12 END AS lo, CASE WHEN n < 3000 THEN 8 WHEN n < 6000 THEN 12 WHEN n < 12000 THEN 15 ELSE 20 END AS hi FROM more, n),
    k AS (SELECT *, len(list_filter({V.COMPLEX}, lambda w: contains(t, w))) > 0 AS c, len(list_filter({V.COMPREHENSIVE}, lambda w: contains(t, w))) > 0 AS a FROM b)
    SELECT query_id, lo + CASE WHEN c THEN 3 WHEN a THEN 10 ELSE 0 END AS least, hi + CASE WHEN c THEN 5 WHEN a THEN 15 ELSE 0 END AS most FROM k""")
def t12(spark: SparkSession, d: str) -> DataFrame:
    """How much context each question gets, by the size of the collection."""
    n = table(spark, d, "chunks").agg(F.count("*").alias("n"))
    return CTX.df(spark).join(F.broadcast(n)).select("query_id", intent.context_size(F.col("text"), F.col("n")).alias("s")).select("query_id", "s.*")


SCOPED = Literal("scoped", "query_id bigint, name string, text string", [(1, "velmotrazine", "half life"), (2, "velmotrazine", "placenta"), (3, "none", "placenta")])


@query("r10_scoped_lexical", "WITH " + SCOPED.cte + r""", d AS (SELECT fact_span_id, lower(drug_name) AS name, regexp_extract_all(lower(sentence_text), '([a-z0-9]+)', 1) AS w FROM fact_spans WHERE sentence_text IS NOT NULL),
    n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d), t AS (SELECT fact_span_id, name, len(w) AS l, term, count(*) AS tf FROM (SELECT fact_span_id, name, w, unnest(w) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY term), q AS (SELECT DISTINCT query_id, name, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM scoped), k AS (SELECT query_id, count(*) AS k FROM q GROUP BY query_id),
    s AS (SELECT q.query_id, t.fact_span_id, count(*) AS c, round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.l / n.m))), 6) AS score FROM q JOIN t ON q.term = t.term AND q.name = t.name JOIN df ON df.term = q.term CROSS JOIN n GROUP BY q.query_id, t.fact_span_id)
    SELECT query_id, fact_span_id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, fact_span_id) AS rank FROM s JOIN k ON s.query_id = k.query_id AND s.c = k.k) WHERE rank <= 60""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """The sixty best spans of one name with all words of a question."""
    spans = table(spark, d, "fact_spans").where("sentence_text is not null").withColumn("_text", F.col("sentence_text")).withColumn("name", F.lower("drug_name"))
    return lexical.rank(lexical.index(spans, "fact_span_id", "sentence_text", ("name",)), SCOPED.df(spark), spans, "fact_span_id", 60, "name")


@query("r11_substring_path", f"WITH {TERMS.cte} SELECT query_id, fact_span_id FROM (SELECT query_id, fact_span_id, row_number() OVER (PARTITION BY query_id ORDER BY section_id NULLS FIRST, sentence_index NULLS FIRST, fact_span_id) AS r FROM asked_terms JOIN fact_spans ON contains(lower(sentence_text), lower(text)) AND NOT {JUNK.format(x='sentence_text')}) WHERE r <= 50")
def r11(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty spans that hold a question's words as they stand."""
    spans = table(spark, d, "fact_spans").where(~F.coalesce(T.is_junk("sentence_text"), F.lit(False))).select("fact_span_id", "section_id", "sentence_index", "sentence_text")
    met = spans.join(F.broadcast(TERMS.df(spark)), F.expr("contains(lower(sentence_text), lower(text))"))
    return lookup.first_per(met, ["query_id"], ["section_id", "sentence_index", "fact_span_id"], 50).select("query_id", "fact_span_id")


@query("r18_coverage", f"""WITH h AS (SELECT query_id, vec_id, rank, label FROM (SELECT q.vec_id AS query_id, r.vec_id, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({VEC.format(a='q.embedding', b='r.embedding')}, 6), r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0) WHERE rank <= 20),
    f AS (SELECT *, min(CASE WHEN label = 3 THEN rank END) OVER (PARTITION BY query_id) AS first FROM h)
    SELECT query_id, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first > 5 AND rank = first THEN 0 ELSE rank END) AS place FROM f) WHERE place <= 5""")
def r18(spark: SparkSession, d: str) -> DataFrame:
    """Five hits each, with one of label 3 in front if the first twenty have one and the first five don't."""
    rows, asked = _vectors(spark, d)
    hits = vectors.knn(rows, asked, 20).join(rows.select("vec_id", "label"), "vec_id")
    return retrieve.ensure(hits, F.col("label") == 3, 5).select("query_id", "vec_id", "place")


ALIASES = Literal("aliases", "section string, alias string, ord int", [("dose", "dose and schedule", 0), ("dose", "presentation and strengths", 1), ("safety", "special warnings", 0), ("safety", "contraindications", 1), ("safety", "undesirable effects", 2)])


@query("r19_exhaustive_aliases", f"WITH {ALIASES.cte} SELECT section, chunk_id FROM (SELECT DISTINCT a.section, c.chunk_id FROM chunks c JOIN aliases a ON lower(trim(split_part(c.section_name, ' > ', 1))) = a.alias)")
def r19(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of a section under any of its names, each once."""
    chunks = table(spark, d, "chunks").select("chunk_id", F.lower(F.trim(F.split_part("section_name", F.lit(" > "), F.lit(1)))).alias("alias"))
    return chunks.join(F.broadcast(ALIASES.df(spark)), "alias").select("section", "chunk_id").distinct()


@query("r20_section_or_text", f"WITH {ASKED.cte}, s AS (SELECT chunk_id, lower(coalesce(section_name, '')) AS n, lower(chunk_text) AS t FROM chunks), q AS (SELECT query_id, lower(section) AS s FROM asked WHERE section IS NOT NULL), a AS (SELECT query_id, chunk_id FROM q JOIN s ON contains(n, q.s)), b AS (SELECT query_id, chunk_id FROM q JOIN s ON contains(t, q.s) WHERE query_id NOT IN (SELECT query_id FROM a)) SELECT query_id, 'SECTION' AS path, chunk_id FROM a UNION ALL SELECT query_id, 'TEXT', chunk_id FROM b")
def r20(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a section by its name, or by their text where no name fits."""
    asked = F.broadcast(ASKED.df(spark).where("section is not null").select("query_id", F.lower("section").alias("s")))
    chunks = table(spark, d, "chunks").select("chunk_id", "section_name", "chunk_text")
    hit = lambda c: chunks.join(asked, F.expr(f"contains(lower({c}), s)")).select("query_id", F.col("chunk_id").alias("id"), F.lit(0).alias("rank"))
    found = retrieve.first_path(ASKED.df(spark), [("SECTION", hit("section_name")), ("TEXT", hit("chunk_text"))])
    return found.where("id is not null").select("query_id", "path", F.col("id").alias("chunk_id"))


TEMPLATES = Literal("templates", "kind string, ord int, template string", [("uses", i, t) for i, t in enumerate(["indications of {name}", "what does {name} treat", "{name} therapeutic use"])] + [("harm", i, t) for i, t in enumerate(["adverse reactions of {name}", "side effects {name}", "side effects of {name}", "{name} undesirable effects", "{name} toxicity", "{name} safety"])])
KINDS = Literal("kinds", "query_id bigint, kind string, name string, text string", [(1, "uses", "axid", "what is axid used for"), (2, "harm", "axid", "side effects of axid"), (3, "other", "axid", "axid")])


@query("r24_variants", f"WITH {TEMPLATES.cte}, {KINDS.cte}, u AS (SELECT query_id, -1 AS ord, text AS v FROM kinds UNION ALL SELECT query_id, ord, replace(template, '{{name}}', name) FROM kinds JOIN templates USING (kind)), f AS (SELECT query_id, v, min(ord) AS ord FROM u GROUP BY query_id, v) SELECT query_id, place, v AS variant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, v) AS place FROM f) WHERE place <= 5")
def r24(spark: SparkSession, d: str) -> DataFrame:
    """Up to five wordings of each question."""
    return intent.variants(KINDS.df(spark), TEMPLATES.df(spark))


@query("f17_wider_wording", f"WITH {QUESTIONS.cte} SELECT query_id, text || CASE WHEN contains(lower(text), 'pregnancy') AND contains(lower(text), 'side effects') THEN ' pregnant teratogenic fetal' WHEN contains(lower(text), 'children') THEN ' pediatric infant neonatal' WHEN contains(lower(text), 'interactions') THEN ' drug interactions drug-drug interactions combination therapy' ELSE '' END AS wider FROM questions")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """Questions with related terms."""
    return QUESTIONS.df(spark).select("query_id", intent.widened(F.col("text")).alias("wider"))


@query("u3_merge_by_id", f"WITH {ASKED.cte}, e AS ({EXACT}) SELECT id, min(query_id) AS first_query, count(*) AS times FROM e GROUP BY id")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all questions merged by id."""
    hits = retrieve.exact(ASKED.df(spark), table(spark, d, "monograph_sections"))
    return hits.groupBy("id").agg(F.min("query_id").alias("first_query"), F.count("*").alias("times"))


@query("w9_reset_sequence", "WITH k AS (SELECT *, sum((section_name IS NULL)::INT) OVER (PARTITION BY file_path ORDER BY char_start, chunk_id) AS island FROM chunks) SELECT chunk_id, island, row_number() OVER (PARTITION BY file_path, island ORDER BY char_start, chunk_id) - 1 AS place FROM k")
def w9(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that begin anew after each chunk without a section."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_path").orderBy("char_start", "chunk_id")
    k = table(spark, d, "chunks").withColumn("island", F.sum(F.col("section_name").isNull().cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return k.select("chunk_id", "island", (F.row_number().over(Window.partitionBy("file_path", "island").orderBy("char_start", "chunk_id")) - 1).cast("bigint").alias("place"))


@query("j10_selected_only", "SELECT fact_span_id FROM fact_spans WHERE list_contains(attribute_tags, 'dose') AND list_contains(attribute_tags, 'risk')")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Spans with both of two tags."""
    return table(spark, d, "fact_spans").where(F.array_contains("attribute_tags", "dose") & F.array_contains("attribute_tags", "risk")).select("fact_span_id")


@query("pred4_fuzzy_or_words", f"SELECT id FROM monograph_sections WHERE lower(drug_name) = 'velmotrazine' AND (contains({squeeze('lower(section_name)')}, 'dose') OR contains({squeeze('lower(section_name)')}, 'schedule'))")
def pred4(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a name whose heading has any of two words."""
    low = T.squeeze(F.lower("section_name"))
    return table(spark, d, "monograph_sections").where((F.lower("drug_name") == "velmotrazine") & (F.contains(low, F.lit("dose")) | F.contains(low, F.lit("schedule")))).select("id")


@query("d14_single_insert", "SELECT 1000000001 AS id, 'x' AS generic_name WHERE 1000000001 NOT IN (SELECT id FROM drug_names)")
def d14(spark: SparkSession, d: str) -> DataFrame:
    """One row, if its key is free."""
    return upkeep.insert_ignore(table(spark, d, "drug_names"), spark.createDataFrame([(1000000001, "x")], "id bigint, generic_name string"), ["id"], ["generic_name"])
