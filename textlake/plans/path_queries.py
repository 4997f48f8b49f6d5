"""Queries that answer questions: all paths, their first that finds anything, contexts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.operators import lexical, retrieve, upkeep, vectors
from textlake.plans.base import ASKED, JUNK, Literal, query, similarity, squeeze
from textlake.plans.survey_queries import MORE, _named
from textlake.plans.text_queries import EXACT, FUZZY, VEC, _vectors
from textlake.providers import extractive
from textlake.sources.tables import small, table

_N: list[str] = []
WANTS = Literal("wants", "query_id bigint, text string, name string, section string, attribute string, words array<string>, sections array<string>, needs_image boolean, candidates array<string>, plan_name string, phrases array<string>", [
    (1, "contraindications", "velmotrazine", "contraindications", None, _N, _N, False, _N, None, _N),
    (2, "indications", "VELMOTRAZINE", "indications for therapy", None, _N, _N, False, _N, None, _N),
    (3, "half-life", "velmotrazine", None, "half_life", ["half-life", "hours", "clearance"], ["kinetics", "overdose", "contraindications"], False, _N, None, _N),
    (4, "structure", "velmotrazine", "structure", None, _N, _N, True, _N, None, _N),
    (5, "all of it", "velmotrazine", None, None, _N, _N, False, _N, None, _N),
    (6, "forms", None, None, None, _N, _N, False, ["dosage forms", "contraindications"], "velmotrazine", _N),
    (7, "liver", "velmotrazine", "qqqqqq", None, _N, _N, False, _N, None, _N),
    (8, "zzz", None, None, None, _N, _N, False, ["other"], "velmotrazine", ["blood pressure", "placenta"]),
    (9, "nothing", "no such name", "x", None, _N, _N, False, _N, None, ["zzzz zzzz"]),
    (10, "children", "velmotrazine", None, "dose", ["children"], ["nowhere", "use in children"], False, _N, None, _N),
])

BY_NAME = "(SELECT DISTINCT w.query_id, w.section, w.sections, s.id FROM monograph_sections s JOIN wants w ON lower(s.drug_name) = lower(w.name) OR lower(s.brand_name) = lower(w.name) OR lower(s.generic_name) = lower(w.name) WHERE {c})"
CORE = "[" + ", ".join(f"'{w}'" for w in V.CORE) + "]"


def _exact(source: str, extra: str = "") -> str:
    """SQL of the exact path over (query_id, name, section)."""
    named = f"(SELECT DISTINCT query_id, section, s.id FROM monograph_sections s JOIN {source} a ON lower(s.drug_name) = lower(a.name) OR lower(s.brand_name) = lower(a.name) OR lower(s.generic_name) = lower(a.name) WHERE section IS NOT NULL {extra})"
    return f"SELECT n.query_id, s.id, row_number() OVER (PARTITION BY n.query_id ORDER BY s.page_start NULLS LAST, s.id) AS rank FROM {named} n JOIN monograph_sections s USING (id) WHERE lower(trim(s.section_name)) = lower(trim(n.section)) AND NOT coalesce({JUNK.format(x='s.content_text')}, false)"


def _fuzzy(source: str) -> str:
    named = f"(SELECT DISTINCT query_id, section, s.id FROM monograph_sections s JOIN {source} a ON lower(s.drug_name) = lower(a.name) OR lower(s.brand_name) = lower(a.name) OR lower(s.generic_name) = lower(a.name) WHERE section IS NOT NULL)"
    return f"SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT n.query_id, s.id, round({similarity('s.section_name', 'n.section')}, 6) AS similarity FROM {named} n JOIN monograph_sections s USING (id)) WHERE similarity > 0.2) WHERE rank <= 10"


IMAGE = f"SELECT n.query_id, s.id, row_number() OVER (PARTITION BY n.query_id ORDER BY CASE WHEN contains(lower(section_name), 'structure') THEN 1 WHEN contains(lower(section_name), 'chemical') THEN 2 WHEN contains(lower(section_name), 'description') THEN 3 ELSE 4 END, page_start NULLS LAST, s.id) AS rank FROM {BY_NAME.format(c='needs_image AND has_chemical_structure')} n JOIN monograph_sections s USING (id)"
STATED = "SELECT query_id, fact_span_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY fact_span_id) AS rank, '- ' || trim(sentence_text) AS line FROM fact_spans f JOIN wants w ON lower(f.drug_name) = lower(w.name) WHERE attribute IS NOT NULL AND assertion_type IN ('FACT', 'CONDITIONAL') AND len(list_filter(sections, lambda s: contains(lower(section_enum), lower(s)))) > 0"
SENTENCES = "SELECT query_id, fact_span_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY first, fact_span_id) AS rank, upper(section_enum) AS section FROM (SELECT *, min(fact_span_id) OVER (PARTITION BY query_id, section_enum) AS first FROM fact_spans f JOIN wants w ON lower(f.drug_name) = lower(w.name) WHERE attribute IS NOT NULL AND lower(trim(source_type)) IN ('sentence', 'sent.') AND len(list_filter(sections, lambda s: contains(lower(section_enum), lower(s)))) > 0 AND len(list_filter(words, lambda x: contains(lower(sentence_text), lower(x)))) > 0)"
ALLOWED = f"SELECT n.query_id, s.id, row_number() OVER (PARTITION BY n.query_id ORDER BY page_start NULLS LAST, s.id) AS rank FROM {BY_NAME.format(c='attribute IS NOT NULL')} n JOIN monograph_sections s USING (id) WHERE len(list_filter(sections, lambda x: contains(lower(section_name), lower(x)))) > 0"
WHOLE = f"SELECT n.query_id, s.id, row_number() OVER (PARTITION BY n.query_id ORDER BY section_name NULLS LAST, page_start NULLS LAST, s.id) AS rank FROM {BY_NAME.format(c='w.section IS NULL AND attribute IS NULL AND NOT needs_image')} n JOIN monograph_sections s USING (id)"
PLANNED = f"""pq AS (SELECT query_id * 100 + i AS query_id, plan_name AS name, c AS section FROM (SELECT query_id, plan_name, unnest(candidates) AS c, generate_subscripts(candidates, 1) - 1 AS i FROM wants WHERE len(list_filter(candidates, lambda c: len(list_filter({CORE}, lambda w: contains(lower(c), w))) > 0)) > 0)),
    pe AS ({_exact('pq')}), pf AS ({_fuzzy('pq')}), pu AS (SELECT * FROM pe UNION ALL SELECT * FROM pf WHERE query_id NOT IN (SELECT query_id FROM pe)), pm AS (SELECT query_id // 100 AS q, id, min(query_id * 1000000 + rank) AS pos FROM pu GROUP BY 1, 2), p AS (SELECT q AS query_id, id, row_number() OVER (PARTITION BY q ORDER BY pos, id) AS rank FROM pm)"""
LEXICAL = r"""ld AS (SELECT fact_span_id, lower(drug_name) AS name, regexp_extract_all(lower(sentence_text), '([a-z0-9]+)', 1) AS w FROM fact_spans WHERE sentence_text IS NOT NULL),
    ln AS (SELECT count(*) AS n, avg(len(w)) AS m FROM ld), lt AS (SELECT fact_span_id, name, len(w) AS l, term, count(*) AS tf FROM (SELECT fact_span_id, name, w, unnest(w) AS term FROM ld) GROUP BY ALL),
    lf AS (SELECT term, count(*) AS df FROM lt GROUP BY term), lq AS (SELECT DISTINCT query_id, lower(name) AS name, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM wants WHERE name IS NOT NULL), lk AS (SELECT query_id, count(*) AS k FROM lq GROUP BY query_id),
    ls AS (SELECT lq.query_id, lt.fact_span_id, count(*) AS c, round(sum(ln(1 + (ln.n - lf.df + 0.5) / (lf.df + 0.5)) * lt.tf * 2.2 / (lt.tf + 1.2 * (0.25 + 0.75 * lt.l / ln.m))), 6) AS score FROM lq JOIN lt ON lq.term = lt.term AND lq.name = lt.name JOIN lf ON lf.term = lq.term CROSS JOIN ln GROUP BY lq.query_id, lt.fact_span_id),
    lr AS (SELECT query_id, fact_span_id, rank FROM (SELECT ls.*, row_number() OVER (PARTITION BY ls.query_id ORDER BY score DESC, fact_span_id) AS rank FROM ls JOIN lk ON ls.query_id = lk.query_id AND ls.c = lk.k) WHERE rank <= 60),
    lx AS (SELECT query_id, id, rank FROM (SELECT query_id, fact_span_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, hit) AS rank FROM (SELECT lr.query_id, lr.fact_span_id, lr.rank AS hit, round({sim}, 6) AS similarity FROM lr JOIN fact_spans f USING (fact_span_id) JOIN wants w ON w.query_id = lr.query_id WHERE NOT coalesce({junk}, false))) WHERE rank <= 15)""".replace("{sim}", similarity("f.sentence_text", "w.text")).replace("{junk}", JUNK.format(x="f.sentence_text"))
SUBSTRING = f"SELECT query_id, id, rank FROM (SELECT query_id, fact_span_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY section_id NULLS LAST, sentence_index NULLS LAST, fact_span_id) AS rank FROM (SELECT DISTINCT query_id, fact_span_id, section_id, sentence_index FROM fact_spans f JOIN (SELECT query_id, unnest(phrases[1:5]) AS p FROM wants) ON contains(lower(sentence_text), lower(p)) WHERE NOT coalesce({JUNK.format(x='sentence_text')}, false))) WHERE rank <= 50"
PATHS = (
    ("IMAGE", f"SELECT * FROM ({IMAGE})"), ("SQL_EXACT", _exact("wants")), ("SQL_FUZZY", _fuzzy("wants")), ("ATTRIBUTE", f"SELECT query_id, id, rank FROM ({STATED})"), ("SENTENCES", f"SELECT query_id, id, rank FROM ({SENTENCES})"),
    ("ATTRIBUTE_SECTIONS", ALLOWED), ("NAME", WHOLE), ("SECTION_LOOKUP", "SELECT query_id, id, rank FROM p"), ("LEXICAL", "SELECT query_id, id, rank FROM lx"), ("SUBSTRING", SUBSTRING),
)
CASCADE = f"WITH {WANTS.cte}, {PLANNED}, {LEXICAL}, u AS (" + " UNION ALL ".join(f"SELECT query_id, id, rank, '{n}' AS path, {i} AS o FROM ({sql})" for i, (n, sql) in enumerate(PATHS)) + "), cb AS (SELECT *, min(o) OVER (PARTITION BY query_id) AS m FROM u), c AS (SELECT w.query_id, coalesce(cb.path, 'NONE') AS path, cb.id, cb.rank FROM wants w LEFT JOIN cb ON w.query_id = cb.query_id AND cb.o = cb.m)"


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "monograph_sections"), table(spark, d, "fact_spans")


@query("r1_full_cascade", f"{CASCADE} SELECT * FROM c")
def r1(spark: SparkSession, d: str) -> DataFrame:
    """The first of ten paths that finds anything, for each question."""
    return retrieve.cascade(WANTS.df(spark), *_tables(spark, d), V.CORE)


@query("a12_suite_summary", f"{CASCADE}, o AS (SELECT DISTINCT query_id, path FROM c) SELECT path, count(*) AS questions, round(count(*) / (SELECT count(*) FROM o), 6) AS share, path <> 'NONE' AS passed FROM o GROUP BY path")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """How many questions each path answers."""
    paths = r1(spark, d).select("query_id", "path").distinct()
    n = paths.agg(F.count("*").alias("_n"))
    return paths.groupBy("path").agg(F.count("*").alias("questions")).join(F.broadcast(n)).select("path", "questions", F.round(F.col("questions") / F.col("_n"), 6).alias("share"), (F.col("path") != "NONE").alias("passed"))


@query("r4_stated", f"WITH {WANTS.cte} {STATED}")
def r4(spark: SparkSession, d: str) -> DataFrame:
    """All facts and conditions of a name in the sections of an attribute."""
    return retrieve.stated(WANTS.df(spark), table(spark, d, "fact_spans"))


@query("r5_filtered_sentences", f"WITH {WANTS.cte} {SENTENCES}")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a name with an attribute's words, by section."""
    return retrieve.filtered(WANTS.df(spark), table(spark, d, "fact_spans"))


@query("r6_allowed_sections", f"WITH {WANTS.cte} {ALLOWED}")
def r6(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a name that may hold an attribute."""
    return retrieve.allowed_sections(WANTS.df(spark), table(spark, d, "monograph_sections")).select("query_id", "id", "rank")


@query("r7_whole_name", f"WITH {WANTS.cte} {WHOLE}")
def r7(spark: SparkSession, d: str) -> DataFrame:
    """All sections of a name, by section and page."""
    return retrieve.whole_name(WANTS.df(spark).where("not needs_image"), table(spark, d, "monograph_sections")).select("query_id", "id", "rank")


@query("r8_image_order", f"WITH {WANTS.cte} {IMAGE}")
def r8(spark: SparkSession, d: str) -> DataFrame:
    """Sections with a structure, those named for it first."""
    return retrieve.images(WANTS.df(spark), table(spark, d, "monograph_sections")).select("query_id", "id", "rank")


@query("r12_planned_sections", f"WITH {WANTS.cte}, {PLANNED} SELECT * FROM p")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """The sections that a plan names, merged."""
    return retrieve.planned(WANTS.df(spark), table(spark, d, "monograph_sections"), V.CORE)


@query("t5_reranked", f"WITH {WANTS.cte}, {LEXICAL} SELECT * FROM lx")
def t5(spark: SparkSession, d: str) -> DataFrame:
    """Of the sixty best by words the fifteen most like the question."""
    spans = table(spark, d, "fact_spans")
    own = spans.where("sentence_text is not null").withColumn("name", F.lower("drug_name"))
    asked = WANTS.df(spark).where("name is not null").select("query_id", F.lower("name").alias("name"), "text")
    hits = lexical.rank(lexical.index(own, "fact_span_id", "sentence_text", ("name",)), asked, own.withColumn("_text", F.col("sentence_text")), "fact_span_id", 60, "name")
    return retrieve.best_worded(hits, spans, asked)


@query("u3_merged_parts", f"WITH {ASKED.cte}, e AS ({EXACT}), f AS ({FUZZY}), r AS (SELECT query_id, id, 0 AS part, rank FROM e UNION ALL SELECT query_id, id, 1, rank FROM f), m AS (SELECT query_id, id, min(part * 1000000 + rank) AS pos FROM r GROUP BY ALL) SELECT query_id, id, (pos // 1000000)::INT AS part, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS rank FROM m")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Exact and similar hits as one list, each section where it stands first."""
    asked, sections = ASKED.df(spark), table(spark, d, "monograph_sections")
    parts = [f(asked, sections).select("query_id", "id", F.lit(i).alias("part"), "rank") for i, f in enumerate((retrieve.exact, retrieve.fuzzy))]
    return retrieve.merged(parts[0].unionByName(parts[1]))


@query("pred4_fuzzy_or_keyword", f"WITH {ASKED.cte} SELECT DISTINCT n.query_id, s.id FROM (SELECT DISTINCT query_id, section, s.id FROM monograph_sections s JOIN asked a ON lower(s.drug_name) = lower(a.name) OR lower(s.brand_name) = lower(a.name) OR lower(s.generic_name) = lower(a.name) WHERE section IS NOT NULL) n JOIN monograph_sections s USING (id) WHERE {similarity('s.section_name', 'n.section')} > 0.2 OR (contains(lower(n.section), 'indication') AND (contains(lower(section_name), 'therapeutic') OR contains(lower(section_name), 'uses'))) OR (contains(lower(n.section), 'storage') AND contains(lower(section_name), 'shelf'))")
def pred4(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose name is like the one asked for, or holds a word that goes with it."""
    return retrieve.alike_or_worded(ASKED.df(spark), table(spark, d, "monograph_sections"), {"indication": ["therapeutic", "uses"], "storage": ["shelf"]}).select("query_id", "id")


@query("pred12_one_schema", f"WITH {ASKED.cte}, e AS ({EXACT}), f AS ({FUZZY}) SELECT query_id, id, rank, 'EXACT' AS path, page_start, page_end, NULL::DOUBLE AS similarity FROM e JOIN monograph_sections USING (id) UNION ALL SELECT query_id, id, rank, 'FUZZY', NULL, NULL, similarity FROM f")
def pred12(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two paths under one schema; what a path hasn't is null."""
    asked, sections = ASKED.df(spark), table(spark, d, "monograph_sections")
    one = retrieve.exact(asked, sections).select("query_id", "id", "rank", F.lit("EXACT").alias("path"), "page_start", "page_end")
    return one.unionByName(retrieve.fuzzy(asked, sections).select("query_id", "id", "rank", F.lit("FUZZY").alias("path"), "similarity"), allowMissingColumns=True)


@query("g4_numbered_context", f"WITH {ASKED.cte}, e AS ({EXACT}) SELECT query_id, string_agg('[Source ' || rank || '] ' || coalesce(drug_name, 'Unknown') || ', Page ' || coalesce(page_start::VARCHAR, 'Unknown') || ', Section: ' || coalesce(section_name, 'Unknown') || chr(10) || coalesce(content_text, '') || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM e JOIN monograph_sections s USING (id) WHERE rank <= 20 GROUP BY query_id")
def g4(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty hits of each question as numbered sources."""
    hits = retrieve.exact(ASKED.df(spark), table(spark, d, "monograph_sections"))
    return retrieve.numbered(hits.select("query_id", "rank", F.col("drug_name").alias("name"), F.col("page_start").alias("page"), F.col("section_name").alias("section"), F.col("content_text").alias("text")), 20)


@query("g11_evaluation_run", f"WITH {ASKED.cte}, e AS ({EXACT}), c AS (SELECT query_id, count(*) AS contexts, sum(length(coalesce(content_text, ''))) AS size FROM e JOIN monograph_sections s USING (id) WHERE rank <= 20 GROUP BY query_id) SELECT query_id, coalesce(contexts, 0) AS contexts, coalesce(contexts, 0) > 0 AS answered FROM asked LEFT JOIN c USING (query_id)")
def g11(spark: SparkSession, d: str) -> DataFrame:
    """Every question through search, context and the default answer."""
    asked = ASKED.df(spark)
    made = retrieve.context(retrieve.exact(asked, table(spark, d, "monograph_sections")).where("rank <= 20"), "content_text", "section_name")
    whole = asked.select("query_id").join(made, "query_id", "left")
    said = extractive(whole).join(whole.select("query_id", F.coalesce("sources", F.lit(0)).alias("contexts")), "query_id")
    return said.select("query_id", "contexts", (F.col("answer") != "No evidence was found for this question.").alias("answered"))


HITS = f"h AS (SELECT query_id, vec_id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id, round({VEC.format(a='q.embedding', b='r.embedding')}, 6) AS distance FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)) WHERE rank <= 40)"


@query("j1_hits_with_metadata", f"WITH {HITS} SELECT query_id, vec_id, rank, label FROM h JOIN embeddings USING (vec_id)")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """The forty nearest of each question with what is known of them, in their order."""
    return _hits(spark, d).select("query_id", "vec_id", "rank", "label")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    near = vectors.knn(rows, asked, 41).where("query_id != vec_id").select("query_id", "vec_id", "distance")
    placed = near.withColumn("rank", F.expr("row_number() over (partition by query_id order by distance, vec_id)")).where("rank <= 40")
    return rows.select("vec_id", "label").join(small(placed), "vec_id")


PICKED = Literal("picked", "query_id bigint, chosen array<int>", [(1, [0, 2]), (2, []), (3, [5]), (4, [1])])


@query("j10_chosen_candidates", f"WITH {PICKED.cte}, {ASKED.cte}, e AS ({EXACT}) SELECT e.query_id, e.id FROM e JOIN picked p ON p.query_id = e.query_id AND list_contains(chosen, e.rank - 1)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose position a model has chosen."""
    hits = retrieve.exact(ASKED.df(spark), table(spark, d, "monograph_sections")).select("query_id", "id", (F.col("rank") - 1).alias("n"))
    chosen = PICKED.df(spark).select("query_id", F.explode("chosen").alias("n"))
    return hits.join(small(chosen), ["query_id", "n"], "left_semi").select("query_id", "id")


@query("r16_composed_context", f"""WITH {HITS}, a AS (SELECT h.*, r.label, q.label AS wanted FROM h JOIN embeddings r USING (vec_id) JOIN embeddings q ON q.vec_id = h.query_id),
    s AS (SELECT * FROM (SELECT *, bool_or(label = wanted) OVER (PARTITION BY query_id) AS hit FROM a) WHERE label = wanted OR NOT hit), k AS (SELECT query_id, vec_id, distance, label, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s),
    n AS (SELECT * FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS m FROM k) WHERE rank <= 3 OR (rank <= 6 AND distance <= 1.2 * m)), c AS (SELECT query_id, bool_or(label = 3) AS has FROM n GROUP BY query_id), b AS (SELECT query_id, arg_min(vec_id, rank) AS best FROM k WHERE label = 3 GROUP BY query_id),
    f AS (SELECT k.*, NOT c.has AND coalesce(k.vec_id = b.best, false) AS forced, n.vec_id IS NOT NULL AS inside FROM k JOIN c USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN n ON n.query_id = k.query_id AND n.vec_id = k.vec_id),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN forced THEN 0 ELSE rank END) AS o FROM f WHERE inside OR forced) WHERE o <= 6) SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY CASE label WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 99 END, rank) AS place FROM p""")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """A context from nearest neighbours: filters that never empty it, a cut by distance, a section that must be in, an order."""
    hits = _hits(spark, d).select("query_id", "rank", "distance", F.col("vec_id").alias("id"), F.col("label").cast("string").alias("section"), F.lit(None).cast("string").alias("name"))
    wanted = _vectors(spark, d)[1].select("query_id", F.col("label").cast("string").alias("section"), F.lit(None).cast("string").alias("name"))
    return retrieve.composed(hits, wanted, 3, 6, "3", ["2", "1"])


@query("r23_routes", f"WITH {WANTS.cte} SELECT query_id, CASE WHEN name IS NOT NULL AND section IS NOT NULL THEN 'EXHAUSTIVE' ELSE 'VARIANTS' END AS route FROM wants")
def r23(spark: SparkSession, d: str) -> DataFrame:
    """Which questions get a whole section, and which are searched in several wordings."""
    return WANTS.df(spark).select("query_id", F.when(F.col("name").isNotNull() & F.col("section").isNotNull(), "EXHAUSTIVE").otherwise("VARIANTS").alias("route"))


@query("r29_direct_questions", f"WITH {ASKED.cte} SELECT query_id, coalesce(section, 'all sections') || ' of ' || name AS text FROM asked")
def r29(spark: SparkSession, d: str) -> DataFrame:
    """Direct requests as questions."""
    return retrieve.as_questions(ASKED.df(spark))


@query("d6_truncated", "SELECT count(*) AS left_over FROM drug_names WHERE false")
def d6(spark: SparkSession, d: str) -> DataFrame:
    """A table after all its rows went."""
    return upkeep.truncated(table(spark, d, "drug_names")).agg(F.count("*").alias("left_over"))


@query("s17_index_facts", "SELECT count(*) AS rows, max(len(embedding)) AS dim FROM embeddings")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """What the vectors' table holds, without reading them all."""
    from textlake.sources import files

    return files.index_facts(spark, f"{d}/embeddings.parquet")


RELATED = "(SELECT ' ' || string_agg(s, ' ' ORDER BY o) FROM (SELECT s, o FROM (VALUES " + ", ".join(f"('{k}', '{w}', {i})" for i, (k, w) in enumerate((k, w) for k, ws in V.EXPANSIONS.items() for w in ws)) + ") v(k, s, o) WHERE contains({x}, k) AND NOT contains({x}, s) ORDER BY o LIMIT 3))"


@query("r26_names_and_wording", f"""WITH {MORE.cte}, n AS (SELECT count(*) AS n FROM chunks), b AS (SELECT query_id, text, lower(text) AS t, CASE WHEN n < 3000 THEN 5 WHEN n < 6000 THEN 8 WHEN n < 12000 THEN 10 ELSE 12 END AS lo, CASE WHEN n < 3000 THEN 8 WHEN n < 6000 THEN 12 WHEN n < 12000 THEN 15 ELSE 20 END AS hi FROM more_questions, n),
    k AS (SELECT *, len(list_filter({V.COMPLEX}, lambda w: contains(t, w))) > 0 AS c, len(list_filter({V.COMPREHENSIVE}, lambda w: contains(t, w))) > 0 AS a FROM b)
    SELECT query_id, {_named('text')} AS name, text || coalesce({RELATED.replace('{x}', 't')}, '') AS wider, lo + CASE WHEN c THEN 3 WHEN a THEN 10 ELSE 0 END AS least, hi + CASE WHEN c THEN 5 WHEN a THEN 15 ELSE 0 END AS most FROM k""")
def r26(spark: SparkSession, d: str) -> DataFrame:
    """The name, the wider wording and the size of context of each question."""
    from textlake.operators import intent

    n = table(spark, d, "chunks").agg(F.count("*").alias("n"))  # one row
    return MORE.df(spark).join(F.broadcast(n)).select("query_id", intent.named(F.col("text")).alias("name"), intent.widened(F.col("text")).alias("wider"), intent.context_size(F.col("text"), F.col("n")).alias("size")).select("query_id", "name", "wider", "size.*")


@query("f17_expanded_headers", f"WITH h AS (SELECT DISTINCT {squeeze('lower(original_header)')} AS h FROM section_mappings WHERE original_header IS NOT NULL) SELECT h, h || coalesce((SELECT ' ' || string_agg(s, ' ' ORDER BY o) FROM (SELECT s, o FROM (VALUES " + ", ".join(f"('{k}', '{w}', {i})" for i, (k, w) in enumerate((k, w) for k, ws in V.EXPANSIONS.items() for w in ws)) + ") v(k, s, o) WHERE contains(h, k) AND NOT contains(h, s) ORDER BY o LIMIT 3)), '') AS wider FROM h")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """All headings, widened by related terms."""
    from textlake.operators import intent

    return table(spark, d, "section_mappings").where("original_header is not null").select(T.squeeze(F.lower("original_header")).alias("h")).distinct().select("h", intent.widened(F.col("h")).alias("wider"))
