"""Queries for what questions ask, how documents are structured, and how answers are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.operators import intent, lookup, retrieve, structure, upkeep
from textlake.plans.base import QUESTIONS, Literal, query, squeeze
from textlake.sources.tables import table


def _list(values: list[str]) -> str:
    """A list of strings in SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pairs(name: str, pairs: list[tuple[str, str]]) -> str:
    """A common table expression name(ord, kind, phrase)."""
    return Literal(name, "ord int, kind string, phrase string", [(i, k, p) for i, (k, p) in enumerate(pairs)]).cte


def _split(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(k, p.strip()) for k, words in pairs for p in words.split(",")]


MORE = Literal("more_questions", "query_id bigint, text string", [
    (1, "What is the half-life of Velmotrazine?"), (2, "Side effects of Velmotrazine"), (3, "Show me the chemical structure of Orm-Lelpryatrol"), (4, "tell me about Stistjeivax and children"), (5, "What does Velmotrazine look like?"), (6, "avoid with alcohol; too much"), (7, "Which dose, and what is the   dosage form?"), (8, ""), (9, "Velmotrazine dosage"), (10, "how does it work"), (11, "Is clearance lower in renal impairment?"),
])
LOW = f"lower({squeeze('text')})"


# --- what questions ask ---


def _longest(pairs: str, inside: str, name: str, least: float, most: float) -> str:
    return f"""p AS (SELECT * FROM {pairs}), m AS (SELECT query_id, kind, length(phrase) AS hit, length({LOW}) AS size, row_number() OVER (PARTITION BY query_id ORDER BY length(phrase) DESC, ord) AS r FROM more_questions JOIN p ON {inside})
    SELECT q.query_id, kind AS {name}, round(coalesce(greatest({least}, least({most}, 2 * hit / size)), 0.0), 6) AS confidence FROM more_questions q LEFT JOIN m ON m.query_id = q.query_id AND r = 1"""


@query("r25_section_intent", f"WITH {MORE.cte}, {_pairs('w', V.INTENTS)}, " + _longest("w", f"contains({LOW}, phrase)", "section", 0.5, 1.0))
def r25(spark: SparkSession, d: str) -> DataFrame:
    """What kind of section each question asks for."""
    return intent.section_intents(spark, MORE.df(spark))


@query("f20_attribute_intent", f"WITH {MORE.cte}, {_pairs('w', V.ATTRIBUTE_WORDS)}, " + _longest("w", rf"regexp_matches(' ' || {LOW} || ' ', '[^\p{{L}}\p{{N}}_]' || regexp_escape(phrase) || '[^\p{{L}}\p{{N}}_]')", "attribute", 0.6, 0.95))
def f20(spark: SparkSession, d: str) -> DataFrame:
    """What attribute each question asks for."""
    return intent.attribute_intents(spark, MORE.df(spark))


@query("r26_picture_intent", f"WITH {MORE.cte} SELECT query_id, len(list_filter({_list(V.PICTURES)}, lambda w: contains(lower(text), w))) > 0 OR regexp_matches(lower(text), 'what does .+ look like') AS needs_image FROM more_questions")
def r26p(spark: SparkSession, d: str) -> DataFrame:
    """Which questions ask for a picture."""
    return MORE.df(spark).select("query_id", intent.asks_picture(F.col("text")).alias("needs_image"))


def _named(text: str) -> str:
    tries = ", ".join(f"(SELECT CASE WHEN n <> '' AND NOT list_contains({_list(V.NOT_NAMES)}, n) THEN n END FROM (SELECT lower(trim(regexp_extract({text}, '(?i){p.replace(chr(39), chr(39) * 2)}', 1))) AS n))" for p in V.NAME_PATTERNS)
    return f"coalesce({tries})"


@query("f32_names_in_questions", f"WITH {MORE.cte} SELECT query_id, {_named('text')} AS name FROM more_questions")
def f32(spark: SparkSession, d: str) -> DataFrame:
    """The name each question asks about."""
    return MORE.df(spark).select("query_id", intent.named(F.col("text")).alias("name"))


@query("f33_capitalised", rf"WITH {MORE.cte} SELECT query_id, coalesce(lower(list_filter(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')), lambda w: length(w) > 3 AND regexp_matches(w, '^\p{{Lu}}'))[1]), 'unknown') AS name FROM more_questions")
def f33(spark: SparkSession, d: str) -> DataFrame:
    """The first longer word with a capital."""
    return MORE.df(spark).select("query_id", intent.capitalised(F.col("text")).alias("name"))


@query("f18_whole_section", f"""WITH {MORE.cte}, {_pairs('w', _split([(s, w) for s, w, _ in V.WHOLE_SECTIONS]))}, m AS (SELECT query_id, kind, ord, round(least(1.0, 0.7 + CASE WHEN len(string_split(phrase, ' ')) >= 2 THEN 0.15 ELSE 0.0 END + CASE WHEN len(string_split(phrase, ' ')) / len(string_split({LOW}, ' ')) > 0.3 THEN 0.15 ELSE 0.0 END), 6) AS c FROM more_questions JOIN w ON contains({LOW}, phrase))
    SELECT query_id, kind AS section, c::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, ord) AS r FROM m) WHERE r = 1""")
def f18(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask for a section as a whole."""
    return intent.whole_sections(spark, MORE.df(spark))


@query("r22_first_kind", f"WITH {MORE.cte}, {_pairs('w', _split(V.KINDS))} SELECT q.query_id, (SELECT arg_min(kind, ord) FROM w WHERE contains(lower(q.text), phrase)) AS kind FROM more_questions q")
def r22(spark: SparkSession, d: str) -> DataFrame:
    """The first of six kinds of question, in order."""
    return intent.first_kind(spark, MORE.df(spark))


@query("f21_search_terms", rf"WITH {MORE.cte} SELECT query_id, {squeeze(r"regexp_replace(text, '[^\p{L}\p{N}_\s-]', '', 'g')")} AS terms FROM more_questions")
def f21(spark: SparkSession, d: str) -> DataFrame:
    """Questions without what a search would take for an operator."""
    return MORE.df(spark).select("query_id", T.search_terms("text").alias("terms"))


PLANS = Literal("plans", "query_id bigint, text string, plan string", [
    (1, "What is Axid?", '{"drug": "Axid", "query_mode": "SECTION", "attribute": null, "candidate_sections": ["dosage forms"], "search_phrases": ["axid"], "extraction_level": "sentence", "confidence": 0.9}'),
    (2, "dose", '{"drug": " ", "query_mode": "ALL", "attribute": "half_life", "search_phrases": [], "extraction_level": "page"}'), (3, "Is Gravol safe?", "no plan"), (4, "x", "{}"), (5, "is it safe", None),
])


@query("f22_plans", f"""WITH {PLANS.cte}, j AS (SELECT query_id, text, CASE WHEN plan IS NOT NULL AND json_valid(plan) THEN plan::JSON END AS p FROM plans)
    SELECT query_id, CASE WHEN trim(coalesce(p->>'$.drug', '')) <> '' THEN lower(p->>'$.drug') WHEN p IS NOT NULL THEN 'unknown' ELSE coalesce(lower(list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')), lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{{Lu}}'))[1]), 'unknown') END AS drug,
    CASE WHEN (p->>'$.query_mode') IN ('SECTION', 'ATTRIBUTE', 'MULTI_SECTION', 'GENERIC', 'GLOBAL') THEN p->>'$.query_mode' ELSE 'GLOBAL' END AS query_mode, p->>'$.attribute' AS attribute, coalesce(from_json(p->'$.candidate_sections', '["VARCHAR"]'), []) AS candidate_sections,
    CASE WHEN len(from_json(p->'$.search_phrases', '["VARCHAR"]')) > 0 THEN from_json(p->'$.search_phrases', '["VARCHAR"]') ELSE [text] END AS search_phrases, CASE WHEN p->>'$.extraction_level' = 'sentence' THEN 'sentence' ELSE 'block' END AS extraction_level, CASE WHEN p IS NULL THEN 0.3 ELSE coalesce((p->>'$.confidence')::DOUBLE, 0.5) END::DOUBLE AS confidence FROM j""")
def f22(spark: SparkSession, d: str) -> DataFrame:
    """Plans with every field as it must be."""
    return intent.plans(PLANS.df(spark))


REPLIES = Literal("replies", "reply_id bigint, reply string", [(1, "DRUG: Axid\nSECTION: dosage"), (2, "drug unknown\nSECTION: none\nDRUG:  "), (3, "BRAND: Axid\nGENERIC: Nizatidine"), (4, "BRAND: Gravol\nGENERIC: unknown"), (5, "Product Monograph - Velmotrazine\nfor adults"), (6, "nothing"), (7, "Axid 150 mg capsules")])
LINE = "nullif(nullif(lower(trim(regexp_extract(reply, '(?:^|\\n){x}:[ \\t]*([^\\n]*)', 1))), ''), 'unknown')"


@query("f24_reply_lines", f"WITH {REPLIES.cte} SELECT reply_id, {LINE.format(x='DRUG')} AS drug, nullif({LINE.format(x='SECTION')}, 'none') AS section FROM replies")
def f24(spark: SparkSession, d: str) -> DataFrame:
    """Name and section from the lines of a model's reply."""
    section = T.reply_line("reply", "SECTION")
    return REPLIES.df(spark).select("reply_id", T.reply_line("reply", "DRUG").alias("drug"), F.when(section != "none", section).alias("section"))


@query("f25_names_of_replies", rf"WITH {REPLIES.cte} SELECT reply_id, {LINE.format(x='BRAND')} AS brand, {LINE.format(x='GENERIC')} AS generic, coalesce({LINE.format(x='GENERIC')}, {LINE.format(x='BRAND')}, nullif(lower(regexp_extract(reply, '(?i)(?:product\s+monograph|prescribing\s+information)[\s-]*([a-z]+)', 1)), ''), nullif(lower(regexp_extract(reply, '(?:^|\n)([A-Z][A-Za-z]{{3,}})\s[^\n]*(?:tablet|capsule|injection)', 1)), ''), 'unknown_drug') AS name FROM replies")
def f25(spark: SparkSession, d: str) -> DataFrame:
    """A document's name: the generic one, else the brand, else what its title says."""
    return REPLIES.df(spark).select("reply_id", T.reply_line("reply", "BRAND").alias("brand"), T.reply_line("reply", "GENERIC").alias("generic"), T.document_name("reply").alias("name"))


@query("f30_first_page_names", r"""WITH l AS (SELECT document_hash, file_name, i, trim(x) AS t, trim(lead(x) OVER (PARTITION BY document_hash ORDER BY i)) AS nxt FROM (SELECT document_hash, file_name, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM parsed_documents) WHERE i <= 21),
    c AS (SELECT document_hash, i, CASE WHEN starts_with(t, 'Pr') AND length(t) BETWEEN 6 AND 51 THEN trim(substring(t, 3)) WHEN contains(upper(t), 'PRODUCT MONOGRAPH') AND length(nxt) BETWEEN 4 AND 49 THEN nxt WHEN regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}') AND length(t) BETWEEN 4 AND 49 AND NOT regexp_matches(t, 'PAGE|TABLE|PART|SECTION') THEN t END AS name FROM l WHERE i <= 20)
    SELECT d.document_hash, coalesce(arg_min(c.name, c.i) FILTER (c.name IS NOT NULL), any_value(d.file_name)) AS name FROM parsed_documents d LEFT JOIN c ON c.document_hash = d.document_hash GROUP BY d.document_hash""")
def f30(spark: SparkSession, d: str) -> DataFrame:
    """A name from the first twenty lines of each document, else its file's; twenty lines are the rule's first page."""
    return structure.first_page_names(table(spark, d, "parsed_documents"), "document_hash", "raw_text", "file_name")


@query("f27_mime_types", "SELECT file_path, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM files")
def f27m(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of files by their suffix."""
    return table(spark, d, "files").select("file_path", T.mime_type("file_path").alias("mime"))


@query("f29_elapsed", "SELECT id, (epoch_us(updated_at) - epoch_us(created_at)) // 1000 AS elapsed_ms, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM section_mappings WHERE created_at IS NOT NULL AND updated_at IS NOT NULL")
def f29(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds between two times, and the first as ISO text."""
    rows = table(spark, d, "section_mappings").where("created_at is not null and updated_at is not null")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("id", F.floor((us("updated_at") - us("created_at")) / 1000).alias("elapsed_ms"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


VALID = Literal("given", "answer_id bigint, answer string, chunks int", [(1, "x" * 501, 0), (2, "Information not found in available monographs.", 9), (3, "y" * 120, 2), (4, "short", 5), (5, "z" * 80, 0), (6, "y" * 120, 0)])


@query("f31_valid_answers", f"WITH {VALID.cte} SELECT answer_id, CASE WHEN length(answer) > 500 THEN true WHEN lower(trim(answer)) = 'information not found in available monographs.' THEN false WHEN length(answer) > 100 AND chunks > 0 THEN true ELSE length(answer) >= 50 END AS valid FROM given")
def f31(spark: SparkSession, d: str) -> DataFrame:
    """Answers that say something."""
    return VALID.df(spark).select("answer_id", retrieve.is_valid(F.col("answer"), F.col("chunks")).alias("valid"))


@query("f3_header_title", rf"SELECT h, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(s[i - 1], '\p{{L}}') THEN upper(s[i]) ELSE s[i] END), '') AS title FROM (SELECT h, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(h)), '^section ', ''), '^part ', ''), '^chapter ', ''), '^§ ', ''), '^[\d.]+\s*', ''), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', ' ', 'g')) AS s FROM (SELECT DISTINCT original_header AS h FROM section_mappings WHERE original_header IS NOT NULL))")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Headings with capitals."""
    return table(spark, d, "section_mappings").where("original_header is not null").select(F.col("original_header").alias("h")).distinct().select("h", T.header_title("h").alias("title"))


TEMPLATES = Literal("wordings", "kind string, ord int, template string", [(k, i, t) for k, ts in {
    "harm not to use": ["contraindications of {name}", "when not to use {name}", "{name} should not be used"], "side effects": ["adverse reactions of {name}", "undesirable effects of {name}", "{name} toxicity"], "dosage": ["dosage of {name}", "{name} dose and schedule", "how to take {name}"],
    "interactions": ["interactions of {name}", "{name} combined with other medicines"], "general": ["indications of {name}", "what {name} is used for", "{name} description"], "mechanism": ["mode of action of {name}", "{name} pharmacology"],
}.items() for i, t in enumerate(ts)])


@query("r24_all_variants", f"""WITH {MORE.cte}, {_pairs('w', _split(V.KINDS))}, {TEMPLATES.cte}, k AS (SELECT query_id, text, (SELECT arg_min(kind, ord) FROM w WHERE contains(lower(text), phrase)) AS kind, {_named('text')} AS name FROM more_questions),
    u AS (SELECT query_id, -1 AS ord, text AS v FROM k UNION ALL SELECT query_id, ord, replace(template, '{{name}}', name) FROM k JOIN wordings USING (kind) WHERE name IS NOT NULL), f AS (SELECT query_id, v, min(ord) AS ord FROM u GROUP BY query_id, v) SELECT query_id, place, v AS variant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, v) AS place FROM f) WHERE place <= 5""")
def r24a(spark: SparkSession, d: str) -> DataFrame:
    """Up to five wordings of each question, by its kind and name."""
    q = MORE.df(spark)
    known = q.join(intent.first_kind(spark, q), "query_id").withColumn("name", intent.named(F.col("text")))
    return intent.variants(known, TEMPLATES.df(spark))


# --- structure ---


@query("s4_image_names", "SELECT id, i - 1 AS n, p AS source, regexp_replace(original_filename, '\\.[^.]*$', '') || '_' || substring(document_hash, 1, 8) || '_img' || lpad((i - 1)::VARCHAR, 3, '0') || '.png' AS name FROM (SELECT id, original_filename, document_hash, unnest(image_paths) AS p, generate_subscripts(image_paths, 1) AS i FROM monograph_sections)")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """The names under which a document's pictures are kept."""
    return structure.image_names(table(spark, d, "monograph_sections"), "id")


@query("s5_layout_blocks", """WITH p AS (SELECT id, string_split(content_text, '. ') AS parts, page_start FROM monograph_sections WHERE content_text IS NOT NULL), e AS (SELECT id, page_start, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS block_id FROM p)
    SELECT id, block_id, text, CASE WHEN page_start IS NULL THEN 12.0 ELSE 10.0 + page_start % 5 END::DOUBLE AS font_size, CASE WHEN page_start IS NULL THEN 700 ELSE 400 END AS font_weight FROM e""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Blocks from cells with a size, or from elements with a weight; what is missing is filled."""
    block = lambda size, weight: F.transform(F.split("content_text", r"\. "), lambda t: F.struct(t.alias("text"), size.cast("double").alias("font_size"), weight.cast("int").alias("font_weight")))
    pages = table(spark, d, "monograph_sections").where("content_text is not null").select("id", F.when(F.col("page_start").isNotNull(), block(10.0 + F.col("page_start") % 5, F.lit(None))).alias("cells"), block(F.lit(None), F.lit(700)).alias("elements"))
    return structure.layout_blocks(pages, "id")


BLOCKS = r"""l AS (SELECT id, unnest(string_split(content_markdown, chr(10))) AS t, generate_subscripts(string_split(content_markdown, chr(10)), 1) AS n FROM monograph_sections WHERE content_markdown IS NOT NULL),
    b AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS block_id, length(regexp_extract(t, '^(#{1,6})\s+(.+)$', 1)) AS level, CASE WHEN regexp_matches(t, '^(#{1,6})\s+(.+)$') THEN trim(regexp_extract(t, '^(#{1,6})\s+(.+)$', 2)) ELSE trim(t) END AS text FROM l WHERE trim(t) <> '')"""


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return structure.markdown_blocks(table(spark, d, "monograph_sections").where("content_markdown is not null"), "id", "content_markdown")


@query("e2_heading_candidates", r"WITH " + BLOCKS + rf""", w AS (SELECT id, quantile_disc(k, (floor(n / 2) + 1) / n) AS m FROM (SELECT id, CASE WHEN level > 0 THEN 700 ELSE 400 END AS k, count(*) OVER (PARTITION BY id) AS n FROM b) GROUP BY id, n),
    v AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY block_id) AS p, lead(text) OVER (PARTITION BY id ORDER BY block_id) AS q, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN level > 0 THEN 700 ELSE 400 END) AS r, count(*) OVER (PARTITION BY id) AS n FROM b),
    u AS (SELECT id, max(CASE WHEN r = n // 2 + 1 THEN CASE WHEN level > 0 THEN 700 ELSE 400 END END) AS m FROM v GROUP BY id),
    s AS (SELECT v.id, block_id, text, 2 + (length(text) < 80)::INT + (NOT regexp_matches(text, '[.!?;:]$'))::INT + (p IS NULL OR q IS NULL OR trim(coalesce(p, '')) = '' OR trim(coalesce(q, '')) = '')::INT + (CASE WHEN level > 0 THEN 700 ELSE 400 END >= u.m)::INT AS signals FROM v JOIN u ON u.id = v.id
      WHERE (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AND length(text) > 2) OR (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(text, '\p{{L}}\p{{Lu}}')))
    SELECT id, block_id, text, {squeeze("regexp_replace(replace(lower(text), '&', 'and'), '[^a-z ]', '', 'g')")} AS words, signals, round(least(0.9, signals / 6 + 0.3), 6) AS confidence FROM s WHERE signals >= 3""")
def e2(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of markdown that may be headings."""
    return structure.heading_candidates(_markdown(spark, d), "id")


SYN = Literal("syn", "category string, synonym string, ord int", [(c, s, i) for i, (c, s) in enumerate((c, s) for c, ss in V.SYNONYMS.items() for s in ss)])
WORDS = squeeze("regexp_replace(replace(lower(text), '&', 'and'), '[^a-z ]', '', 'g')")


@query("e4_boundaries", f"""WITH {SYN.cte}, {BLOCKS}, h AS (SELECT id, block_id AS start_block, text AS heading, {WORDS} AS header, lead(block_id) OVER (PARTITION BY id ORDER BY block_id) AS nxt FROM b WHERE level > 0),
    m AS (SELECT DISTINCT header FROM h), c AS (SELECT m.header, category, CASE WHEN m.header = synonym THEN 1.0 ELSE 0.8 END AS confidence, row_number() OVER (PARTITION BY m.header ORDER BY length(synonym) DESC, ord) AS r FROM m JOIN syn ON length(m.header) > 0 AND (contains(m.header, synonym) OR contains(synonym, m.header))),
    e AS (SELECT id, max(block_id) + 1 AS n FROM b GROUP BY id) SELECT h.id, start_block, coalesce(nxt, n) AS end_block, heading, coalesce(category, 'other') AS category, coalesce(confidence, 0.3)::DOUBLE AS confidence FROM h JOIN e USING (id) LEFT JOIN c ON c.header = h.header AND c.r = 1""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    """Headings with the blocks they stand over and their category."""
    blocks = _markdown(spark, d)
    return structure.boundaries(blocks, blocks.where("level > 0"), SYN.df(spark), "id")


CAPTIONS = r"SELECT {k}, i - 1 AS paragraph, trim(regexp_replace(regexp_extract(p, '(?is)(?:^|\n)((?:figure|fig\.|table|chart|diagram)\s+\d+[.:].+|(?:note|footnote|warning|caution):.+)', 1), '\s+', ' ', 'g')) AS text FROM (SELECT {k}, unnest(regexp_split_to_array({t}, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array({t}, '\n\s*\n'), 1) AS i FROM {f})"


@query("e9_captions", f"SELECT * FROM ({CAPTIONS.format(k='fact_span_id', t='sentence_text', f='fact_spans')}) WHERE length(text) > 10")
def e9(spark: SparkSession, d: str) -> DataFrame:
    """Captions and notes, up to the end of their paragraph."""
    return structure.captions(table(spark, d, "fact_spans"), "fact_span_id", "sentence_text")


SPANS = (
    r"l AS (SELECT id, unnest(string_split(content_text, chr(10))) AS t, generate_subscripts(string_split(content_text, chr(10)), 1) AS n FROM {f}),"
    r" k AS (SELECT id, n, trim(t) AS t FROM l WHERE contains(t, '|') AND NOT regexp_matches(trim(t), '^\|[\s:-]+\|$') AND length(trim(t)) > 5),"
    r" s AS (SELECT id, 'sentence' AS text_type, i - 1 AS sequence_num, trim(s) AS text FROM (SELECT id, unnest(regexp_extract_all(content_text, '([^.!?]+[.!?]+)', 1)) AS s, generate_subscripts(regexp_extract_all(content_text, '([^.!?]+[.!?]+)', 1), 1) AS i FROM {f}) WHERE length(trim(s)) > 10"
    r" UNION ALL SELECT id, 'bullet', row_number() OVER (PARTITION BY id ORDER BY n) - 1, trim(regexp_extract(t, '^\s*([•*◦–-]|\d+\.|[a-z]\))\s+(.+)$', 2)) FROM l WHERE length(trim(regexp_extract(t, '^\s*([•*◦–-]|\d+\.|[a-z]\))\s+(.+)$', 2))) > 5"
    r" UNION ALL SELECT id, 'table_row', row_number() OVER (PARTITION BY id ORDER BY n) - 1, t FROM k"
    r" UNION ALL SELECT id, 'caption', paragraph, text FROM ({c}) WHERE length(text) > 10) SELECT id, text_type, sequence_num, text FROM s"
)


@query("e10_all_spans", "WITH " + SPANS.replace("{f}", "monograph_sections").replace("{c}", CAPTIONS.format(k="id", t="content_text", f="monograph_sections")))
def e10(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, bullets, table rows and captions of all sections."""
    return structure.spans(table(spark, d, "monograph_sections"), "id", "content_text")


@query("e14_backfill", "WITH f AS (SELECT * FROM monograph_sections WHERE id NOT IN (SELECT section_id FROM fact_spans WHERE section_id IS NOT NULL)), " + SPANS.replace("{f}", "f").replace("{c}", CAPTIONS.format(k="id", t="content_text", f="f")))
def e14(spark: SparkSession, d: str) -> DataFrame:
    """The spans of sections that have none yet."""
    return structure.backfill(table(spark, d, "monograph_sections"), table(spark, d, "fact_spans").select(F.col("section_id").alias("id")), "id", "content_text")


@query("e11_recursive_chunks")
def e11r(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of up to 1200 characters, 2000 in some sections; packing goes on from piece to piece, which SQL can't say."""
    large = F.coalesce(F.lower("section_name").isin("dose and schedule", "kinetics in the body", "presentation and strengths"), F.lit(False))
    return structure.recursive_chunks(table(spark, d, "monograph_sections").withColumn("large", large), "id", "content_text", "large")


HEADS = "h AS (SELECT upper(entry_name) AS header, ref_id AS ord FROM canonical_entries WHERE kind = 'section')"
LINES = r"x AS (SELECT chunk_id, unnest(string_split(chunk_text, chr(10))) AS t, generate_subscripts(string_split(chunk_text, chr(10)), 1) - 1 AS line_no FROM (SELECT document_hash AS chunk_id, markdown_content AS chunk_text FROM parsed_documents)), y AS (SELECT chunk_id, line_no, trim(regexp_replace(upper(trim(t)), ':$', '')) AS u FROM x WHERE trim(t) <> ''), z AS (SELECT DISTINCT u FROM y WHERE u <> ''), m AS (SELECT u, arg_min(header, (CASE WHEN u = header THEN 0 ELSE 1000000 END) + ord) AS header FROM z JOIN h ON contains(u, header) OR contains(header, u) GROUP BY u), g AS (SELECT chunk_id, line_no, header FROM y JOIN m USING (u))"


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entries").where("kind = 'section'").select(F.col("entry_name").alias("header"), F.col("ref_id").alias("ord"))


@query("e12_line_headers", f"WITH {HEADS}, {LINES} SELECT chunk_id AS document_hash, line_no, header FROM g")
def e12(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are, hold or lie in a known header."""
    return structure.line_headers(table(spark, d, "parsed_documents"), "document_hash", "markdown_content", _heads(spark, d))


@query("e13_page_sections", f"WITH {HEADS}, {LINES}, a AS (SELECT chunk_id, arg_max(header, line_no) AS header FROM g GROUP BY chunk_id), p AS (SELECT chunk_id, CASE " + " ".join(f"WHEN len(list_filter({_list(ws)}, lambda w: contains(lower(chunk_text), w))) > 0 THEN '{k}'" for k, ws in V.PARTS.items()) + " END AS part FROM (SELECT document_hash AS chunk_id, markdown_content AS chunk_text FROM parsed_documents)) SELECT chunk_id AS document_hash, concat_ws(' > ', header, part) AS section FROM p LEFT JOIN a USING (chunk_id) WHERE header IS NOT NULL OR part IS NOT NULL")
def e13(spark: SparkSession, d: str) -> DataFrame:
    """The section, and the part of it, at the end of each document."""
    return structure.page_sections(table(spark, d, "parsed_documents"), "document_hash", "markdown_content", _heads(spark, d), V.PARTS)


@query("e15_structure_images", f"WITH i AS (SELECT document_hash, list_sort(list(DISTINCT p)) AS images FROM (SELECT document_hash, unnest(image_paths) AS p FROM monograph_sections WHERE has_chemical_structure) GROUP BY document_hash) SELECT id, CASE WHEN len(list_filter({_list(V.STRUCTURE_WORDS)}, lambda w: contains(lower(original_header), w))) > 0 THEN coalesce(images, []) ELSE [] END AS images FROM monograph_sections LEFT JOIN i USING (document_hash)")
def e15(spark: SparkSession, d: str) -> DataFrame:
    """Sections about the structure with all pictures of their document."""
    s = table(spark, d, "monograph_sections")
    images = s.where("has_chemical_structure").select("document_hash", F.explode("image_paths").alias("p")).groupBy("document_hash").agg(F.sort_array(F.collect_set("p")).alias("images"))
    return structure.attach_images(s.select("id", "document_hash", "original_header"), images, "document_hash", "original_header", V.STRUCTURE_WORDS).select("id", "images")


# --- answers ---


ANSWERS = Literal("said", "answer_id bigint, answer string, context string", [(1, "In my opinion it is safe.", "It is safe."), (2, "As far as I know, yes.", "As far as I know is a phrase."), (3, "The answer is not in the text", ""), (4, "Take two.", None), (5, "I believe it was NOT FOUND in the available monographs.", "x")])


@query("g6_invented", f"WITH {ANSWERS.cte} SELECT answer_id, len(list_filter({_list(V.INVENTED)}, lambda w: contains(lower(answer), w) AND NOT contains(lower(coalesce(context, '')), w))) > 0 AS invented FROM said")
def g6(spark: SparkSession, d: str) -> DataFrame:
    """Answers with wording of an opinion that their context hasn't."""
    return ANSWERS.df(spark).select("answer_id", retrieve.says_more(F.col("answer"), F.col("context"), V.INVENTED).alias("invented"))


@query("g7_not_found", f"WITH {ANSWERS.cte} SELECT answer_id, len(list_filter({_list(V.NOT_FOUND)}, lambda w: contains(lower(answer), w))) > 0 AS not_found FROM said")
def g7(spark: SparkSession, d: str) -> DataFrame:
    """Answers that say they found nothing."""
    return ANSWERS.df(spark).select("answer_id", retrieve.says_any(F.col("answer"), V.NOT_FOUND).alias("not_found"))


FOUND = Literal("found", "query_id bigint, name string, section string, chunks int", [(1, "axid", None, 0), (2, "axid", "dosage", 4), (3, None, "dosage", 3), (4, "axid", None, 2)])


@query("g3_reasons", f"WITH {FOUND.cte} SELECT query_id, CASE WHEN name IS NOT NULL AND chunks = 0 THEN 'drug_not_found' WHEN name IS NOT NULL AND section IS NOT NULL THEN 'section_not_found' ELSE 'default' END AS reason FROM found")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """Why there is no evidence."""
    return FOUND.df(spark).select("query_id", retrieve.reason(F.col("name"), F.col("section"), F.col("chunks")).alias("reason"))


@query("g10_report", "WITH m AS (SELECT id, 'confidence' AS metric, confidence::DOUBLE AS score FROM section_mappings UNION ALL SELECT id, 'usage', usage_count::DOUBLE FROM section_mappings), t AS (SELECT * FROM (VALUES ('confidence', 0.5), ('usage', 10.0)) v(metric, target)), b AS (SELECT metric, list(id ORDER BY score, id)[1:3] AS worst FROM m WHERE score IS NOT NULL GROUP BY metric) SELECT metric, round(avg(score), 6) AS mean, any_value(target)::DOUBLE AS target, avg(score) >= any_value(target) AS passed, any_value(worst) AS worst FROM m JOIN t USING (metric) JOIN b USING (metric) GROUP BY metric")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Each metric's mean against its target, with the three worst rows."""
    rows = table(spark, d, "section_mappings").select("id", F.col("confidence").cast("double").alias("confidence"), F.col("usage_count").cast("double").alias("usage")).unpivot("id", ["confidence", "usage"], "metric", "score")
    return retrieve.report(rows, spark.createDataFrame([("confidence", 0.5), ("usage", 10.0)], "metric string, target double"), "id")


@query("s11_point_lookup", "SELECT chunk_id, file_path, page_num, section_name FROM chunks WHERE chunk_id = (SELECT max(chunk_id) FROM chunks)")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """One row by its id."""
    chunks = table(spark, d, "chunks")
    last = chunks.agg(F.max("chunk_id").alias("chunk_id")).first()[0]
    return chunks.where(F.col("chunk_id") == last).select("chunk_id", "file_path", "page_num", "section_name")


@query("s15_tables", "SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ('files', 'chunks', 'monograph_sections', 'fact_spans', 'section_mappings', 'drug_names')")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """The tables there are of those a retriever asks for."""
    names = ["files", "chunks", "monograph_sections", "fact_spans", "section_mappings", "drug_names"]
    there = spark._jvm.org.apache.hadoop.fs.Path(d)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    known = {x.getPath().getName() for x in fs.listStatus(there)}
    return spark.createDataFrame([(n,) for n in names if f"{n}.parquet" in known], "name string")


@query("s19_alive", "SELECT 1 AS alive")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Whether the session answers."""
    return spark.range(1).agg(F.count("*").cast("int").alias("alive"))


@query("d12_added_mappings", "SELECT DISTINCT lower(trim(brand_name)) AS brand, lower(trim(generic_name)) AS generic FROM (SELECT brand_name, generic_name FROM drug_names WHERE brand_name IS NOT NULL AND generic_name IS NOT NULL UNION ALL SELECT * FROM (VALUES ('Axid', 'nizatidine'), (' AXID', 'Nizatidine ')))")
def d12(spark: SparkSession, d: str) -> DataFrame:
    """Names with one more added twice."""
    return upkeep.add_mappings(table(spark, d, "drug_names").select(F.col("brand_name").alias("brand"), F.col("generic_name").alias("generic")), spark.createDataFrame([("Axid", "nizatidine"), (" AXID", "Nizatidine ")], "brand string, generic string"))


@query("a9_verbatim_groups", "SELECT drug_name, upper(coalesce(section_enum, 'unknown')) AS section, min(fact_span_id) AS first_span, count(*) AS n, string_agg(DISTINCT sentence_text, chr(10) ORDER BY sentence_text) AS lines FROM fact_spans WHERE array_length(attribute_tags) >= 2 AND sentence_text IS NOT NULL AND drug_name IS NOT NULL AND table_id IS NOT NULL GROUP BY 1, 2")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Spans of tables with two tags and more, word for word under their section; a table has few of them."""
    s = table(spark, d, "fact_spans").where("size(attribute_tags) >= 2 and sentence_text is not null and drug_name is not null and table_id is not null")
    return s.groupBy("drug_name", F.upper(F.coalesce("section_enum", F.lit("unknown"))).alias("section")).agg(F.min("fact_span_id").alias("first_span"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("sentence_text")), "\n").alias("lines"))


@query("a13_validation", "SELECT round(count_if(confidence >= 0.5) / count(*), 6) AS passed, count(DISTINCT suggested_by) AS sources, round(avg(confidence), 6) AS confidence, round(avg(usage_count), 6) AS usage FROM section_mappings")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Share of what passes, sources and means, in one row."""
    return table(spark, d, "section_mappings").agg(F.round(F.count_if(F.col("confidence") >= 0.5) / F.count("*"), 6).alias("passed"), F.count_distinct("suggested_by").alias("sources"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("usage_count"), 6).alias("usage"))


@query("a15_failures", "SELECT coalesce(error_message, 'none') AS error, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(error_message, 'none')) AS place FROM parsed_documents WHERE NOT parse_success GROUP BY 1")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Failures by their error, the most frequent first."""
    counts = table(spark, d, "parsed_documents").where("not parse_success").groupBy(F.coalesce("error_message", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "error")))  # one row for each kind of error


@query("a18_cache_stats", "SELECT count(*) AS size, count_if(p) AS positives, count_if(NOT p) AS negatives FROM (SELECT document_hash, coalesce(bool_or(has_chemical_structure), false) AS p FROM monograph_sections WHERE document_hash IS NOT NULL GROUP BY document_hash)")
def a18(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of classes by document holds."""
    cache = table(spark, d, "monograph_sections").where("document_hash is not null").groupBy("document_hash").agg(F.coalesce(F.bool_or("has_chemical_structure"), F.lit(False)).alias("p"))
    return cache.agg(F.count("*").alias("size"), F.count_if("p").alias("positives"), F.count_if(~F.col("p")).alias("negatives"))


@query("t7_priority_sort", "WITH p AS (SELECT unnest(" + _list(V.PRIORITY) + ") AS s, generate_subscripts(" + _list(V.PRIORITY) + ", 1) AS o) SELECT id, row_number() OVER (PARTITION BY document_hash ORDER BY coalesce(o, 99), page_start NULLS LAST, id) AS place FROM monograph_sections LEFT JOIN p ON lower(trim(section_name)) = s")
def t7(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each document in the order of a list, then of pages."""
    order = F.coalesce(*(F.when(F.lower(F.trim("section_name")) == s, F.lit(i + 1)) for i, s in enumerate(V.PRIORITY)), F.lit(99))
    w = Window.partitionBy("document_hash").orderBy(order, F.asc_nulls_last("page_start"), "id")
    return table(spark, d, "monograph_sections").select("id", "document_hash", "section_name", "page_start").withColumn("place", F.row_number().over(w)).select("id", "place")


@query("t8_missing_last", "SELECT id, row_number() OVER (PARTITION BY normalized_name ORDER BY coalesce(1 - confidence, 'inf'::DOUBLE), id) AS place FROM section_mappings WHERE normalized_name IS NOT NULL")
def t8(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each name by distance; one without a distance is infinitely far."""
    w = Window.partitionBy("normalized_name").orderBy(F.coalesce(1 - F.col("confidence"), F.lit(float("inf"))), "id")
    return table(spark, d, "section_mappings").where("normalized_name is not null").select("id", "normalized_name", "confidence").withColumn("place", F.row_number().over(w)).select("id", "place")


@query("t9_page_order", "SELECT chunk_id, row_number() OVER (PARTITION BY lower(trim(split_part(section_name, ' > ', 1))), file_path ORDER BY page_num NULLS LAST, chunk_id) AS place FROM chunks WHERE section_name IS NOT NULL")
def t9(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each section of a file by page and number."""
    w = Window.partitionBy(F.lower(F.trim(F.split_part("section_name", F.lit(" > "), F.lit(1)))), "file_path").orderBy(F.asc_nulls_last("page_num"), "chunk_id")
    return table(spark, d, "chunks").where("section_name is not null").select("chunk_id", "file_path", "page_num", "section_name").withColumn("place", F.row_number().over(w)).select("chunk_id", "place")


@query("pred13_renamed", "SELECT id AS chunk_id, content_text AS chunk_text, section_name, page_start AS page_num, drug_name AS drug_generic, 'sections/' || coalesce(drug_name, 'unknown') || '/' || coalesce(section_name, 'unknown') AS file_path FROM monograph_sections")
def pred13(spark: SparkSession, d: str) -> DataFrame:
    """Sections under the names that a generator of answers reads."""
    return retrieve.for_generator(table(spark, d, "monograph_sections"))


@query("pred15_like_or_equal", "SELECT id FROM monograph_sections WHERE lower(drug_name) LIKE '%velmo%' AND (lower(section_name) = 'contraindications' OR lower(original_header) LIKE '%warning%')")
def pred15(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a name, by their name or a part of their header."""
    return table(spark, d, "monograph_sections").where(F.ilike("drug_name", F.lit("%velmo%")) & ((F.lower("section_name") == "contraindications") | F.ilike("original_header", F.lit("%warning%")))).select("id")


@query("pred16_prefix", "SELECT chunk_id, substring(chunk_text, 1, 100) AS prefix, length(chunk_text) AS size FROM chunks WHERE chunk_text IS NOT NULL ORDER BY chunk_id")
def pred16(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred characters of each chunk and its size, by id."""
    return table(spark, d, "chunks").where("chunk_text is not null").select("chunk_id", F.substring("chunk_text", 1, 100).alias("prefix"), F.length("chunk_text").alias("size")).orderBy("chunk_id")


@query("j11_by_row_index", "WITH a AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, text FROM (" + f"WITH {QUESTIONS.cte} SELECT * FROM questions" + ")), b AS (SELECT unnest([0.9, 0.4, 0.7]) AS score, generate_subscripts([0.9, 0.4, 0.7], 1) - 1 AS i) SELECT text, score::DOUBLE AS score FROM a JOIN b USING (i)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the question at their position; positions are columns, as rows have no order."""
    asked = QUESTIONS.df(spark).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("query_id")) - 1)
    scores = spark.createDataFrame(list(enumerate([0.9, 0.4, 0.7])), "i int, score double")
    return asked.join(scores, "i").select("text", "score")


@query("k5_pages", "SELECT document_hash, i AS page_num, p AS text FROM (SELECT document_hash, unnest(string_split(raw_text, chr(12))) AS p, generate_subscripts(string_split(raw_text, chr(12)), 1) AS i FROM parsed_documents WHERE parse_success) WHERE trim(p) <> ''")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """The pages of documents that aren't blank, as rows."""
    each = table(spark, d, "parsed_documents").where("parse_success and raw_text is not null").select("document_hash", F.posexplode(F.split("raw_text", "\f")).alias("n", "text"))
    return each.where(F.trim("text") != "").select("document_hash", (F.col("n") + 1).alias("page_num"), "text")
