"""Answering batches of questions: candidate paths, the first path that finds anything, context, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import lexical
from textlake.operators.lookup import by_any_name, first_per
from textlake.sources.tables import cut, small


def exact(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Path for a name and a section: (query_id, id, rank, ...) by page, without junk.

    questions: (query_id, name, section); a null section takes all sections of the name.
    """
    found = by_any_name(questions, sections).where(F.col("section").isNull() | (F.lower(F.trim("section_name")) == F.lower(F.trim("section")))).where(~F.coalesce(T.is_junk("content_text"), F.lit(False)))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("page_start").asc_nulls_last(), "id")))


def fuzzy(questions: DataFrame, sections: DataFrame, least: float = 0.2, n: int = 10) -> DataFrame:
    """Path for a name and something like a section: the `n` sections with the most similar heading."""
    found = by_any_name(questions.where("section is not null"), sections).withColumn("similarity", F.round(T.trigram_similarity("section_name", "section"), 6)).where(F.col("similarity") > least)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= n)


def spans_with(questions: DataFrame, spans: DataFrame, allowed: list[str]) -> DataFrame:
    """Path for an attribute: spans (fact_span_id, drug_name, sentence_text, assertion_type) of the name that state facts
    and hold any of the question's words (query_id, name, words)."""
    sides = spans.where(F.col("assertion_type").isin(allowed)).withColumn("_name", F.lower("drug_name")).join(small(questions.withColumn("_name", F.lower("name"))), "_name")
    return sides.where(F.exists("words", lambda w: F.contains(F.lower("sentence_text"), F.lower(w)))).select("query_id", "fact_span_id", "sentence_text", "section_enum", "section_id", "sentence_index")


def images(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Path for a picture: (query_id, id, rank, image_paths) of the name's sections with a structure; those named for it first."""
    low = F.lower("section_name")
    place = F.when(F.contains(low, F.lit("structure")), 1).when(F.contains(low, F.lit("chemical")), 2).when(F.contains(low, F.lit("description")), 3).otherwise(4)
    found = by_any_name(questions.where("needs_image"), sections.where("has_chemical_structure"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, F.asc_nulls_last("page_start"), "id")))


def stated(questions: DataFrame, spans: DataFrame, allowed: str = "sections") -> DataFrame:
    """Path for an attribute, all that is stated: (query_id, id, rank, line) of the spans of the name, in sections whose name
    holds one of the question's, that are facts or conditions; no model may leave any of them out."""
    few = spans.where(F.col("assertion_type").isin("FACT", "CONDITIONAL")).select("fact_span_id", "drug_name", "section_enum", "sentence_text", "sentence_index")
    met = few.withColumn("_name", F.lower("drug_name")).join(small(questions.where("attribute is not null").select("query_id", F.lower("name").alias("_name"), allowed)), "_name")
    kept = met.where(F.exists(allowed, lambda s: F.contains(F.lower("section_enum"), F.lower(s))))
    return kept.select("query_id", F.col("fact_span_id").alias("id"), F.row_number().over(Window.partitionBy("query_id").orderBy("fact_span_id")).alias("rank"), F.concat(F.lit("- "), F.trim("sentence_text")).alias("line"))


def filtered(questions: DataFrame, spans: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Path for an attribute, sentences only: (query_id, id, rank, section) of the name's sentences in the allowed sections
    (words, sections) with any of the attribute's words, that `chosen`, a model's verdict, keeps; without one all.

    rank goes by section, in the order of their first span.
    """
    few = spans.where(F.lower(F.trim("source_type")).isin("sentence", "sent.") & (F.lit(True) if chosen is None else chosen)).select("fact_span_id", "drug_name", "section_enum", "sentence_text")
    met = few.withColumn("_name", F.lower("drug_name")).join(small(questions.where("attribute is not null").select("query_id", F.lower("name").alias("_name"), "words", "sections")), "_name")
    kept = met.where(F.exists("sections", lambda s: F.contains(F.lower("section_enum"), F.lower(s))) & F.exists("words", lambda w: F.contains(F.lower("sentence_text"), F.lower(w))))
    first = kept.groupBy("query_id", "section_enum").agg(F.min("fact_span_id").alias("_first"))
    placed = kept.join(first, ["query_id", "section_enum"])
    return placed.select("query_id", F.col("fact_span_id").alias("id"), F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "fact_span_id")).alias("rank"), F.upper("section_enum").alias("section"))


def allowed_sections(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Path for an attribute, whole sections: (query_id, id, rank) of the name's sections whose name holds one of the allowed."""
    found = by_any_name(questions.where("attribute is not null"), sections.select("id", "drug_name", "brand_name", "generic_name", "section_name", "page_start"))
    kept = found.where(F.exists("sections", lambda s: F.contains(F.lower("section_name"), F.lower(s))))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("page_start"), "id")))


def whole_name(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Path for a name alone: (query_id, id, rank) of all its sections, by section and page."""
    found = by_any_name(questions.where("section is null and attribute is null"), sections.select("id", "drug_name", "brand_name", "generic_name", "section_name", "page_start"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("section_name"), F.asc_nulls_last("page_start"), "id")))


def planned(questions: DataFrame, sections: DataFrame, core: list[str]) -> DataFrame:
    """Path for a plan's sections: (query_id, id, rank) where a candidate holds a core word: each candidate is looked up by
    name, else by likeness, and their hits follow each other, each id once, under the first that found it."""
    wanted = questions.where(F.exists("candidates", lambda c: F.exists(F.array(*map(F.lit, core)), lambda w: F.contains(F.lower(c), w))))
    each = wanted.select(F.col("query_id").alias("_q"), F.col("plan_name").alias("name"), F.posexplode("candidates").alias("_n", "section")).withColumn("query_id", F.struct("_q", "_n"))
    asked = each.select("query_id", "name", "section")
    found = first_path(asked, [("EXACT", exact(asked, sections)), ("FUZZY", fuzzy(asked, sections))]).where("id is not null")
    once = found.groupBy(F.col("query_id._q").alias("query_id"), "id").agg(F.min(F.struct("query_id._n", "rank")).alias("_at"))
    return once.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "id")).alias("rank"))


def best_worded(hits: DataFrame, spans: DataFrame, questions: DataFrame, n: int = 15) -> DataFrame:
    """(query_id, id, rank): of the hits (query_id, fact_span_id, rank) of a search by words, without junk, the `n` whose text is
    most like the question's by trigrams, of equals the better hit."""
    text = hits.join(spans.select("fact_span_id", "sentence_text"), "fact_span_id").join(small(questions.select("query_id", "text")), "query_id")
    scored = text.where(~F.coalesce(T.is_junk("sentence_text"), F.lit(False))).withColumn("similarity", F.round(T.trigram_similarity("sentence_text", "text"), 6))
    return first_per(scored.drop("text").withColumnRenamed("rank", "_hit"), ["query_id"], [F.desc("similarity"), "_hit"], n, "rank").select("query_id", F.col("fact_span_id").alias("id"), "rank")


def holding(questions: DataFrame, spans: DataFrame, n: int = 50) -> DataFrame:
    """Path for wording as it stands: (query_id, id, rank) of the first `n` spans that hold one of the phrases, without junk."""
    asked = questions.select("query_id", F.explode(F.slice("phrases", 1, 5)).alias("_p"))
    kept = spans.where(~F.coalesce(T.is_junk("sentence_text"), F.lit(False))).select("fact_span_id", "section_id", "sentence_index", "sentence_text")
    met = kept.join(small(asked, 10_000), F.expr("contains(lower(sentence_text), lower(_p))")).select("query_id", "fact_span_id", "section_id", "sentence_index").distinct()
    return first_per(met, ["query_id"], [F.asc_nulls_last("section_id"), F.asc_nulls_last("sentence_index"), "fact_span_id"], n, "rank").select("query_id", F.col("fact_span_id").alias("id"), "rank")


def cascade(questions: DataFrame, sections: DataFrame, spans: DataFrame, core: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, path, id, rank): for each question the first path that finds anything.

    questions: (query_id, text, name, section, attribute, words, sections, needs_image, candidates, plan_name, phrases), as
    classified and planned. In order: pictures; the section by its name; by likeness; an attribute's statements, its
    sentences, its sections; all of a name; a plan's sections; words; wording as it stands; `vectors` (query_id, id,
    rank), neighbours within the name's scope. ids of ATTRIBUTE, SENTENCES, LEXICAL and SUBSTRING are those of spans.
    """
    named = questions.where("name is not null")
    own = spans.where("sentence_text is not null").withColumn("name", F.lower("drug_name"))
    searched = named.where("text is not null").select("query_id", F.lower("name").alias("name"), "text")
    words = lexical.rank(lexical.index(own, "fact_span_id", "sentence_text", ("name",)), searched, own.withColumn("_text", F.col("sentence_text")), "fact_span_id", 60, "name")
    paths = [
        ("IMAGE", images(named, sections)),
        ("SQL_EXACT", exact(named.where("section is not null"), sections)),
        ("SQL_FUZZY", fuzzy(named, sections)),
        ("ATTRIBUTE", stated(named, spans)),
        ("SENTENCES", filtered(named, spans)),
        ("ATTRIBUTE_SECTIONS", allowed_sections(named, sections)),
        ("NAME", whole_name(named.where("not needs_image"), sections)),
        ("SECTION_LOOKUP", planned(questions, sections, core)),
        ("LEXICAL", best_worded(words, spans, searched)),
        ("SUBSTRING", holding(questions, spans)),
        *([("VECTOR", vectors)] if vectors is not None else []),
    ]
    return first_path(questions, paths)


def merged(results: DataFrame) -> DataFrame:
    """Results (query_id, part, id, rank) of a question's parts as one list: each id once, where it stands first."""
    first = results.groupBy("query_id", "id").agg(F.min(F.struct("part", "rank")).alias("_at"))
    return first.select("query_id", "id", F.col("_at.part").alias("part"), F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "id")).alias("rank"))


def numbered(hits: DataFrame, n: int) -> DataFrame:
    """(query_id, context): the first `n` hits (query_id, rank, name, page, section, text) as numbered sources."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), unknown("name"), F.lit(", Page "), unknown("page"), F.lit(", Section: "), unknown("section"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    few = hits.where(F.col("rank") <= n)
    return few.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n---\n\n").alias("context"))


def composed(hits: DataFrame, wanted: DataFrame, least: int, most: int, cover: str, priority: list[str]) -> DataFrame:
    """(query_id, id, place) of hits (query_id, rank, distance, id, section, name) of a vector search, as a context:

    those of the wanted section and then of the wanted name (query_id, section, name), unless none is; as near as 1.2 times
    the nearest, `least` at least; with one of section `cover` if the hits have any; in the order of `priority`.
    """
    asked = hits.join(small(wanted.withColumnsRenamed({"section": "_ws", "name": "_wn"})), "query_id", "left")
    kept = or_all(asked, "query_id", F.col("_ws").isNull() | (F.lower("section") == F.lower("_ws")))
    kept = or_all(kept, "query_id", F.col("_wn").isNull() | (F.lower("name") == F.lower("_wn")))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    near = close_enough(kept, least, most)
    has = near.groupBy("query_id").agg(F.bool_or(F.lower("section") == cover).alias("_has"))
    best = kept.where(F.lower("section") == cover).groupBy("query_id").agg(F.min_by("id", "rank").alias("_best"))
    chosen = kept.join(has, "query_id").join(best, "query_id", "left").join(near.select("query_id", "id", F.lit(True).alias("_in")), ["query_id", "id"], "left")
    # The one that is put in takes the last one's place.
    forced = ~F.coalesce("_has", F.lit(False)) & (F.col("id") == F.col("_best"))
    placed = chosen.where(F.coalesce("_in", F.lit(False)) | forced).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(forced, 0).otherwise(F.col("rank"))))).where(F.col("_n") <= most)
    order = F.coalesce(*(F.when(F.lower("section") == s, F.lit(i)) for i, s in enumerate(priority)), F.lit(99))
    return placed.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "rank")).alias("place"))


def first_path(questions: DataFrame, paths: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, path, id, rank) of the first path, in order, that found anything for the question; NONE without ids.

    All paths are computed as sets, once: their ids are written to the shared folder, and an aggregate over them tells the
    lowest path of each question.
    """
    every = None
    for i, (name, df) in enumerate(paths):
        one = df.select("query_id", F.lit(i).alias("_path"), F.lit(name).alias("path"), F.col("id").cast("bigint").alias("id"), F.col("rank").cast("int").alias("rank"))
        every = one if every is None else every.unionByName(one)
    every = cut(every)
    least = every.groupBy("query_id").agg(F.min("_path").alias("_path"))
    best = every.join(least, ["query_id", "_path"], "left_semi")
    return questions.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("path", F.lit("NONE")).alias("path"), "id", "rank")


def or_all(rows: DataFrame, group: str, match) -> DataFrame:  # noqa: ANN001
    """The rows that match, or all rows of a group in which none does. Which groups have a match is an aggregate, so that
    no group is gathered."""
    flagged = rows.withColumn("_m", F.coalesce(match, F.lit(False)))
    some = flagged.groupBy(F.col(group).alias("_g")).agg(F.bool_or("_m").alias("_any"))
    return flagged.join(some, F.col(group).eqNullSafe(F.col("_g"))).where("_m or not _any").drop("_m", "_any", "_g")


def close_enough(hits: DataFrame, least: int, most: int, factor: float = 1.2) -> DataFrame:
    """Hits (query_id, rank, distance): the first `least`, and up to `most` as far as `factor` times the nearest."""
    nearest = F.min("distance").over(Window.partitionBy("query_id"))
    return hits.withColumn("_near", nearest).where((F.col("rank") <= least) | ((F.col("rank") <= most) & (F.col("distance") <= factor * F.col("_near")))).drop("_near")


def ensure(hits: DataFrame, wanted, n: int) -> DataFrame:  # noqa: ANN001
    """The first `n` hits (query_id, rank) of each question; where none of them is `wanted` but a later one is, the best
    of those stands first and the last gives way."""
    w = Window.partitionBy("query_id")
    flagged = hits.withColumn("_w", F.coalesce(wanted, F.lit(False)))
    flagged = flagged.withColumn("_first", F.min(F.when(F.col("_w"), F.col("rank"))).over(w))
    moved = flagged.withColumn("_place", F.when((F.col("_first") > n) & (F.col("rank") == F.col("_first")), 0).otherwise(F.col("rank")))
    return moved.withColumn("place", F.row_number().over(w.orderBy("_place"))).where(F.col("place") <= n).drop("_w", "_first", "_place")


def context(hits: DataFrame, text: str, label: str) -> DataFrame:
    """(query_id, context, sources): the hits of each question in order, each under its label.

    The hits of a question are bounded by the search that found them.
    """
    parts = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.upper(F.coalesce(F.col(label), F.lit("unknown"))), F.lit("]\n"), F.coalesce(F.col(text), F.lit(""))).alias("t"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n---\n\n").alias("context"), F.count("*").alias("sources"))


def evidence(questions: DataFrame, hits: DataFrame, stop: list[str], least: float = 0.3, score: float = 0.2) -> DataFrame:
    """(query_id, enough, overlap): whether the three best texts (query_id, rank, text, score) hold the question's words.

    Without a hit there isn't enough; with a best score under `score` neither; a question without words needs none.
    """
    top = hits.where("rank <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.lower(x["text"])), " ").alias("_t"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_s"))
    asked = questions.select("query_id", T.keywords("text", stop).alias("_k")).join(top, "query_id", "left")
    share = F.try_divide(F.size(F.filter("_k", lambda k: F.contains("_t", k))), F.size("_k"))
    enough = F.col("_t").isNotNull() & F.coalesce(F.col("_s") >= score, F.lit(True)) & ((F.size("_k") == 0) | (share >= least))
    return asked.select("query_id", F.coalesce(enough, F.lit(False)).alias("enough"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("overlap"))


def uncited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of answers (answer_id, answer) that stand in none of the sources (answer_id, file, page).

    A citation is [Source: file, Page n, Section: s], whatever its case; page is a number or Unknown.
    """
    pattern = r"(?i)\[source:\s*([^,\]]+),\s*page\s*(\d+|unknown),\s*section:\s*([^\]]+)\]"
    cited = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(pattern), F.lit(0))).alias("n", "whole"))
    parts = cited.select("answer_id", "n", F.trim(F.regexp_extract("whole", pattern, 1)).alias("file"), F.lower(F.regexp_extract("whole", pattern, 2)).alias("page"))
    return parts.join(sources.select("answer_id", "file", F.lower(F.col("page").cast("string")).alias("page")), ["answer_id", "file", "page"], "left_anti")


def says_any(answer: Column, phrases: list[str]) -> Column:
    """Whether an answer holds any of the phrases, without case."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(answer), p))


def says_more(answer: Column, context: Column, phrases: list[str]) -> Column:
    """Whether an answer holds a phrase that its context doesn't."""
    known = F.lower(F.coalesce(context, F.lit("")))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(answer), p) & ~F.contains(known, p))


def is_valid(answer: Column, chunks: Column) -> Column:
    """Whether an answer says something: a long one does, one that only says that nothing was found doesn't, a middling one
    does with evidence, a short one doesn't."""
    n = F.length(answer)
    return F.when(n > 500, True).when(F.lower(F.trim(answer)) == "information not found in available monographs.", False).when((n > 100) & (chunks > 0), True).otherwise(n >= 50)


def reason(name: Column, section: Column, chunks: Column) -> Column:
    """Why there is no evidence for a question: its name is unknown, its section is, or neither is asked for."""
    return F.when(name.isNotNull() & (chunks == 0), "drug_not_found").when(name.isNotNull() & section.isNotNull(), "section_not_found").otherwise("default")


def for_generator(sections: DataFrame) -> DataFrame:
    """Sections under the names that a generator reads, with a path made of name and section."""
    part = lambda c: F.coalesce(c, F.lit("unknown"))
    return sections.select(F.col("id").alias("chunk_id"), F.col("content_text").alias("chunk_text"), "section_name", F.col("page_start").alias("page_num"), F.col("drug_name").alias("drug_generic"), F.concat(F.lit("sections/"), part("drug_name"), F.lit("/"), part("section_name")).alias("file_path"))


def report(scores: DataFrame, targets: DataFrame, key: str, worst: int = 3) -> DataFrame:
    """(metric, mean, target, passed, worst): each metric's mean score (key, metric, score) against its target, with the keys
    of the lowest scores. Metrics are few; the lowest are found before they are gathered."""
    means = scores.groupBy("metric").agg(F.avg("score").alias("_m"))
    low = scores.where("score is not null").withColumn("_n", F.row_number().over(Window.partitionBy("metric").orderBy("score", key))).where(F.col("_n") <= worst)
    few = low.groupBy("metric").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", key))), lambda x: x[key]).alias("worst"))
    return means.join(small(targets), "metric").join(few, "metric").select("metric", F.round("_m", 6).alias("mean"), "target", (F.col("_m") >= F.col("target")).alias("passed"), "worst")


def alike_or_worded(questions: DataFrame, sections: DataFrame, words: dict[str, list[str]], least: float = 0.2) -> DataFrame:
    """Sections of the question's name whose name is like its section by more than `least`, or holds one of the words that go
    with a word of it (words: by that word)."""
    found = by_any_name(questions.where("section is not null"), sections.select("id", "drug_name", "brand_name", "generic_name", "section_name"))
    low, asked = F.lower("section_name"), F.lower("section")
    goes = F.lit(False)
    for word, own in words.items():
        goes = goes | (F.contains(asked, F.lit(word)) & F.exists(F.array(*map(F.lit, own)), lambda w: F.contains(low, w)))
    return found.where((T.trigram_similarity("section_name", "section") > least) | F.coalesce(goes, F.lit(False)))


def as_questions(direct: DataFrame) -> DataFrame:
    """(query_id, text): requests (query_id, name, section) for a section, or for all, as questions."""
    return direct.select("query_id", F.concat(F.coalesce("section", F.lit("all sections")), F.lit(" of "), "name").alias("text"))
