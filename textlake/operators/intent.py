"""What a batch of questions asks for: names, kinds of section, wider wording, how much context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.sources.tables import small


def _phrases(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """A list of (kind, phrase) as a small table with its order."""
    return spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(pairs)], "ord int, kind string, phrase string")


def _longest(questions: DataFrame, phrases: DataFrame, whole_words: bool = False) -> DataFrame:
    """(query_id, kind, hit, size): the kind whose phrase in the question is the longest, of equals the first."""
    low = questions.select("query_id", F.lower(T.squeeze("text")).alias("_t"))
    inside = F.expr("_t rlike concat('(?U)\\\\b\\\\Q', phrase, '\\\\E\\\\b')" if whole_words else "contains(_t, phrase)")
    met = low.join(F.broadcast(phrases), inside)
    return met.groupBy("query_id").agg(F.max_by(F.struct("kind", F.length("phrase").alias("hit"), F.length("_t").alias("size")), F.struct(F.length("phrase"), -F.col("ord"))).alias("b")).select("query_id", "b.*")


def _shared(questions: DataFrame, best: DataFrame, name: str, least: float, most: float) -> DataFrame:
    score = F.greatest(F.lit(least), F.least(F.lit(most), 2 * F.col("hit") / F.col("size")))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.col("kind").alias(name), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("confidence"))


def section_intents(spark: SparkSession, questions: DataFrame, intents: list[tuple[str, str]] = V.INTENTS) -> DataFrame:
    """(query_id, section, confidence): the kind of section of which the question holds the longest wording.

    The confidence is twice the share of the question's length, from 0.5 to 1; questions without any are null, 0.
    """
    return _shared(questions, _longest(questions, _phrases(spark, intents)), "section", 0.5, 1.0)


def attribute_intents(spark: SparkSession, questions: DataFrame, words: list[tuple[str, str]] = V.ATTRIBUTE_WORDS) -> DataFrame:
    """(query_id, attribute, confidence): the attribute whose wording stands in the question as whole words, 0.6 to 0.95."""
    return _shared(questions, _longest(questions, _phrases(spark, words), True), "attribute", 0.6, 0.95)


def asks_picture(text: Column, words: list[str] = V.PICTURES) -> Column:
    """Whether a question asks for a picture."""
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) | low.rlike("what does .+ look like")


def classified(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """(query_id, text, needs_image, name, attribute, section): a question's parts, each found by itself; one that asks
    for a picture and no section means the structure."""
    out = questions.select("query_id", "text", asks_picture(F.col("text")).alias("needs_image"), named(F.col("text")).alias("name"))
    out = out.join(attribute_intents(spark, questions).select("query_id", "attribute"), "query_id").join(section_intents(spark, questions).select("query_id", "section"), "query_id")
    return out.withColumn("section", F.when(F.col("needs_image") & F.col("section").isNull(), F.lit("structure")).otherwise(F.col("section")))


def whole_sections(spark: SparkSession, questions: DataFrame, sections: list[tuple[str, str, str]] = V.WHOLE_SECTIONS) -> DataFrame:
    """(query_id, section, confidence): the section a question asks for as a whole, if any is sure enough.

    0.7, and 0.15 each for wording of several words and for wording that is more than 0.3 of the question's words.
    """
    phrases = _phrases(spark, [(s, p.strip()) for s, words, _ in sections for p in words.split(",")])
    n = lambda c: F.size(F.split(c, " "))
    low = questions.select("query_id", F.lower(T.squeeze("text")).alias("_t"))
    score = F.lit(0.7) + F.when(n("phrase") >= 2, 0.15).otherwise(0.0) + F.when(n("phrase") / n("_t") > 0.3, 0.15).otherwise(0.0)
    met = low.join(F.broadcast(phrases), F.expr("contains(_t, phrase)")).withColumn("confidence", F.round(F.least(F.lit(1.0), score), 6))
    return met.groupBy("query_id").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")).select("query_id", F.col("b.kind").alias("section"), "b.confidence")


def first_kind(spark: SparkSession, questions: DataFrame, kinds: list[tuple[str, str]] = V.KINDS) -> DataFrame:
    """(query_id, kind): the first kind, in order, of which the question holds any wording; null without one."""
    met = questions.select("query_id", F.lower("text").alias("_t")).join(F.broadcast(_phrases(spark, [(k, p.strip()) for k, words in kinds for p in words.split(",")])), F.expr("contains(_t, phrase)"))
    return questions.select("query_id").join(met.groupBy("query_id").agg(F.min_by("kind", "ord").alias("kind")), "query_id", "left")


def capitalised(text: Column) -> Column:
    """The first word of more than three characters that begins with a capital, in small letters, without marks; else unknown."""
    bare = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", ""))
    return F.coalesce(F.lower(F.get(F.filter(bare, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}")), F.lit(0))), F.lit("unknown"))


PLAN = "drug string, query_mode string, attribute string, candidate_sections array<string>, search_phrases array<string>, extraction_level string, confidence double"


def plans(rows: DataFrame) -> DataFrame:
    """Plans (query_id, text, plan as JSON) with each field as it must be: what is missing or malformed takes its default.

    A plan that is no JSON at all is the fallback: the capitalised word of the question, GLOBAL, confidence 0.3.
    """
    p = F.from_json("plan", PLAN, {"mode": "PERMISSIVE"})
    read = rows.select("query_id", "text", p.alias("p"), (F.get_json_object("plan", "$").isNotNull() & F.trim("plan").startswith("{")).alias("ok"))
    given = F.col("ok") & F.coalesce(F.trim("p.drug") != "", F.lit(False))
    return read.select(
        "query_id",
        F.when(given, F.lower("p.drug")).when(F.col("ok"), F.lit("unknown")).otherwise(capitalised(F.col("text"))).alias("drug"),
        F.when(F.col("p.query_mode").isin("SECTION", "ATTRIBUTE", "MULTI_SECTION", "GENERIC", "GLOBAL"), F.col("p.query_mode")).otherwise(F.lit("GLOBAL")).alias("query_mode"),
        F.col("p.attribute").alias("attribute"),
        F.coalesce("p.candidate_sections", F.array().cast("array<string>")).alias("candidate_sections"),
        F.when(F.size("p.search_phrases") > 0, F.col("p.search_phrases")).otherwise(F.array("text")).alias("search_phrases"),
        F.when(F.col("p.extraction_level") == "sentence", F.lit("sentence")).otherwise(F.lit("block")).alias("extraction_level"),
        F.when(F.col("ok"), F.coalesce("p.confidence", F.lit(0.5))).otherwise(0.3).alias("confidence"),
    )


def named(text: Column, patterns: list[str] = V.NAME_PATTERNS, stop: list[str] = V.NOT_NAMES) -> Column:
    """The name a question asks about: what the first pattern captures that is no common word, in small letters."""
    tries = []
    for p in patterns:
        found = F.lower(F.trim(F.regexp_extract(text, f"(?iU){p}", 1)))
        tries.append(F.when((found != "") & ~found.isin(stop), found))
    return F.coalesce(*tries)


def widened(text: Column, expansions: dict[str, list[str]] = V.EXPANSIONS, most: int = 3) -> Column:
    """The question with the first `most` related terms it lacks."""
    low = F.lower(text)
    every = F.concat(*(F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in expansions.items()))
    more = F.slice(F.filter(every, lambda s: ~F.contains(low, s)), 1, most)
    return F.when(F.size(more) > 0, F.concat(text, F.lit(" "), F.array_join(more, " "))).otherwise(text)


def context_size(text: Column, rows: Column) -> Column:
    """(least, most) pieces of context: more in larger collections, for hard questions and for lists."""
    # Sizes of collections and of their contexts.
    base = F.when(rows < 3000, F.array(F.lit(5), F.lit(8))).when(rows < 6000, F.array(F.lit(8), F.lit(12))).when(rows < 12000, F.array(F.lit(10), F.lit(15))).otherwise(F.array(F.lit(12), F.lit(20)))
    low = F.lower(text)
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    least = F.get(base, F.lit(0)) + F.when(has(V.COMPLEX), 3).when(has(V.COMPREHENSIVE), 10).otherwise(0)
    most = F.get(base, F.lit(1)) + F.when(has(V.COMPLEX), 5).when(has(V.COMPREHENSIVE), 15).otherwise(0)
    return F.struct(least.alias("least"), most.alias("most"))


def resolved(questions: DataFrame, names: DataFrame, word: str = r"[^\p{L}\p{N}]+") -> DataFrame:
    """(query_id, name): distinct names (name) that stand in a question as a word of three or more letters, without case."""
    words = questions.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), word))).alias("_w")).where(F.length("_w") >= 3)
    return words.join(names.select("name", F.lower("name").alias("_w")).distinct(), "_w").select("query_id", "name").distinct()


def variants(questions: DataFrame, templates: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, place, variant): the question, and the templates (kind, ord, template) of its kind filled with its name."""
    made = questions.join(small(templates), "kind", "left").select("query_id", "text", "ord", F.replace("template", F.lit("{name}"), F.col("name")).alias("v"))
    every = questions.select("query_id", F.lit(-1).alias("ord"), F.col("text").alias("v")).unionByName(made.where("v is not null").select("query_id", "ord", "v"))
    first = every.groupBy("query_id", "v").agg(F.min("ord").alias("ord"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "v"))).where(F.col("place") <= most).select("query_id", "place", F.col("v").alias("variant"))
