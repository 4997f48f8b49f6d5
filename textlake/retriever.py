"""The surface that answers batches of questions over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake import providers
from textlake.functions import text as T
from textlake.functions import vocabulary as V
from textlake.operators import intent, lexical, lookup, retrieve
from textlake.sources.tables import cut, table


class Retriever:
    """Questions against `monograph_sections` and `fact_spans` of a directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.sections = table(spark, directory, "monograph_sections")
        self.spans = table(spark, directory, "fact_spans")

    def hits(self, questions: DataFrame) -> DataFrame:
        """(query_id, path, id, rank) of questions (query_id, name, section, text): exact, else alike, else by words."""
        words = self.spans.where("sentence_text is not null").withColumn("name", F.lower("drug_name"))
        terms = lexical.index(words, "fact_span_id", "sentence_text", ("name", "section_id"))
        asked = questions.select("query_id", F.lower("name").alias("name"), "text")
        ranked = lexical.rank(terms, asked.where("text is not null and name is not null"), words.withColumn("_text", F.col("sentence_text")), "fact_span_id", 60, "name")
        by_words = ranked.join(self.spans.select("fact_span_id", F.col("section_id").alias("id")), "fact_span_id").where("id is not null")
        paths = [("EXACT", retrieve.exact(questions, self.sections)), ("FUZZY", retrieve.fuzzy(questions, self.sections)), ("LEXICAL", lookup.first_per(by_words, ["query_id", "id"], ["rank"]))]
        return retrieve.first_path(questions, paths)

    def answer(self, questions: DataFrame, size: int = 20) -> DataFrame:
        """(query_id, path, answer, sources): the first `size` hits of each question as its context, answered by the default."""
        every = cut(self.hits(questions))
        hits = every.where(F.col("rank") <= size)
        found = hits.join(self.sections.select("id", "section_name", "content_text"), "id")
        context = retrieve.context(found, "content_text", "section_name")
        paths = every.groupBy("query_id").agg(F.first("path").alias("path"))
        whole = questions.select("query_id").distinct().join(context, "query_id", "left")
        return providers.extractive(whole).join(whole.select("query_id", F.coalesce("sources", F.lit(0)).alias("sources")), "query_id").join(paths, "query_id")

    def search_sections(self, questions: DataFrame, n: int = 5, least: float = 0.2) -> DataFrame:
        """(query_id, id, section_name, similarity, preview): headings of a name most like the text asked for."""
        found = retrieve.fuzzy(questions.select("query_id", "name", F.col("text").alias("section")), self.sections, least, n)
        return found.select("query_id", "id", "section_name", "similarity", T.preview("content_text").alias("preview"))

    def names(self) -> DataFrame:
        """All names there are."""
        return self.sections.where("drug_name is not null").select("drug_name").distinct()

    def sections_of(self, name: str) -> DataFrame:
        """The section names of one name."""
        low = name.lower()
        return self.sections.where((F.lower("drug_name") == low) | (F.lower("brand_name") == low) | (F.lower("generic_name") == low)).select("section_name").distinct()

    def section_types(self) -> DataFrame:
        """Section names with how often they stand."""
        return self.sections.groupBy("section_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_name")

    def health(self) -> DataFrame:
        """One row of counts."""
        return self.sections.agg(F.count("*").alias("sections"), F.count_distinct("drug_name").alias("names"), F.count_if(F.col("content_text").isNull()).alias("empty")).withColumn("degraded", F.col("sections") == 0)

    def get_section(self, name: str, section: str) -> DataFrame:
        """The sections of a name under a section's name, by page."""
        asked = self.spark.createDataFrame([(1, name, section)], "query_id bigint, name string, section string")
        return retrieve.exact(asked, self.sections).select("id", "rank", "section_name", "content_text").orderBy("rank")

    def get_structure_image(self, name: str) -> DataFrame:
        """The pictures of a name's structure, by section."""
        asked = self.spark.createDataFrame([(1, name, True)], "query_id bigint, name string, needs_image boolean")
        return retrieve.images(asked, self.sections).select("id", "rank", "image_paths").orderBy("rank")

    def ask(self, questions: DataFrame, core: list[str] = V.CORE) -> DataFrame:
        """(query_id, path, id, rank): whole questions (query_id, text), classified and sent through all paths."""
        known = intent.classified(self.spark, questions)
        attributes = self.spark.createDataFrame([(a, [w.strip() for w in words.split(",")], [s.strip() for s in sections.split(",")]) for a, words, sections in V.ATTRIBUTES], "attribute string, words array<string>, sections array<string>")
        none = F.array().cast("array<string>")
        asked = known.join(F.broadcast(attributes), "attribute", "left").withColumn("words", F.coalesce("words", none)).withColumn("sections", F.coalesce("sections", none))
        return retrieve.cascade(asked.withColumn("candidates", none).withColumn("plan_name", F.col("name")).withColumn("phrases", F.array("text")), self.sections, self.spans, core)
