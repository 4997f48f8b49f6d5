"""Finding rows by name: exact, by any of several names, by likeness, by words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.sources.tables import small


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each key in a total order; ties at the end are cut by the order alone."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def by_any_name(questions: DataFrame, sections: DataFrame, names: tuple[str, ...] = ("drug_name", "brand_name", "generic_name")) -> DataFrame:
    """Sections (id, ...) of which any name equals the question's (query_id, name), without case.

    Instead of a join on either of three equalities, each section comes once for each distinct name and is joined by
    equality; the question side is broadcast if it is small.
    """
    named = sections.withColumn("_name", F.explode(F.array_distinct(F.filter(F.array(*(F.lower(n) for n in names)), lambda x: x.isNotNull()))))
    asked = questions.withColumn("_name", F.lower("name"))
    return named.join(small(asked), "_name").drop("_name", "name")


def alike(questions: DataFrame, rows: DataFrame, on: str, least: float, n: int, key: str = "id") -> DataFrame:
    """For each question (query_id, text) the `n` rows whose trigram similarity is above `least`.

    Both sides meet on trigrams, so that only rows that share one are compared; similarity counts shared trigrams.
    """
    q = questions.withColumn("_grams", T.trigrams("text"))
    left = q.select("query_id", F.size("_grams").alias("_nq"), F.explode("_grams").alias("gram"))
    r = rows.select(key, on, T.trigrams(on).alias("_grams"))
    right = r.select(key, on, F.size("_grams").alias("_nr"), F.explode("_grams").alias("gram"))
    shared = right.join(small(left), "gram").groupBy("query_id", key, on, "_nq", "_nr").agg(F.count("*").alias("_both"))
    scored = shared.withColumn("similarity", F.round(F.col("_both") / (F.col("_nq") + F.col("_nr") - F.col("_both")), 6)).where(F.col("similarity") > least)
    return first_per(scored, ["query_id"], [F.desc("similarity"), key], n, "rank").select("query_id", key, on, "similarity", "rank")


def nearest_names(typed: DataFrame, names: DataFrame, edits: int = 2) -> DataFrame:
    """(word, name, distance): for each distinct typed word the name within `edits`, the closest, then the first.

    Lengths within the edits meet by equality; distances are bounded.
    """
    words = typed.select("word").distinct().withColumn("_len", F.explode(F.sequence(F.length("word") - edits, F.length("word") + edits)))
    known = names.select("name").distinct().withColumn("_len", F.length("name"))
    met = words.join(small(known), "_len").withColumn("distance", F.levenshtein(F.lower("word"), F.lower("name"), edits)).where(F.col("distance") >= 0)
    return first_per(met, ["word"], ["distance", "name"]).select("word", "name", "distance")
