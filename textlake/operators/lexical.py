"""Words to rows: an inverted index, matching of all words, BM25 ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.operators.lookup import first_per
from textlake.sources.tables import small

WORD = r"[a-z0-9]+"


def words(text):  # noqa: ANN001, ANN201
    """The words of a text in small ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def index(rows: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, length, term, tf): how often each word stands in each row. Counting is partly done before the shuffle."""
    split = rows.select(key, *carry, words(F.col(text)).alias("_w"))
    return split.select(key, *carry, F.size("_w").alias("length"), F.explode("_w").alias("term")).groupBy(key, *carry, "length", "term").agg(F.count("*").alias("tf"))


def rank(terms: DataFrame, questions: DataFrame, rows: DataFrame, key: str, n: int, scope: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank): the `n` rows that hold all words of a question, best first by BM25.

    terms: what `index` made of `rows`; questions: (query_id, text, *scope). Numbers of rows and mean length come from
    all rows. Question words are few, and broadcast if they are.
    """
    sizes = rows.agg(F.count("*").alias("n_rows"), F.avg(F.size(words(F.col("_text")))).alias("mean"))
    asked = questions.select("query_id", *([scope] if scope else []), F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    # Only words that are asked for: the optimizer takes this filter below the counting of an index made on the fly.
    terms = terms.join(small(asked.select("term").distinct()), "term", "left_semi")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    weight = F.log1p((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    known = asked.join(df, "term").join(F.broadcast(sizes))
    met = terms.join(known, ["term", *([scope] if scope else [])]).groupBy("query_id", key).agg(F.count("*").alias("found"), F.round(F.sum(part), 6).alias("score"))
    return first_per(met.join(needed, "query_id").where("found = needed"), ["query_id"], [F.desc("score"), key], n, "rank").select("query_id", key, "score", "rank")
