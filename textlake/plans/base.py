"""A register of queries, each with the SQL that checks it, and small literal tables for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class Literal:
    """Rows that are part of a query, for Spark and as a common table expression."""

    def __init__(self, name: str, columns: str, rows: list[tuple]):
        self.name, self.columns, self.rows = name, columns, rows

    def df(self, spark: SparkSession) -> DataFrame:
        """The rows as a DataFrame."""
        return spark.createDataFrame(self.rows, self.columns)

    @property
    def cte(self) -> str:
        """The rows as name(columns) AS (VALUES ...)."""

        def one(x):  # noqa: ANN001, ANN202
            return "NULL" if x is None else "[" + ", ".join(map(one, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

        names = ", ".join(c.split()[0] for c in self.columns.split(", "))
        return f"{self.name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in self.rows) + ")"


# Words that carry no meaning in a question.
STOP = "what is the of for a an and or but in on at to from with by are".split()
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"

ASKED = Literal("asked", "query_id bigint, name string, section string", [
    (1, "velmotrazine", "therapeutic indications"), (2, "VELMOTRAZINE", "indications for therapy"), (3, "Joxjeondine", None), (4, "velmotrazine", "storage"), (5, "no such name", "contraindications"), (6, "joxjeondine", "use in children"), (7, "velmotrazine", None),
])
QUESTIONS = Literal("questions", "query_id bigint, text string", [
    (1, "What is the half-life of Velmotrazine?"), (2, "what's  the usual dose in children ?!"), (3, "Do not combine with alcohol"), (4, "Which patients need careful observation of the liver"), (5, "is it"), (6, "list all interactions with other medicines"), (7, "side effects during pregnancy"),
])

#: DuckDB's forms of the functions of textlake.functions.text.
SQUEEZE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def squeeze(x: str) -> str:
    """SQL: runs of white space as one blank."""
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean_header(x: str) -> str:
    """SQL of functions.text.clean_header."""
    out = f"trim(lower({x}))"
    for lead in ("section ", "part ", "chapter ", "§ "):
        out = f"regexp_replace({out}, '^{lead}', '')"
    out = rf"regexp_replace({out}, '^[\d.]+\s*', '')"
    return squeeze(rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s-]', '', 'g')")


def trigrams(x: str) -> str:
    """SQL of functions.text.trigrams."""
    words = rf"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def similarity(a: str, b: str) -> str:
    """SQL of functions.text.trigram_similarity."""
    x, y = trigrams(a), trigrams(b)
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0)"


JUNK = r"(length(trim({x})) < 50 AND (regexp_matches(trim({x}), '\.{{3,}}\s*\d+') OR regexp_matches(trim({x}), '^[\d\s.]+$')))"
