"""Places where a model may be plugged in. Each works on batches, and each has an offline default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[tuple[str, str]]], list[float]]


def with_retry(call: Callable, tries: int = 3, wait: float = 1.0) -> Callable:
    """`call`, tried again after 1, 2, 4 ... times `wait` seconds; the last error is raised."""

    def run(*args):  # noqa: ANN002, ANN202
        for i in range(tries):
            try:
                return call(*args)
            except Exception:
                if i == tries - 1:
                    raise
                time.sleep(wait * 2**i)

    return run


def embed(rows: DataFrame, text: str, call: Embed, dim: int, batch: int = 50) -> DataFrame:
    """`rows` with `embedding` from a model that takes `batch` texts at once; a vector of another size is an error."""
    cols = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = with_retry(call)
        for part in parts:
            texts = part[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in made(texts[i : i + batch])]
            if any(len(v) != dim for v in vectors) or len(vectors) != len(texts):
                raise ValueError(f"the model must give one vector of {dim} numbers for each text")
            yield part.assign(embedding=vectors)[[*cols, "embedding"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"
    return rows.mapInPandas(run, schema)


def rerank(pairs: DataFrame, n: int, call: Score | None = None) -> DataFrame:
    """The `n` best (query_id, rank, question, text) of each question by a model's score of both texts; without a model
    the first `n` as they are."""
    if call is None:
        return pairs.where(F.col("rank") <= n)
    cols = pairs.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(_score=call(list(zip(part["question"].fillna(""), part["text"].fillna(""), strict=True))))[[*cols, "_score"]]

    scored = pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", _score double")
    from textlake.operators.lookup import first_per

    return first_per(scored.drop("rank"), ["query_id"], [F.desc("_score"), "text"], n, "rank").drop("_score")


def classify_once(rows: DataFrame, key: str, cache: DataFrame, call: Callable[[list], list[bool]], content: str) -> DataFrame:
    """(key, positive): each distinct key's class, from the cache where it has it, else from the model, called once a key."""
    fresh = rows.select(key, content).dropDuplicates([key]).join(cache.select(key), key, "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "positive": call(part[content].tolist())})

    kind = dict(rows.dtypes)[key]
    return cache.select(key, "positive").unionByName(fresh.mapInPandas(run, f"`{key}` {kind}, positive boolean"))


@dataclass
class Budget:
    """A token budget over sliding seconds, for the calls of one worker; `wait` says how long to hold the next call."""

    limit: int
    seconds: float = 60.0
    spent: list[tuple[float, int]] = field(default_factory=list)

    def wait(self, tokens: int, now: float) -> float:
        """Seconds until `tokens` fit; 0 notes them as spent now."""
        self.spent = [(t, n) for t, n in self.spent if now - t < self.seconds]
        total = sum(n for _, n in self.spent)
        if total + tokens <= self.limit or not self.spent:
            self.spent.append((now, tokens))
            return 0.0
        return max(0.0, self.spent[0][0] + self.seconds - now)


def extractive(context: DataFrame) -> DataFrame:
    """(query_id, answer): the default answer, which is the evidence as it stands; without any, that nothing was found."""
    return context.select("query_id", F.when(F.coalesce(F.col("sources"), F.lit(0)) > 0, F.col("context")).otherwise(F.lit("No evidence was found for this question.")).alias("answer"))
