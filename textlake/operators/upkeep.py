"""Keeping tables current: inserts without duplicates, latest-wins upserts, counters, merges, deletions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def _first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of each key the row that comes first, as an aggregate: rows are compared before the shuffle, and no key's rows meet in
    one sort. Orders are names, the smaller first and nulls last, or (name, True) for the greater first."""
    ranks = []
    for o in order:
        name, down = o if isinstance(o, tuple) else (o, False)
        ranks += [F.col(name).isNull(), -F.col(name) if down else F.col(name)]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*(r.alias(f"_{i}") for i, r in enumerate(ranks)))).alias("_row"))
    return best.select("_row.*")


def insert_ignore(target: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows of `batch` that an insert would add: keys the target lacks, of equal ones the first by `order` (see _first)."""
    return _first(batch.join(target.select(*key), key, "left_anti").select(*batch.columns), key, order)


def latest(target: DataFrame, batch: DataFrame, key: list[str], version: list) -> DataFrame:
    """The target after an upsert: for each key the first row by `version` (see _first)."""
    return _first(target.unionByName(batch, allowMissingColumns=True), key, version)


def count_up(target: DataFrame, batch: DataFrame, key: str, count: str, first: str, last: str) -> DataFrame:
    """Counters after a batch: counts added, the first time kept, the last renewed."""
    cols = [key, count, first, last]
    return target.select(*cols).unionByName(batch.select(*cols)).groupBy(key).agg(F.sum(count).alias(count), F.min(first).alias(first), F.max(last).alias(last))


def delete_keys(target: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The target without the rows of these keys."""
    return target.join(gone.select(*key).distinct(), key, "left_anti")


def needs_ingest(found: DataFrame, stored: DataFrame, version: int) -> DataFrame:
    """Files (file_path, file_hash) that are new, changed, or were read by an older version, with the reason."""
    old = stored.select("file_path", F.col("file_hash").alias("_hash"), F.col("ingestion_version").alias("_version"))
    why = F.when(F.col("_version").isNull() & F.col("_hash").isNull(), "new").when(~F.col("file_hash").eqNullSafe(F.col("_hash")), "changed").when(F.col("_version") < version, "older")
    return found.join(old, "file_path", "left").withColumn("reason", why).where("reason is not null").select("file_path", "file_hash", "reason")


def salted_ids(rows: DataFrame, content: Column, salted: Column, order: list) -> DataFrame:
    """Rows with a 31-bit `row_id` of their content; of rows that collide all but the first get one of the salted."""
    made = rows.withColumn("_id", T.id31(content)).withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(*order)))
    return made.withColumn("row_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(T.id31(salted))).drop("_id", "_n")


def merged_lists(rows: DataFrame, key: str, lists: dict[str, Column], sums: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """One row for each key: distinct values in order, sums, and whether any flag is set."""
    return rows.groupBy(key).agg(*(F.sort_array(F.collect_set(c)).alias(n) for n, c in lists.items()), *(F.sum(c).alias(n) for n, c in sums.items()), *(F.bool_or(c).alias(n) for n, c in flags.items()))


def max_score(rows: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """For each key the row of the highest score, the earlier of equals; `place` is the position of the key's first row."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))).alias("_row"), F.min(position).alias("place"))
    return best.select("_row.*", "place")


def add_mappings(known: DataFrame, more: DataFrame) -> DataFrame:
    """(brand, generic): both lists as one, without case, outer blanks and repetitions; rows without either are left out."""
    plain = lambda df: df.where("brand is not null and generic is not null").select(F.lower(F.trim("brand")).alias("brand"), F.lower(F.trim("generic")).alias("generic"))
    return plain(known).unionByName(plain(more)).distinct()


def truncated(target: DataFrame) -> DataFrame:
    """The table without its rows; its columns stay."""
    return target.where(F.lit(False))
