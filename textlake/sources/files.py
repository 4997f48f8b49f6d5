"""Reading and writing files: folders of documents, pages, CSV and JSON; atomic tables."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A parser takes the bytes of one file and gives the text of its pages.
Parser = Callable[[bytes], list[str]]
PARSED = "file_path string, file_hash string, length bigint, page_count int, pages array<string>, parse_success boolean, error_message string"


def scan_folder(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("pdf", "PDF"), deep: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files with one of the suffixes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", deep).load(folder)


def plain_pages(content: bytes) -> list[str]:
    """The default parser: UTF-8 text whose pages are parted by form feeds; a page that isn't UTF-8 is left blank, but a
    file without any readable page is an error."""
    out, bad = [], None
    for part in content.split(b"\f"):
        try:
            out.append(part.decode("utf-8"))
        except UnicodeDecodeError as e:
            bad = e
            out.append("")
    if bad and not any(x.strip() for x in out):
        raise bad
    return out


def parse(files: DataFrame, parser: Parser = plain_pages) -> DataFrame:
    """One row for each file: its pages, or the error that reading it met. A bad file never ends the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                try:
                    pages, error = parser(bytes(r.content)), None
                except Exception as e:  # noqa: BLE001
                    pages, error = [], f"{type(e).__name__}: {e}"
                rows.append((r.path, r.file_hash, r.length, len(pages), pages, error is None, error))
            yield pd.DataFrame(rows, columns=["file_path", "file_hash", "length", "page_count", "pages", "parse_success", "error_message"])

    hashed = files.select("path", F.sha2("content", 256).alias("file_hash"), "length", "content")
    return hashed.mapInPandas(run, PARSED)


def pages(parsed: DataFrame) -> DataFrame:
    """(file_path, page_num, text, char_start, char_end): pages that aren't blank, with running offsets in their file."""
    each = parsed.select("file_path", F.posexplode("pages").alias("n", "text")).where(F.trim("text") != "")
    w = Window.partitionBy("file_path").orderBy("n")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return each.select("file_path", (F.col("n") + 1).alias("page_num"), "text", (end - F.length("text")).alias("char_start"), end.alias("char_end"))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file of a stated schema; lines that begin with # are comments."""
    return spark.read.csv(path, schema=schema, header=header, comment="#", multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, also spread over lines."""
    return spark.read.json(path, schema=schema, multiLine=True)


def save_index(rows: DataFrame, path: str, dim: int) -> None:
    """Vectors (vec_id, embedding), after each has been seen to have `dim` numbers; the commit is Parquet's own."""
    rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector hasn't {dim} numbers")).cast("array<float>"))).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, dim: int) -> DataFrame | None:
    """What save_index wrote, or None if nothing lies there; a vector of another size is an error when it is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).where(F.expr(f"assert_true(size(embedding) = {int(dim)}) is null"))


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what lies there."""
    rows.write.mode("overwrite").json(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Takes all rows out of a Parquet table; its columns stay."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def delete_index(spark: SparkSession, path: str) -> bool:
    """Deletes a table or folder; whether there was one."""
    at, fs = _at(spark, path)
    return fs.delete(at, True) if fs.exists(at) else False


def restore_index(spark: SparkSession, backup: str, path: str) -> None:
    """Puts a copy of `backup` in the place of `path`: the copy is whole before the old table goes."""
    spark.read.parquet(backup).write.mode("overwrite").parquet(f"{path}.new")
    (new, fs), (at, _) = _at(spark, f"{path}.new"), _at(spark, path)
    fs.delete(at, True)
    fs.rename(new, at)


def index_facts(spark: SparkSession, path: str) -> DataFrame | None:
    """(rows, dim): what an index holds, from its Parquet footers and one vector; None if nothing lies there."""
    at, fs = _at(spark, path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dim")) if fs.exists(at) else None


class JsonLines(logging.Formatter):
    """Log records of the driver as lines of JSON, with the fields that a record brings as `extra`."""

    KNOWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        """One record as one line."""
        own = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        own |= {k: v for k, v in vars(record).items() if k not in self.KNOWN}
        if record.exc_info:
            own["error"] = self.formatException(record.exc_info)
        return json.dumps(own, default=str, ensure_ascii=False)
