"""python -m textlake ingest FOLDER TARGET: reads new and changed text files into pages, sections and spans."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators import structure, upkeep
from textlake.sources import files
from textlake.sources.tables import cut

VERSION = 1
TABLES = ("pages", "sections", "spans", "files")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def committed(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the runs that ended: each writes its commit after all its tables."""
    return sorted(r.number for r in spark.read.parquet(f"{target}/commits").select("number").distinct().collect()) if _exists(spark, f"{target}/commits") else []


def stored(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    """A table as the committed runs left it: of each file the rows of the last run that took it. None before the first."""
    runs = committed(spark, target)
    if not runs:
        return None
    read = lambda t: spark.read.option("basePath", f"{target}/{t}").parquet(*(f"{target}/{t}/number={n}" for n in runs))
    last = read("files").groupBy("file_path").agg(F.max("number").alias("number"))
    return read(name).join(last, ["file_path", "number"], "left_semi")


def ingest(spark: SparkSession, folder: str, target: str, suffixes: tuple[str, ...] = ("txt", "md")) -> None:
    """Takes the files that are new, changed or were read by an older version; leaves the others as they are.

    All tables of a run lie under its number and count once the run is committed; a run that broke off is written over
    by the next. What a changed file left before no longer counts. Files that can't be read are logged and tried again.
    """
    scanned = files.scan_folder(spark, folder, suffixes)
    found = scanned.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"))
    before = stored(spark, target, "files")
    known = before if before is not None else spark.createDataFrame([], "file_path string, file_hash string, ingestion_version int")
    wanted = cut(upkeep.needs_ingest(found, known, VERSION))
    fresh = scanned.join(wanted.select(F.col("file_path").alias("path")), "path", "left_semi")
    parsed = cut(files.parse(fresh))
    number = max(committed(spark, target), default=0) + 1
    good = parsed.where("parse_success")
    blocks = structure.page_blocks(files.pages(good), "file_path")
    sections = cut(structure.sections_of(blocks, blocks.where("level > 0"), "file_path", "page_num").withColumn("section_id", F.xxhash64("file_path", "section_no")))
    spans = structure.spans(sections, "section_id", "content").join(sections.select("section_id", "file_path"), "section_id")
    out = {"pages": files.pages(good), "sections": sections, "spans": spans, "files": good.select("file_path", "file_hash", F.lit(VERSION).alias("ingestion_version"))}
    for name in TABLES:
        out[name].write.mode("overwrite").parquet(f"{target}/{name}/number={number}")
    parsed.select("file_path", "parse_success", "error_message", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{target}/log/number={number}")
    spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("append").parquet(f"{target}/commits")


def check(spark: SparkSession, target: str) -> dict[str, int]:
    """Rows of each table."""
    return {name: 0 if (df := stored(spark, target, name)) is None else df.count() for name in TABLES}


def main() -> None:
    """Reads the arguments and runs the job."""
    p = argparse.ArgumentParser(prog="textlake")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("folder")
    one.add_argument("target")
    one.add_argument("--init", action="store_true", help="begin with an empty target")
    one.add_argument("--check", action="store_true", help="give the rows of each table at the end")
    args = p.parse_args()
    spark = SparkSession.builder.appName("textlake").getOrCreate()
    if args.init:
        files.delete_index(spark, args.target)
    ingest(spark, args.folder, args.target)
    if args.check:
        print(check(spark, args.target))


if __name__ == "__main__":
    main()
