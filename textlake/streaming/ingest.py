"""Incremental ingestion: files that arrive are taken once, changed ones replace what they left before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive in `folder`, at most `files` of them in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_each(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key among those that are less than `late` behind: state is kept no longer."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, time: str, value: str, size: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum of each time window, given out when the watermark has passed its end."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size, step)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_once(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Takes all that is there and ends; the checkpoint makes a second run take only what is new."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(target).awaitTermination()


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the whole versions of a table: those whose commit mark was written, which Spark does last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in whole)


def current(spark: SparkSession, target: str, schema: str | None = None) -> DataFrame | None:
    """The table that replace_changed keeps, as its latest whole version has it; None before the first."""
    known = versions(spark, target)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{target}/v{known[-1]}") if known else None


def replace_changed(rows: DataFrame, target: str, key: str, checkpoint: str, order: str | None = None) -> None:
    """For each batch takes out the rows of the keys it brings, and writes its own: each key's latest row stays.

    Of several rows of a key in one batch the one with the highest `order` stays, without it any one. Each batch writes
    a version of its own, which counts once its commit mark stands: a driver lost at any moment leaves the version
    before it, and the batch is done again under the same number. Versions before the last two are deleted.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = [n for n in versions(spark, target) if n < number]
        one = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order) if order else F.lit(0)).alias("_r")).select("_r.*")
        old = spark.read.schema(batch.schema).parquet(f"{target}/v{known[-1]}") if known else None
        kept = old.join(batch.select(key).distinct(), key, "left_anti").select(*batch.columns).unionByName(one) if old is not None else one
        kept.write.mode("overwrite").parquet(f"{target}/v{number}")
        for n in known[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
