"""Reading the tables of a directory, and the helpers every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small; one row of ours is under 2 kB, so a broadcast stays under 100 MB.
SMALL_ROWS = 50_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, once for each application: they needn't have it installed."""
    package = Path(__file__).resolve().parents[1]
    if spark.sparkContext.applicationId in _SHIPPED or not package.is_dir():
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    path = os.path.join(tempfile.mkdtemp(), "textlake.zip")  # the driver serves it from there
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of `directory`."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else unchanged: the join then shuffles.

    The count stops after `rows` + 1 rows, so it costs little whatever the size of `df`.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset a local session gets one of its own
    (tests); on a cluster it is an error, as a machine's own folder isn't shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "textlake-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Tables that `cut` wrote and `clear` hasn't deleted yet.
_CUT: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read back: its lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that `cut` has written so far, once what was read from them is done with."""
    while _CUT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
