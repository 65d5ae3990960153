"""Tables written once to the folder that driver and executors share, and read back: lineage ends there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of this process, used in local mode alone and deleted at its end.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="heatlattice-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def _located(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/heatlattice/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    files, place = _located(spark, path)
    files.deleteOnExit(place)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: a lost executor costs nothing. The table goes with `discard`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heatlattice/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # The table stands for itself from here on, so its shuffle files can go as soon as it is written.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    files, place = _located(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to four tasks for each core: rows that are short but costly come from files that one task reads."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        files, place = _located(df.sparkSession, df._staged_path)
        files.delete(place, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, place = _located(spark, path)
    files.delete(place, True)
