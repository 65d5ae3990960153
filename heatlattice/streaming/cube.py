"""A cube from a stream of events (beyond the batch analysis): tumbling windows with a watermark, and Gi* of what has closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cube import time_index
from ..operators.gistar import gi_star
from ..storage import discard, remove, staged


def windowed(events: DataFrame, region: str, ts: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(region, t, x): events in each region and window; rows later than the watermark are dropped. Works on batches, too.
    On streams times without a zone count as UTC."""
    if events.isStreaming:
        if dict(events.dtypes)[ts] == "timestamp_ntz":  # watermarks need a zone
            events = events.withColumn(ts, F.to_timestamp_ltz(F.concat(F.col(ts).cast("string"), F.lit("Z"))))
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), F.col(region).cast("string").alias("region")).agg(F.count("*").alias("x")).select("region", F.col("w.start").alias("t"), F.col("x").cast("double").alias("x"))


def run_stream(events: DataFrame, region: str, analyse: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Start a query that hands every batch of closed windows to `analyse`."""
    return windowed(events, region, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(analyse).start()


class GiStarStream:
    """Gi* of closed windows as they close, kept as tables in `folder`: scores/batch=N, and slices/batch=N for what comes next.

    All windows of a time close together, as one watermark rules them, so a batch brings whole time slices, in order. Gi*
    of a slice needs itself and the k slices before it; these k are what a batch leaves for the next one, and nothing older
    is read again. Slices without any event are not there, as in a batch analysis, so "before" skips them. Times that a
    batch closes must lie behind those closed before. Every batch writes its own tables anew, so one that is repeated after
    a failure leaves the same; the tables of slices that no batch can need any more are deleted.
    """

    def __init__(self, edges: DataFrame, folder: str, k: int = 1):
        self.edges, self.folder, self.k = edges, folder.rstrip("/"), k

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def step(self, windows: DataFrame, number: int) -> None:
        """Score one batch of closed windows (region, t, x)."""
        spark = windows.sparkSession
        new = windows.select("region", "t", "x", F.lit(True).alias("new"))
        if number > 0:
            new = new.unionByName(spark.read.schema("region string, t timestamp, x double").parquet(self._path("slices", number - 1)).withColumn("new", F.lit(False)))
        cells = staged(new, "slices")
        obs = cells.join(time_index(cells, "t"), "t").select("region", "t", "x", "new", F.col("region").alias("r"), F.col("t_idx").alias("b"), F.lit(False).alias("surplus"))
        scored = gi_star(obs, self.edges, self.k).where("new")
        scored.select("region", "t", "x", "gi").write.mode("overwrite").parquet(self._path("scores", number))
        last = cells.select("t").distinct().orderBy(F.desc("t")).limit(self.k)
        cells.join(F.broadcast(last), "t", "left_semi").select("region", "t", "x").write.mode("overwrite").parquet(self._path("slices", number))  # k times
        discard(cells)
        if number > 1:
            remove(spark, self._path("slices", number - 2))

    def start(self, events: DataFrame, region: str, checkpoint: str, trigger: dict | None = None, **options):
        """The running query on a stream of events; options are those of `windowed`."""
        writer = windowed(events, region, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.step)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def scores(self, spark: SparkSession) -> DataFrame:
        """(region, t, x, gi) of all windows scored so far."""
        return spark.read.schema("region string, t timestamp, x double, gi double").parquet(f"{self.folder}/scores/batch=*")
