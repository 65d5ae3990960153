"""Places of rows in a global order, without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

_SHIFT = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, each row's place from 0 in the given order.

    Rows are dealt by ranges of the order and sorted within their task; its number and the place in it are written with
    them. The counts of the tasks, one row each, are summed up to offsets.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(dealt.withColumn(name, F.monotonically_increasing_id()), f"numbered-{name}")
    task = F.shiftright(name, _SHIFT)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col(name).bitwiseAND(F.lit((1 << _SHIFT) - 1))
    return placed.join(F.broadcast(offsets), task == F.col("_task")).withColumn(name, inside + F.col("_offset")).drop("_task", "_offset")  # a row for each task
