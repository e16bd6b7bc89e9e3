"""Gapless numbers in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.scratch import save


def number_in_order(df: DataFrame, order: list[Column], name: str, per_part: int = 100_000) -> DataFrame:
    """Add ``name``, from 1 in the order of ``order``.

    Spark cuts the rows into ranges of about ``per_part`` by the whole order, so one frequent first value is split by
    the next one; ranges are written, counted, and start where the counts before them end. Only rows alike in
    all of ``order`` must share a range.
    """
    parts = max(1, -(-df.count() // per_part))
    ranged = df.repartitionByRange(parts, *order).withColumn("_no_part", F.spark_partition_id())
    ranged = save(ranged, "ranges")
    counts = ranged.groupBy("_no_part").agg(F.count(F.lit(1)).alias("_no_n"))
    before = Window.orderBy("_no_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select(F.col("_no_part").alias("_no_of"), F.coalesce(F.sum("_no_n").over(before), F.lit(0)).alias("_no_start"))
    within = F.row_number().over(Window.partitionBy("_no_part").orderBy(*order))
    out = ranged.withColumn("_no_i", within).join(starts, F.col("_no_part") == F.col("_no_of"))
    return out.withColumn(name, F.col("_no_start") + F.col("_no_i")).drop("_no_part", "_no_of", "_no_start", "_no_i")
