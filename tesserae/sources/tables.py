"""Full, incremental and paged reads of tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.numbering import number_in_order


def read_table(spark: SparkSession, path: str | None = None, *, jdbc: dict[str, str] | None = None, predicates: list[str] | None = None) -> DataFrame:
    """A table from Parquet, or by JDBC, where ``predicates`` (or partition options) split the read over tasks."""
    if jdbc is None:
        return spark.read.parquet(path)
    options = {k: v for k, v in jdbc.items() if k not in ("url", "dbtable")}
    if predicates:
        return spark.read.jdbc(jdbc["url"], jdbc["dbtable"], predicates=predicates, properties=options)
    return spark.read.format("jdbc").options(**jdbc).load()


def incremental_extract(df: DataFrame, since: datetime | str | None, ts: str = "last_modified", key: str | None = None, last_key: str | None = None) -> DataFrame:
    """Rows changed after ``since``; all rows without one.

    The mark is strict, so rows that share its time are not read again. With ``key`` and ``last_key`` the mark
    is the pair, and rows of the same time with a greater key are read.
    """
    if since is None:
        return df
    mark = F.lit(since).cast("timestamp")
    later = F.col(ts) > mark
    if key is not None and last_key is not None:
        later |= (F.col(ts) == mark) & (F.col(key) > F.lit(last_key))
    return df.where(later)


def page_rows(df: DataFrame, ts: str, key: str, page_size: int = 5000) -> DataFrame:
    """Every row with its ``page_no`` from 0 and ``row_no`` from 1 in the order of (ts, key), without one task for all or for one time."""
    out = number_in_order(df, [F.col(ts), F.col(key)], "row_no")
    return out.withColumn("page_no", F.floor((F.col("row_no") - 1) / page_size).cast("long"))


def page(df: DataFrame, ts: str, key: str, page_no: int, page_size: int = 5000) -> DataFrame:
    """One page of the order."""
    return df.orderBy(ts, key).offset(page_no * page_size).limit(page_size)
