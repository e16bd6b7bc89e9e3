"""Exact dedup against a persistent digest index.

The index is a Parquet table in a given folder, bucketed and sorted by the SHA-256 digest of the normalised
text, with one row per digest: which row stays. A batch is reduced to one row per digest before it meets the
index, so a text that fills a third of the batch is one row there; the meeting is a sort-merge anti-join
that doesn't move the index, and the digests that are new are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import save, without_white

_SCHEMA = "digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING"


class DigestIndex:
    """A digest index in ``path``, known to this session's catalog as ``name``; a folder that a former session wrote is opened as it is."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows of the table's columns; one file per bucket."""
        (
            rows.select("digest", "keep_id", "n_rows", "batch").repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, path: str, name: str) -> DigestIndex:
        """The same index in another folder with one file per bucket; each append had added one to each."""
        out = DigestIndex(self.spark, path, name, self.buckets)
        out.append(self.read())
        return out


def dedup(docs: DataFrame, index: DigestIndex, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, in_index, text_hash.

    Texts are equal when identical without white space; null counts as empty. Of the equal rows of a batch
    the one with most code points, then the smallest id (null last) stays, and of rows that repeat even that
    id exactly one. A text that an earlier batch brought stays out: keep_id then names the earlier row and
    ``in_index`` is true. ``group_size`` counts the rows of this batch and of the index. The same ``batch``
    given again after a failure gives the same rows: what it had already appended doesn't count as earlier.
    A text of any length is one digest; an empty batch gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(without_white(F.col(text)), 256)).alias("digest"), F.char_length(body).alias("points"), F.xxhash64(body).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    rows = save(rows, "digests")
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = save(groups.select("digest", F.col("best.doc_id").alias("first"), F.col("best.row").alias("best_row"), "n"), "groups")

    earlier = index.read().where(F.col("batch") != batch)
    fresh = groups.join(earlier.select("digest").hint("merge"), "digest", "left_anti")
    known = index.read().where(F.col("batch") == batch)
    index.append(fresh.join(known.select("digest").hint("merge"), "digest", "left_anti").select("digest", F.col("first").alias("keep_id"), F.col("n").alias("n_rows"), F.lit(batch).alias("batch")))

    old = index.read().where(F.col("batch") != batch).select("digest", "keep_id", "n_rows", F.lit(True).alias("in_index"))
    verdict = save(
        groups.join(old.hint("merge"), "digest", "left").select(
            "digest", F.when(F.col("in_index"), F.col("keep_id")).otherwise(F.col("first")).alias("keep_id"), (F.col("n") + F.coalesce("n_rows", F.lit(0))).alias("group_size"),
            "best_row", F.coalesce("in_index", F.lit(False)).alias("in_index")), "verdicts")
    return rows.join(verdict, "digest").select(
        "doc_id", "keep_id", "group_size", ((F.col("row") == F.col("best_row")) & ~F.col("in_index")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_index", "text_hash"
    )
