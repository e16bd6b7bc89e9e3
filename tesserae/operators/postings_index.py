"""Postings that changes are added to: delta postings, tombstones, statistics as mergeable sums.

Postings are kept in generations, bucketed by document. A batch adds the postings of its documents and a version row for
each of them and for each document that goes; a posting counts while its generation is its document's latest
version. Document frequencies and lengths are sums of what each batch adds and takes away, so they are never counted
again over all postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.asked import whole_postings
from tesserae.operators.index import tokenize
from tesserae.sources.generations import Generations, new_path

_SUMS = "field string, term string, df long, n_docs long, sum_len long, gen long"


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str, key_type: T.DataType, fields: list[str], tokens: Callable[[Column], Column] = tokenize, buckets: int | None = None):
        """An index in ``path`` over ``fields`` of documents with key ``_id``; opened where it exists."""
        self.spark, self.path, self.fields, self.tokens = spark, path, fields, tokens
        posting = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("_id", key_type), T.StructField("tf", T.LongType()), T.StructField("len", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
        version = T.StructType([T.StructField("_id", key_type), T.StructField("live", T.BooleanType())])
        self.table = Generations(spark, f"{path}/postings", posting, "_id", buckets)
        self.versions = Generations(spark, f"{path}/versions", version, "_id", buckets)

    @classmethod
    def create(cls, docs: DataFrame, fields: list[str], tokens: Callable[[Column], Column] = tokenize, path: str | None = None, buckets: int | None = None) -> PostingsIndex:
        """A new index of ``docs`` as its first batch."""
        out = cls(docs.sparkSession, path or new_path(docs.sparkSession, "index"), docs.schema["_id"].dataType, fields, tokens, buckets)
        out.apply("first", docs)
        return out

    def apply(self, batch: str, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Take a batch of changed documents, at most one row a key, and of keys (``_id``) that go. A committed batch is not taken again.

        Documents are dealt to the buckets as they are; their postings are made there. A key in both goes; one that the index
        doesn't have may go, too. Null keys are left out.
        """
        commits = self.versions.commits()
        if batch in commits:
            return
        gen, known = self.versions.new_generation(), bool(commits)
        keys = []
        if deleted is not None:
            gone = deleted.select("_id").where("_id is not null").distinct()
            keys.append(gone.select("_id", F.lit(False).alias("live")))
        if changed is not None:
            changed = changed.where("_id is not null")
            if deleted is not None:
                changed = changed.join(gone, "_id", "left_anti")
            keys.append(changed.select("_id", F.lit(True).alias("live")))
        for part in keys:
            self.versions.append(part, gen)
        fresh = lambda table: self.spark.table(table.name).where(F.col("_gen") == gen)
        sums = []
        if known:
            taken = self.postings().join(fresh(self.versions).select("_id"), "_id", "left_semi")
            sums.append(self._sums(taken, -1, gen))
        if changed is not None:
            dealt = changed.select("_id", *self.fields).repartition(self.table.buckets, "_id")
            self.table.append(whole_postings(dealt, self.fields, self.tokens), gen, placed=True)
            sums.append(self._sums(fresh(self.table), 1, gen))
        for part in sums:
            part.write.mode("append").parquet(f"{self.path}/sums")
        self.table.commit(batch, gen)
        self.versions.commit(batch, gen)

    @staticmethod
    def _sums(postings: DataFrame, sign: int, gen: int) -> DataFrame:
        """What these postings add to the statistics; rows of a null term are for whole documents."""
        one = F.lit(sign).cast("long")
        by_term = postings.groupBy("field", "term").agg((F.count(F.lit(1)) * one).alias("df"))
        each = postings.where(F.array_contains("positions", 0)).groupBy("field").agg((F.count(F.lit(1)) * one).alias("n_docs"), (F.sum("len") * one).alias("sum_len"))
        zero = F.lit(0).cast("long")
        terms = by_term.select("field", "term", "df", zero.alias("n_docs"), zero.alias("sum_len"))
        return terms.unionByName(each.select("field", F.lit(None).cast("string").alias("term"), zero.alias("df"), "n_docs", "sum_len")).withColumn("gen", F.lit(gen).cast("long"))

    def postings(self) -> DataFrame:
        """(field, term, _id, tf, len, positions) of the documents as they are now; in buckets by ``_id``, without an exchange."""
        columns = self.table.schema.names
        gens = list(self.versions.commits().values())
        rows = self.spark.table(self.table.name).where(F.col("_gen").isin(gens))
        if len(gens) == 1:
            return rows.select(*columns)
        versions = self.spark.table(self.versions.name).where(F.col("_gen").isin(gens))
        last = versions.groupBy("_id").agg(F.max(F.struct("_gen", "live")).alias("v")).select("_id", F.col("v._gen").alias("_gen"), F.col("v.live").alias("live"))
        return rows.join(last.where("live").select("_id", "_gen"), ["_id", "_gen"], "left_semi").select(*columns)

    def _statistics(self) -> DataFrame:
        gens = list(self.versions.commits().values())
        return self.spark.read.schema(_SUMS).parquet(f"{self.path}/sums").where(F.col("gen").isin(gens))

    def terms(self) -> DataFrame:
        """(field, term, df)."""
        return self._statistics().where("term is not null").groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def lengths(self) -> DataFrame:
        """(field, n_docs, avg_len) over the documents that have a token in the field."""
        sums = self._statistics().where("term is null").groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_len").alias("sum_len"))
        return sums.where("n_docs > 0").select("field", "n_docs", (F.col("sum_len") / F.col("n_docs")).alias("avg_len"))

    def compacted(self, path: str) -> PostingsIndex:
        """The same index in another folder as one generation."""
        out = PostingsIndex(self.spark, path, self.table.schema["_id"].dataType, self.fields, self.tokens, self.table.buckets)
        gen = out.versions.new_generation()
        rows = self.postings()
        out.table.append(rows, gen)
        out.versions.append(rows.select("_id", F.lit(True).alias("live")).distinct(), gen)
        self._sums(out.spark.table(out.table.name), 1, gen).write.mode("append").parquet(f"{path}/sums")
        out.table.commit("compacted", gen)
        out.versions.commit("compacted", gen)
        return out
