"""Corpus preparation: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import digest_index, language_id, mixing, packing, simhash
from tesserae.llm.common import keep_rows, save
from tesserae.llm.queries import fresh_index


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; the others go, whatever the language. Where no row has a language to learn from, too.

    A null or empty text has no letter. Repeated rows and ids share their fate; a text of any length is one document;
    an empty table stays empty.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(spark, model, F.col("text"))
    return docs.withColumn("_ts_found", found).where(F.col("_ts_found.lang_pred") != "und").drop("_ts_found")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal without white space: the longest, then the smallest id, null last.

    A null text is an empty one. Of repeated rows one stays; an empty table stays empty.
    """
    found = digest_index.dedup(docs, fresh_index(spark), "all")
    return keep_rows(docs, found.where("kept"), found)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id, null last, then the smallest hash of the text.

    Texts without a word, null ones too, are one component. Of repeated rows one stays; an empty table stays empty.
    """
    found = simhash.near_duplicates(docs)
    return keep_rows(docs, simhash.representatives(found), found)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without a word, null ones too, are not taken.

    Null sources are one source. Repeated rows count each, and come as often as all of them together are taken; an empty
    table stays empty.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("_ts_id"), F.col("text_hash").alias("_ts_h")).agg(F.sum(times).alias("_ts_n"), F.count(F.lit(1)).alias("_ts_m"))
    taken = save(taken.where("_ts_n > 0"), "taken")  # of known size, so that Spark may broadcast it
    mine = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("_ts_id")) & (mine == F.col("_ts_h")))
    if not taken.where("_ts_m > 1").isEmpty():  # rows alike in id and text: one of them as often as all together are taken
        joined = joined.where("_ts_m = 1").unionByName(joined.where("_ts_m > 1").dropDuplicates(["_ts_id", "_ts_h"]))
    return joined.withColumn("_ts_k", F.explode(F.sequence(F.lit(1), F.col("_ts_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row per piece. A null text is its end token alone; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the language model, the fingerprints, or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
