"""Queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import conversation_repair, digest_index, html_text, language_id, lexical_index, line_dedup, mixing, packing, quality_rules, rule_ensemble, sharding, simhash, substring_dedup
from tesserae.llm.common import held_out, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_index(spark: SparkSession, name: str = "digests") -> digest_index.DigestIndex:
    """An empty digest index in the shared folder."""
    tag = uuid.uuid4().hex
    return digest_index.DigestIndex(spark, f"{shared_dir(spark)}/tesserae-{tag}-{name}", f"tesserae_{name}_{tag}")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "component_size")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest_index.dedup(table(spark, sf_dir, "documents"), fresh_index(spark), "all")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def digest_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in two batches, the second one deduplicated against the index that the first one left."""
    docs, index = table(spark, sf_dir, "documents"), fresh_index(spark)
    first = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    one, two = (digest_index.dedup(docs.where(w), index, f"batch{n}").withColumn("batch", F.lit(n)) for n, w in ((1, first), (2, ~first)))
    return one.unionByName(two).select("doc_id", "batch", "keep_id", "group_size", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(spark, language_id.train(docs), F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.search(lexical_index.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_conversations(rows, conversation_repair.damage(rows))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_html_extraction, op3_simhash, op4_line_dedup, op5_exact_dedup, op6_quality_rules, op7_packing, op8_quality_classifier, op9_language_id, op10_mixing, op11_lexical_search, op12_conversation_repair, op13_substring_dedup, digest_index_batches)
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.oracle(),
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "digest_index_batches": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < '8' THEN 1 ELSE 2 END::INT AS batch FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h, batch ORDER BY points DESC, doc_id) AS best, count(*) OVER (PARTITION BY h, batch) AS n FROM d),
o AS (SELECT h, any_value(best) AS old_best, any_value(n) AS old_n, true AS old FROM w WHERE batch = 1 GROUP BY h),
j AS (SELECT w.*, old_best, old_n, batch = 2 AND coalesce(old, false) AS in_index FROM w LEFT JOIN o USING (h))
SELECT doc_id, batch, CASE WHEN in_index THEN old_best ELSE best END AS keep_id, (n + CASE WHEN in_index THEN old_n ELSE 0 END)::BIGINT AS group_size, doc_id = best AND NOT in_index AS kept FROM j""",
    "op10_mixing": mixing.ORACLE,
    "op11_lexical_search": lexical_index.ORACLE,
    "op13_substring_dedup": substring_dedup.ORACLE,
}
