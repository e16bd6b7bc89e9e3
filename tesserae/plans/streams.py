"""The streaming jobs as queries: the given tables come as changes in several drops, the job runs after each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tesserae.operators import documents
from tesserae.plans.queries import ORACLES, page_dumps, query, vowels, vowels_sql
from tesserae.plans.views import FX_PRODUCTS, changes, products, table
from tesserae.schemas import DOCUMENT
from tesserae.sources import dumps, store
from tesserae.sources.scratch import shared_dir
from tesserae.streaming import jobs, keyed

SCHEMA = ", ".join(f"{name} {kind}" for name, kind in DOCUMENT.items())
DROPS = 3


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tesserae-{uuid.uuid4().hex}-stream"


def _run(writer: DataStreamWriter) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _in_drops(rows: DataFrame, folder: str, *jobs_of: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Writes ``rows`` in drops by their column ``drop``; after each the jobs run over what is new, from their checkpoints."""
    spark, schema = rows.sparkSession, rows.drop("drop").schema
    for n in range(DROPS):
        rows.where(F.col("drop") == n).drop("drop").write.mode("append").parquet(f"{folder}/in")
        for job in jobs_of:
            _run(job(spark.readStream.schema(schema).parquet(f"{folder}/in")))


def _dealt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(DROPS))


def _product_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each product in three versions, in drops that don't follow their times; the last version is the product as it is."""
    p = products(spark, d, F.col("p_partkey").alias("field_row")).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    name = F.when(F.col("version") == 3, F.col("product_name")).otherwise(F.concat(F.lit("outdated "), F.col("product_name")))
    dated = p.withColumns({"product_name": name, "last_modified": F.timestamp_seconds(F.col("version") * 1000)})
    return dated.withColumn("drop", _dealt("field_row", "version")).drop("version")


def _stored(changed: DataFrame) -> DataFrame:
    """Products as documents under the keys of their table, as codes may repeat."""
    return documents.product_docs(changed).withColumn("_id", F.concat(F.lit("product_"), F.col("metadata")["field_row"]))


_PRODUCT_TEXT = "concat_ws(' ', product_id, nullif(product_name, ''), nullif(product_model, ''), nullif(category, ''), status)"


@query(f"""WITH {FX_PRODUCTS} SELECT product_id AS id, '[' || product_id || '] ' || product_name || ' (' || product_model || ')' AS title, {_PRODUCT_TEXT} AS all_content FROM fx_products""")
def stream_sync(spark, d):
    """The store that product changes leave which come late and in any order."""
    folder = _folder(spark)
    _in_drops(_product_changes(spark, d), folder, lambda s: jobs.stream_sync(s, _stored, f"{folder}/store", f"{folder}/sync"))
    return jobs.read_latest(spark, f"{folder}/store", SCHEMA).select("id", "title", "all_content")


@query(f"""WITH {FX_PRODUCTS}, t AS (SELECT product_id AS id, {_PRODUCT_TEXT} AS text FROM fx_products) SELECT id, CASE WHEN NOT contains(text, 'PROMO') THEN {vowels_sql("text")} END AS vector FROM t""")
def stream_vectorize(spark, d):
    """The vectors of the same store, of an encoder that refuses some texts; those have none."""
    folder = _folder(spark)
    sync = lambda s: jobs.stream_sync(s, _stored, f"{folder}/store", f"{folder}/sync")
    fill = lambda s: jobs.stream_vectorize(_stored(s), f"{folder}/store", SCHEMA, vowels, "2024-02-01 00:00:00", f"{folder}/vectors")
    _in_drops(_product_changes(spark, d), folder, sync, fill)
    return jobs.read_latest(spark, f"{folder}/store", SCHEMA).select("id", _shown("content_vector"))


def _shown(vector: str):
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",").alias("vector")


@query("SELECT event_id, ts FROM events")
def late_rows(spark, d):
    """Changes that come once, twice or three times, within a drop or in several; each is kept once."""
    e = table(spark, d, "events").select("event_id", "ts", F.explode(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int"))).alias("copy"))
    kind = e.schema["ts"].dataType
    rows = e.withColumns({"ts": F.col("ts").cast("timestamp"), "drop": _dealt("event_id", "copy")}).drop("copy")
    folder = _folder(spark)
    once = lambda s: jobs.late_rows(s, "event_id", "ts", delay="60 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
    _in_drops(rows, folder, once)
    return spark.read.parquet(f"{folder}/out").select("event_id", F.col("ts").cast(kind).alias("ts"))


@query(ORACLES["sliding_change_counts"])
def stream_change_counts(spark, d):
    """Sliding counts kept by a stream: each drop renews the windows that it falls into, whose counts only grow."""
    e = changes(spark, d).select("table", F.col("last_modified").alias("ts"), F.col("event_id"))
    kind = e.schema["ts"].dataType
    rows = e.withColumns({"ts": F.col("ts").cast("timestamp"), "drop": _dealt("event_id")}).drop("event_id")
    folder = _folder(spark)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    _in_drops(rows, folder, lambda s: jobs.stream_recent_changes(s, delay="60 days").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/c"))
    last = spark.read.parquet(f"{folder}/out").groupBy("window_start", "window_end", "table").agg(F.max("changes").alias("changes"))
    return last.withColumns({"window_start": F.col("window_start").cast(kind), "window_end": F.col("window_end").cast(kind)})


@query("SELECT page_id, html AS body, 1::BIGINT AS loads FROM pages")
def stream_file_drop(spark, d):
    """Pages in dump files that are dropped in turns; at last all are offered again, and the ledger knows them."""
    folder = _folder(spark)
    rows = page_dumps(spark, d).withColumn("drop", _dealt("page_id"))

    def load(statements: DataFrame, number: int) -> None:
        dumps.insert_rows(statements).select("values").write.mode("overwrite").parquet(f"{folder}/rows/turn={turn}/batch={number}")

    for turn in range(DROPS + 1):
        if turn < DROPS:
            rows.where(F.col("drop") == turn).select("value").write.mode("append").text(f"{folder}/in")
        _run(jobs.stream_file_drop(spark, f"{folder}/in", load, f"{folder}/{'c' if turn < DROPS else 'again'}", ledger=f"{folder}/ledger", pattern="*.txt"))
    loaded = spark.read.parquet(f"{folder}/rows").select(F.get("values", F.lit(0)).cast("bigint").alias("page_id"), F.get("values", F.lit(1)).alias("body"))
    return loaded.groupBy("page_id", "body").agg(F.count(F.lit(1)).alias("loads"))


@query(f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN text <> '' AND NOT contains(text, 'PROMO') THEN {vowels_sql("text")} END AS vector FROM documents""")
def stream_latest(spark, d):
    """Vectors of whole texts by keyed state: three versions of each document, late ones among them, of which the last counts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"))
    text = F.when(F.col("version") == 3, F.col("text")).otherwise(F.concat(F.lit("outdated "), F.col("text")))
    rows = docs.select("_id", F.timestamp_seconds(F.col("version") * 1000).alias("updated_at"), text.alias("text"), _dealt("_id", "version").alias("drop"))
    folder = _folder(spark)
    needed = {keyed.PROVIDER[0]: keyed.PROVIDER[1], "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in needed}
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    try:
        for k, v in needed.items():
            spark.conf.set(k, v)
        _in_drops(rows, folder, lambda s: keyed.stream_latest(s, vowels).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/c"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    last = store.latest_per_key(spark.read.parquet(f"{folder}/out"), "_id", "updated_at", "tries")
    return last.select(F.col("_id").alias("doc_id"), _shown("content_vector"))
