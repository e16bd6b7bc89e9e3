"""Structured Streaming forms of the loops: sync, change counts, file drop, vectorising."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tesserae.operators import vectors
from tesserae.operators.documents import embedding_text
from tesserae.sources import dumps, store
from tesserae.sources.scratch import save


def stream_recent_changes(changes: DataFrame, ts: str = "ts", table: str = "table", delay: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(window_start, window_end, table, changes) in sliding windows; rows later than ``delay`` are left out."""
    kept = changes.withWatermark(ts, delay) if changes.isStreaming else changes
    counts = kept.groupBy(F.window(ts, size, slide).alias("w"), table).agg(F.count(F.lit(1)).alias("changes"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), table, "changes")


def late_rows(changes: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Changes without repeats of (key, ts); what comes later than ``delay`` is not read again."""
    if not changes.isStreaming:
        return changes.dropDuplicates([key, ts])
    return changes.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, ts])


def append_batch(docs: DataFrame, path: str, writer: str, number: int) -> None:
    """Add a batch's documents as a folder of its own; a batch that is run again replaces its own folder."""
    docs.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={number}")


def read_latest(spark: SparkSession, path: str, schema: str, key: str = "_id", order: tuple[str, ...] = ("updated_at", "vector_generated_at", "batch"), keys: DataFrame | None = None) -> DataFrame:
    """The store as it stands: the last row of each document over all batches, or of the documents of ``keys`` only.

    A later change wins over an earlier row and over its vector; of rows of one change the one with a vector wins.
    """
    try:
        rows = spark.read.schema(f"{schema}, writer string, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no batch yet
    if keys is not None:
        rows = rows.join(keys.select(key), key, "left_semi").select(*rows.columns)
    return store.latest_per_key(rows, key, *order).drop("writer", "batch")


def stream_sync(changes: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, order: tuple[str, ...] = ("updated_at",)) -> DataStreamWriter:
    """Changes -> documents -> store, one row per document and batch.

    The checkpoint is the mark: each change is read in one batch only. A batch writes what it brings and no more;
    ``read_latest`` does the upsert, and its result written as one batch is the compacted store.
    """

    def run(batch: DataFrame, number: int) -> None:
        append_batch(store.latest_per_key(build(batch), "_id", *order), path, "sync", number)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def stream_file_drop(spark: SparkSession, path: str, load: Callable[[DataFrame, int], DataFrame | None], checkpoint: str, archive: str | None = None, per_batch: int = 16, ledger: str | None = None, pattern: str = "*.sql") -> DataStreamWriter:
    """New files of names like ``pattern`` -> ``load(statements, batch number)``; done files move to ``archive`` if given.

    The stream brings the files' names; each batch reads at most ``per_batch`` files in chunks side by side
    (``dumps.read_sql_dump``), so a file of any size is never one row; statements come in order of their files' times and their numbers. With a ``ledger`` folder a file whose latest row
    there has the same content is not loaded again. ``load`` may return (file, ok) for its statements, from which the
    ledger takes whether a file succeeded; without it all do. A batch that is run again after a failure doesn't see
    its own rows and replaces them; rows are a batch's own by the checkpoint and the batch's number, so streams with
    other checkpoints may share a ledger.
    """
    mine = hashlib.md5(checkpoint.rstrip("/").encode(), usedforsecurity=False).hexdigest()
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        when = {r["path"]: r["modificationTime"] for r in batch.select("path", "modificationTime").collect()}  # per_batch names
        paths = sorted(when, key=lambda p: (when[p], p))
        if ledger is not None and paths:
            hashes = save(dumps.file_hashes(session, paths), "hashes")
            known = read_ledger(session, ledger).where((F.col("run") != mine) | (F.col("batch") != number))
            fresh = save(dumps.new_files(hashes.select("file", "hash"), known).select("file", "hash"), "fresh")  # as the ledger stood before this batch
            new = {unquote(r["file"]) for r in fresh.select("file").collect()}  # file names may come as parts of a URL
            paths = [p for p in paths if unquote(p.rsplit("/", 1)[-1]) in new]
        turn = F.array_position(F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths]), F.col("file"))
        outcome = load(dumps.read_sql_dump(session, paths).orderBy(turn, "stmt_no"), number) if paths else None
        if ledger is not None and paths:
            rows = fresh.withColumn("success", F.lit(True))
            if outcome is not None:
                rows = fresh.join(dumps.import_outcome(outcome).select("file", "success"), "file", "left").withColumn("success", F.coalesce("success", F.lit(True)))
            rows.withColumn("processed_at", F.current_timestamp()).select("file", "hash", "processed_at", "success").write.mode("overwrite").parquet(f"{ledger}/run={mine}/batch={number}")

    return reader.load(path).select("path", "modificationTime").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(file, hash, processed_at, success, run, batch) of all batches; empty before the first."""
    schema = "file string, hash string, processed_at timestamp, success boolean, run string, batch long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def vectorize(docs: DataFrame, encode: vectors.Encoder, now, key: str = "_id") -> DataFrame:
    """(key, content_vector, vector_generated_at) for the documents without a vector; failed texts have no row."""
    todo = vectors.docs_without_vector(docs)
    made = todo.select(key, vectors.embed(encode)(embedding_text(todo)).alias("content_vector"), F.lit(now).cast("timestamp").alias("vector_generated_at"))
    return made.where(F.col("content_vector").isNotNull())


def stream_vectorize(changes: DataFrame, path: str, schema: str, encode: vectors.Encoder, now, checkpoint: str) -> DataStreamWriter:
    """After each batch of changes, vectors for its documents as they stand in the store, where they lack one; written as rows with a vector.

    Only the batch's documents are read from the store. One whose text could not be encoded is tried again when it changes.
    """

    def run(batch: DataFrame, number: int) -> None:
        docs = vectors.docs_without_vector(read_latest(batch.sparkSession, path, schema, keys=batch.select("_id").distinct()))
        patch = vectorize(docs, encode, now)
        append_batch(store.partial_update(docs, patch, ["_id"], ["content_vector", "vector_generated_at"]).where("content_vector is not null"), path, "vectors", number)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
