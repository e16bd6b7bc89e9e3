"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.scratch import save, shared_dir

__all__ = ["WHITE", "WORD", "held_out", "keep_rows", "let", "n_words", "number_rows", "save", "shared_dir", "without_white", "words"]

#: The characters that separate words: space, tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

def words(text: Column) -> Column:
    """The array of words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_white(text: Column) -> Column:
    """The text without white space; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def number_rows(df: DataFrame, groups: list[str], order: list[str], n_rows: int, name: str, per_chunk: int = 4096) -> DataFrame:
    """Add ``name``: a gapless number from 0 within ``groups``, without bringing a group into one task.

    Rows are dealt into chunks by a hash of ``order``; each chunk is numbered on its own and starts where
    the counts of the chunks before it end. Only the counts, one row for each group and chunk, meet in one
    window. Rows that agree in all of ``order`` may swap their numbers in another run.
    """
    chunks = max(1, -(-n_rows // per_chunk))
    chunk, start, of = "_ts_chunk", "_ts_start", [f"_ts_g{i}" for i in range(len(groups))]
    df = df.withColumn(chunk, F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = df.groupBy(*groups, chunk).agg(F.count(F.lit(1)).alias("_ts_n"))
    before = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(a) for g, a in zip(groups, of)], F.col(chunk).alias("_ts_c"), F.coalesce(F.sum("_ts_n").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*groups, chunk).orderBy(*order)
    same = F.col(chunk) == F.col("_ts_c")
    for g, a in zip(groups, of):
        same &= F.col(g).eqNullSafe(F.col(a))
    return (
        df.withColumn("_ts_i", F.row_number().over(within) - 1)
        .join(starts, same)
        .withColumn(name, (F.col(start) + F.col("_ts_i")).cast("long"))
        .drop(chunk, "_ts_c", start, "_ts_i", *of)
    )


def keep_rows(docs: DataFrame, kept: DataFrame, every: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that ``kept`` (doc_id, text_hash: xxhash64 of the text) names; ``every`` names all of them.

    What goes is mostly little beside what stays, so the rows lose it in an anti-join, which moves no text where Spark
    finds that small enough to broadcast. A row of ``docs`` that repeats both the id and the text of another stays once.
    """
    tagged = docs.withColumn("_ts_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda df, of: df["doc_id"].eqNullSafe(of["_ts_id"]) & (df["_ts_h"] == of["_ts_kh"])
    key = [F.col("doc_id").alias("_ts_id"), F.col("text_hash").alias("_ts_kh")]
    counted = every.select(*key, F.lit(1).alias("_ts_all"), F.lit(0).alias("_ts_kept")).unionByName(kept.select(*key, F.lit(0).alias("_ts_all"), F.lit(1).alias("_ts_kept")))
    counted = counted.groupBy("_ts_id", "_ts_kh").agg(F.sum("_ts_all").alias("_ts_all"), F.max("_ts_kept").alias("_ts_kept"))
    counted = save(counted.where("_ts_kept = 0 or _ts_all > 1"), "gone")
    gone, again = (save(counted.where(w).select("_ts_id", "_ts_kh"), n) for w, n in (("_ts_kept = 0", "gone"), ("_ts_kept = 1", "again")))
    stay = tagged.join(gone, same(tagged, gone), "left_anti")
    if not again.isEmpty():
        once = stay.join(again, same(stay, again), "left_anti")
        stay = once.unionByName(stay.join(again, same(stay, again), "left_semi").dropDuplicates(["doc_id", "_ts_h"]))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
