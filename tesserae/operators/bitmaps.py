"""Totals and facets of whole result sets from bitmaps of documents.

Documents have dense numbers. The documents of a term are a bitmap for each 32,768 numbers, a query's result set is the
union of its terms' bitmaps and of the few documents that other clauses add, and a total is a count of bits. Facets
are counted where a part of the numbers has its documents' values at hand. No step has a row for each query and document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.numbering import number_in_order
from tesserae.sources.scratch import save

_PART = 32768  # numbers a bitmap of Spark's functions holds


def numbered(docs: DataFrame, key: str = "_id") -> DataFrame:
    """(key, doc_no): numbers from 0 without gaps, in no particular order."""
    rows = save(docs.select(key).withColumn("_at", F.monotonically_increasing_id()), "ids")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return save(rows.join(F.broadcast(starts), part == F.col("_part")).select(key, (F.col("_start") + inside).alias("doc_no")), "numbers")


def _bits(doc_no: Column) -> list[Column]:
    """Of document numbers: the part they are in, and the bitmap of their places there."""
    return [F.shiftright(doc_no, 15).alias("part"), F.bitmap_construct_agg(F.bitmap_bit_position(doc_no + 1)).alias("bits")]


def term_bitmaps(postings: DataFrame, terms: DataFrame, numbers: DataFrame, fields: list[str], key: str = "_id") -> DataFrame:
    """(term, part, bits): the documents that have each of ``terms`` (term) in one of ``fields``."""
    wanted = postings.where(F.col("field").isin(fields)).select("term", key).join(terms.select("term").distinct(), "term", "left_semi")
    part, bits = _bits(F.col("doc_no"))
    return wanted.join(numbers, key).groupBy("term", part).agg(bits)


def result_bitmaps(query_terms: DataFrame, by_term: DataFrame, more: DataFrame, numbers: DataFrame, key: str = "_id") -> DataFrame:
    """(query_id, part, bits): documents that have any term of the query, or are in ``more`` (query_id, key)."""
    met = query_terms.select("query_id", "term").distinct().join(by_term, "term").select("query_id", "part", "bits")
    return with_more(met, more, numbers, key)


def with_more(met: DataFrame, more: DataFrame, numbers: DataFrame, key: str = "_id") -> DataFrame:
    """(query_id, part, bits): the union of bitmaps ``met`` of each query and part and of the documents in ``more`` (query_id, key)."""
    part, bits = _bits(F.col("doc_no"))
    added = more.select("query_id", key).join(numbers, key).groupBy("query_id", part).agg(bits)
    return met.unionByName(added).groupBy("query_id", "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def totals(found: DataFrame) -> DataFrame:
    """(query_id, total_hits)."""
    return found.groupBy("query_id").agg(F.sum(F.bitmap_count("bits")).alias("total_hits"))


def _count_values(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    queries, codes, counts = [], [], []
    if len(left) and len(right):
        place = np.concatenate([np.asarray(p) for p in right["places"]])
        code = np.concatenate([np.asarray(c) for c in right["codes"]])
        known, code = np.unique(code, return_inverse=True)
        for query, bits in zip(left["query_id"], left["bits"]):
            mask = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
            n = np.bincount(code[mask[place]], minlength=len(known))
            some = np.flatnonzero(n)
            queries.append(np.full(len(some), query))
            codes.append(known[some])
            counts.append(n[some])
    join = lambda x: np.concatenate(x) if x else []
    return pd.DataFrame({"query_id": join(queries), "code": join(codes), "count": join(counts)})


def facet(found: DataFrame, docs: DataFrame, numbers: DataFrame, column: str, size: int, key: str = "_id", per_block: int = 1024) -> DataFrame:
    """(query_id, value, count): the ``size`` most frequent values of ``column`` in each result set; ties by value. Array values count once a row.

    A part's documents and at most about ``per_block`` queries' bitmaps of it meet in one task. Query ids are longs.
    """
    value = F.explode(F.array_distinct(column)) if isinstance(docs.schema[column].dataType, T.ArrayType) else F.col(column)
    held = docs.select(key, value.alias("value")).where("value is not null")
    coded = number_in_order(held.select("value").distinct(), [F.col("value")], "code")
    coded = save(coded, "values")
    placed = held.join(coded, "value").join(numbers, key).select(F.shiftright("doc_no", 15).alias("part"), F.col("doc_no").bitwiseAND(_PART - 1).cast("int").alias("place"), "code")
    blocks = max(1, -(-found.select("query_id").distinct().count() // per_block))
    # a part's documents are one row for every few values; copies of it go to each block of queries
    packed = placed.groupBy("part", F.pmod("code", F.lit(64)).alias("some")).agg(F.collect_list("place").alias("places"), F.collect_list("code").alias("codes"))
    right = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("part", F.col("block").cast("long").alias("block"), "places", "codes")
    left = found.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long"))
    counted = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_count_values, "query_id long, code long, count long")
    sums = counted.groupBy("query_id", "code").agg(F.sum("count").alias("count"))
    w = Window.partitionBy("query_id").orderBy(F.col("count").desc(), "code")  # codes are in the order of values
    top = sums.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size)
    return top.join(coded, "code").select("query_id", "value", "count")
