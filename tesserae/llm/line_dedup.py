"""Cross-site boilerplate lines by their spread over distinct sites.

Lines are hashed. Rows of a hash are first reduced to counts, which prove most lines too rare or confined to
one site; the sites of the others are gathered from their rows in HyperLogLog sketches that merge by aggregation. An
estimate that is clear of the threshold decides; only of lines near it, within several times the standard error, the
distinct sites are counted. Lines seen on enough sites are removed from every document: of lines of a few words and more on
two fifths of the sites or eight, of shorter ones on four fifths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import let, n_words, save


def line_hash(line: Column) -> Column:
    """Hash of a line without white space at its ends."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


#: Share of the sites that a line must be on, at least ``LEAST_SITES`` of them; a line of ``MIN_WORDS`` words needs no more than ``ENOUGH``.
SHARE, SHORT_SHARE, LEAST_SITES, ENOUGH, MIN_WORDS = 0.4, 0.8, 3, 8, 4


def sites_needed(n_sites: int) -> tuple[int, int]:
    """(for lines of MIN_WORDS words and more, for shorter ones). A short line may be ordinary speech on many sites, so it must be on most of them."""
    return max(LEAST_SITES, min(ENOUGH, math.ceil(SHARE * n_sites))), max(LEAST_SITES, math.ceil(SHORT_SHARE * n_sites))


def boilerplate(lines: DataFrame, lg_k: int = 12, errors: float = 6.0, broadcast_lines: int = 1_000_000) -> DataFrame:
    """(line, need, site), repeats included -> (line, sites): the lines of at least ``need`` distinct sites; ``need`` is the same for all rows of a line.

    ``sites`` is the sketch's estimate where that is clear of the threshold, else the exact number. Lines that are left
    after a step are broadcast to the rows up to ``broadcast_lines`` of them.
    """
    need = F.col("need")
    lines = save(lines, "lines")

    def of(some: DataFrame, name: str) -> DataFrame:
        kept = save(some.select(F.col("line").alias("k")), name)
        return lines.join(F.broadcast(kept) if kept.count() <= broadcast_lines else kept, F.col("line") == F.col("k"), "left_semi")

    spread = lines.groupBy("line", "need").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    likely = of(spread.where((F.col("n") >= need) & ((F.col("low") < F.col("high")) | (need <= 1))), "likely")
    sketch = likely.groupBy("line", "need").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    estimate = save(sketch.select("line", "need", F.hll_sketch_estimate("sketch").alias("sites")), "estimates")
    margin = errors * 1.04 / 2 ** (lg_k / 2) * need + 1
    near = of(estimate.where(F.abs(F.col("sites") - need) <= margin), "near")
    exact = near.groupBy("line", "need").agg(F.count_distinct("site").alias("sites"))
    clear = estimate.where(F.col("sites") > need + margin)
    return clear.unionByName(exact.where(F.col("sites") >= need)).select("line", "sites")


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per document: doc_id, text without boilerplate lines, n_lines, n_removed.

    Lines are separated by line feeds and compared without white space at their ends; lines without a word stay.
    How many sites a line must be on follows from the number of sites (``sites_needed``). Null sites count as one
    site. A null text stays null with no lines. Rows that repeat are cleaned each; long texts and lines are taken
    whole; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"))
    enough, short = sites_needed(rows.select("site").distinct().count())
    lines = F.split("text", "\n", -1)
    each = rows.select("site", F.explode(lines).alias("raw")).withColumn("w", n_words(F.col("raw"))).where("w > 0")
    need = F.when(F.col("w") >= MIN_WORDS, F.lit(enough)).otherwise(F.lit(short))
    spread = save(boilerplate(each.select(line_hash(F.col("raw")).alias("line"), need.alias("need"), "site")), "boilerplate").select(F.col("line").alias("k"))
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    placed = rows.select("doc_id", tag.alias("tag"), F.posexplode(lines).alias("at", "raw"))
    hits = placed.select("doc_id", "tag", "at", line_hash(F.col("raw")).alias("line")).join(spread, F.col("line") == F.col("k"), "left_semi")
    gone = hits.groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.collect_set("at").alias("gone"))  # positions in one document
    joined = rows.withColumn("tag", tag).join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")))
    return joined.select("doc_id", kept.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"))


def oracle() -> str:
    white = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    n = r"len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))"
    return rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT count(DISTINCT coalesce(source, chr(0))) AS n FROM documents),
t AS (SELECT trim(line, {white}) AS k, min({n}) AS words, count(DISTINCT coalesce(source, chr(0))) AS sites FROM l WHERE {n} > 0 GROUP BY 1),
b AS (SELECT k FROM t, s WHERE sites >= CASE WHEN words >= {MIN_WORDS} THEN greatest({LEAST_SITES}, least({ENOUGH}, ceil({SHARE} * s.n))) ELSE greatest({LEAST_SITES}, ceil({SHORT_SHARE} * s.n)) END),
m AS (SELECT doc_id, line, pos, coalesce(trim(line, {white}) IN (SELECT k FROM b), false) AS gone FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*)::INT AS n_lines, (count(*) FILTER (WHERE gone))::INT AS n_removed
FROM m GROUP BY doc_id"""
