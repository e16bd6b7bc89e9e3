"""Keyword retrieval: a table of queries against postings. Every step keeps (query_id, key, score) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.index import bm25, idf
from tesserae.sources.scratch import save

QUERY_CODE = r"^[PW]\d{3}$"


def is_code_query(query: Column, pattern: str = QUERY_CODE) -> Column:
    return F.upper(F.trim(query)).rlike(pattern)


def index_filter(df: DataFrame, pattern: str = "erp-*", column: str = "_index") -> DataFrame:
    """Rows of the indexes that a wildcard names; pushed down to the folders of a partitioned store."""
    return df.where(F.col(column).like(pattern.replace("\\", "\\\\").replace("_", r"\_").replace("%", r"\%").replace("*", "%")))


def term_filter(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def valid_queries(queries: DataFrame, longest: int = 1000, most: int = 100, default_k: int = 5, default_mode: str = "hybrid") -> DataFrame:
    """Defaults filled in; ``reject`` names the bound that a query breaks, or is null."""
    filled = queries.withColumn("mode", F.coalesce("mode", F.lit(default_mode))).withColumn("top_k", F.coalesce("top_k", F.lit(default_k)))
    why = F.when(F.col("query").isNull() | ~F.length("query").between(1, longest), "query length")
    return filled.withColumn("reject", why.when(~F.col("top_k").between(1, most), "top_k").when(~F.col("mode").isin("keyword", "vector", "hybrid"), "mode"))


def query_variants(queries: DataFrame, to_traditional, to_simplified, raw_boost: float = 1.0, other_boost: float = 0.8) -> DataFrame:
    """(query_id, variant, variant_boost): the stripped query and its conversions, without repeats.

    The full boost goes to a variant equal to the query as it came, so a padded query has none.
    """
    q = F.trim("query")
    each = queries.select("query_id", "query", F.explode(F.array_distinct(F.array(q, to_traditional(q), to_simplified(q)))).alias("variant"))
    return each.select("query_id", "variant", F.when(F.col("variant") == F.col("query"), raw_boost).otherwise(other_boost).alias("variant_boost"))


def query_terms(variants: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, variant, variant_boost, term, term_no) in the order of the text."""
    return variants.select("query_id", "variant", "variant_boost", F.posexplode(tokens).alias("term_no", "term"))


def scored_terms(terms: DataFrame, stats: DataFrame, fields: DataFrame) -> DataFrame:
    """The queries' terms, one row for each field that has them, with their idf and the field's average length."""
    wanted = terms.select("term").distinct().join(stats, "term").join(fields, "field")
    return terms.join(wanted.select("field", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len"), "term")


def postings_join(terms: DataFrame, postings: DataFrame, stats: DataFrame, fields: DataFrame) -> DataFrame:
    """Postings of the queries' terms, with their idf and the field's average length.

    Statistics are joined to the few terms of the queries first; the postings are then met once, on field and term.
    """
    return postings.join(scored_terms(terms, stats, fields), ["field", "term"])


def field_scores(hits: DataFrame, key: str = "_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, key, variant, variant_boost, by.., field, s, n): sum over terms and number of terms met, in one aggregation."""
    part = bm25(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("idf"))
    return hits.groupBy("query_id", key, "variant", "variant_boost", *by, "field").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("n"))


def best_fields(scores: DataFrame, boosts: dict[str, float], key: str = "_id") -> DataFrame:
    """Per variant the best field's boosted sum, times the variant's boost; variants add up."""
    boost = F.element_at(F.create_map(*[F.lit(x) for k, v in boosts.items() for x in (k, float(v))]), F.col("field"))
    best = scores.where(F.col("field").isin(list(boosts))).groupBy("query_id", key, "variant", "variant_boost").agg(F.max(F.col("s") * boost).alias("s"))
    return best.groupBy("query_id", key).agg(F.sum(F.col("s") * F.col("variant_boost")).alias("score"))


def match_fields(hits: DataFrame, boosts: dict[str, float], key: str = "_id") -> DataFrame:
    """best_fields: per variant the best field's boosted sum over terms, times the variant's boost; variants add up."""
    return best_fields(field_scores(hits.where(F.col("field").isin(list(boosts))), key), boosts, key)


def phrase_match(hits: DataFrame, boosts: dict[str, float], key: str = "_id", best: bool = False, whole: bool = True) -> DataFrame:
    """Documents that hold all terms of a query in a row, scored by the sum of idf and the phrase's count.

    Only documents that hold every term are expanded to positions, all if not ``whole``. ``best`` takes the best field, else fields add up.
    """
    mine = hits.where(F.col("field").isin(list(boosts)))
    count = Window.partitionBy("query_id", "variant", "field", key)
    n_terms = F.max("term_no").over(Window.partitionBy("query_id", "variant")) + 1
    full = mine.withColumn("_n", F.count(F.lit(1)).over(count)).withColumn("_want", F.col("n_terms") if "n_terms" in hits.columns else n_terms)
    full = full.where("_n = _want") if whole else full
    starts = full.select("query_id", "variant", "field", key, "term_no", "idf", "len", "avg_len", "_want", F.explode("positions").alias("p"))
    runs = starts.groupBy("query_id", "variant", "field", key, (F.col("p") - F.col("term_no")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("idf"), F.first("len").alias("len"), F.first("avg_len").alias("avg_len"), F.first("_want").alias("_want")).where("n = _want")
    phrase = runs.groupBy("query_id", "variant", "field", key).agg(F.count(F.lit(1)).alias("tf"), F.max("idf").alias("idf"), F.first("len").alias("len"), F.first("avg_len").alias("avg_len"))
    boost = F.element_at(F.create_map(*[F.lit(x) for k, v in boosts.items() for x in (k, float(v))]), F.col("field"))
    scored = phrase.select("query_id", key, "variant", "field", (boost * bm25(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("idf"))).alias("s"))
    if best:
        scored = scored.groupBy("query_id", key, "variant").agg(F.max("s").alias("s"))
    return scored.groupBy("query_id", key).agg(F.sum("s").alias("score"))


def exact_term(wanted: DataFrame, docs: DataFrame, column: str, boost: float, n_docs: Column | int, key: str = "_id", normalize=None) -> DataFrame:
    """(query_id, value) against a keyword or array column: boost * idf for the documents that have the value.

    ``normalize`` is applied to both sides where the column is normalised, as the status is.
    """
    kind, norm = docs.schema[column].dataType, normalize or (lambda c: c)
    value = F.explode(F.array_distinct(column)) if isinstance(kind, T.ArrayType) else F.col(column)
    having = docs.select(key, value.alias("value")).where("value is not null").select(key, norm(F.col("value")).alias("value"))
    hit = wanted.select("query_id", norm(F.col("value")).alias("value")).distinct().join(having, "value")
    df = hit.groupBy("value").agg(F.countDistinct(key).alias("df"))
    return hit.join(df, "value").select("query_id", key, (F.lit(float(boost)) * idf(F.lit(n_docs), F.col("df"))).alias("score"))


def bool_should(*clauses: DataFrame, key: str = "_id") -> DataFrame:
    """Sum of the clauses that match; a document that none matches has no row."""
    rows = reduce(lambda a, b: a.unionByName(b), [c.select("query_id", key, "score") for c in clauses])
    return rows.groupBy("query_id", key).agg(F.sum("score").alias("score"))


def top_k_per_query(hits: DataFrame, k: Column | int, key: str = "_id", digits: int | None = None) -> DataFrame:
    """The k best of each query with their ``rank`` from 1; ties by key. Spark keeps k a task before it shuffles.

    Scores that agree to ``digits`` places are ties: sums of the same parts differ in their last bits by the order of adding.
    """
    score = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("query_id").orderBy(score.desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dedupe_first(hits: DataFrame, key: str = "_id") -> DataFrame:
    """The best row of each document in each query."""
    return hits.groupBy("query_id", key).agg(F.max("score").alias("score"))


def dedupe_best(hits: DataFrame, by: Column, key: str = "_id", digits: int | None = None) -> DataFrame:
    """The best hit of each query and ``by`` value, else of each document; ties, to ``digits`` places if given, by key."""
    score = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy("query_id", "_by").orderBy(score.desc(), F.col(key))
    return hits.withColumn("_by", F.coalesce(by.cast("string"), F.col(key).cast("string"))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_by", "_rn")


def hybrid_join(keyword: DataFrame, nearest: DataFrame, keyword_weight: float = 0.6, vector_weight: float = 0.4, key: str = "_id") -> DataFrame:
    """Weighted sum over hits of either side."""
    a = keyword.select("query_id", key, F.col("score").alias("_k"))
    b = nearest.select("query_id", key, F.col("score").alias("_v"))
    joined = a.join(b, ["query_id", key], "full_outer")
    zero = F.lit(0.0)
    return joined.select("query_id", key, (keyword_weight * F.coalesce("_k", zero) + vector_weight * F.coalesce("_v", zero)).alias("score"))


#: Words up to the first length are keyed by what two deletions leave, up to the second by what one leaves of a half, longer ones by segments.
_SHORT, _MIDDLE, _SEGMENTS = 8, 32, 5


def _swaps(word: Column) -> Column:
    """The word with each two different neighbours exchanged."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    one = lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2))
    return F.filter(F.transform(at, one), lambda w: (w != word) & (F.length(w) == F.length(word)))


def edits(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance where it is at most 2, else 3 or more, by Spark's functions.

    Plain edits are Spark's own distance. A swap of neighbours is one edit; beside one of them there may be a plain edit, before
    or after it, or another swap. A swap may also stand across a character that comes or goes between the two (``_across``).
    """
    plain = F.levenshtein(a, b, 4)
    far = F.when(plain < 0, 3).otherwise(plain)
    one = F.exists(_swaps(a), lambda w: w == b)
    # a swap and one more edit, in either order, next to each other or apart
    two = F.exists(_swaps(a), lambda w: F.coalesce(F.levenshtein(w, b, 1), F.lit(-1)) >= 0) | F.exists(_swaps(b), lambda w: F.coalesce(F.levenshtein(w, a, 1), F.lit(-1)) >= 0)
    both = F.coalesce(F.arrays_overlap(_swaps(a), _swaps(b)), F.lit(False))
    return F.when(far <= 1, far).when(one, 1).when(far == 2, 2).when(two | both | _across(a, b) | _across(b, a), 2).otherwise(3)


def _others(a: Column, b: Column) -> Column:
    """How many characters of a are nowhere in b."""
    return F.length(F.call_function("translate", a, b, F.lit("")))


def _across(a: Column, b: Column) -> Column:
    """Whether b is a with neighbours xy replaced by y, any character, x."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    fits = lambda i: (F.substr(a, F.lit(1), i - 1) == F.substr(b, F.lit(1), i - 1)) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 2, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, i + 2) == F.substr(b, i + 3))
    return (F.length(b) == F.length(a) + 1) & (F.length(a) >= 2) & F.exists(at, fits)


def _deletion_keys(word: Column, most: Column) -> Column:
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    one, none = cut(word), F.array().cast("array<string>")
    two = F.flatten(F.transform(one, cut))
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, one).otherwise(none), F.when(most >= 2, two).otherwise(none)))


def _half_keys(word: Column, sizes: Column, spread: int) -> Column:
    """Names of halves and what at most one deletion leaves of them: of the first and last ``size`` characters, or up to ``spread`` more or fewer."""

    def of(side: str, size: Column, more: int) -> Column:
        part = F.left(word, size + more) if side == "l" else F.right(word, size + more)
        named = lambda w: F.concat_ws(":", F.lit(side), size.cast("string"), w)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), lambda i: named(F.concat(F.substr(part, F.lit(1), i - 1), F.substr(part, i + 1))))
        return F.concat(F.array(named(part)), cut)

    each = F.transform(sizes, lambda n: F.concat(*[of(side, n, d) for side in "lr" for d in range(-spread, spread + 1)]))
    return F.array_distinct(F.flatten(each))


def _segment_keys(word: Column, length: Column, shift: int) -> Column:
    """Names and texts of the segments that a word of ``length`` has, taken from ``word`` at ``shift`` from their place."""
    bound = lambda i: F.floor(length * i / _SEGMENTS).cast("int")
    key = lambda i: F.concat_ws(":", length.cast("string"), F.lit(str(i)), F.substr(word, bound(i) + 1 + shift, bound(i + 1) - bound(i)))
    return F.array(*[F.when(bound(i) + shift >= 0, key(i)) for i in range(_SEGMENTS)])


def fuzzy_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_term, term, edits): words of the vocabulary within 0, 1 or 2 edits by the query term's length (to 2, to 5, more).

    Only words of about the length of a query term get keys. Short words that are close agree after at most that
    many characters are deleted from each, so what is left after deletions are the keys of an equi-join. Of longer words
    one half has at most one edit, or a swap's one side, so what one deletion leaves of a half is a key. Two edits,
    swaps of neighbours included, leave one of five segments of a very long word whole and at most two places away, so
    these are its keys; their number doesn't grow with the word. ``edits``, a column of Spark's functions, decides.
    """
    allowed = F.when(F.length("query_term") <= 2, 0).when(F.length("query_term") <= 5, 1).otherwise(2)
    left = save(terms.select("query_term").distinct().withColumns({"most": allowed, "n": F.length("query_term")}), "terms")
    lengths = left.select(F.explode(F.sequence(F.col("n") - F.col("most"), F.col("n") + F.col("most"))).alias("m")).distinct()
    words = vocabulary.select("term").distinct().withColumn("m", F.length("term")).join(lengths, "m", "left_semi")
    # a shorter word is far from a query term of another allowance by its length already, so it needs fewer deletions
    most = F.when(F.col("m") >= 6, 2).when(F.col("m") >= 3, 1).otherwise(0)
    short = words.where(F.col("m") <= _SHORT + 2).select("term", F.explode(_deletion_keys(F.col("term"), most)).alias("key"))
    asked = left.where(F.col("n") <= _SHORT).select("query_term", "most", F.explode(_deletion_keys(F.col("query_term"), F.col("most"))).alias("key"))
    half = lambda n: F.floor(n / 2).cast("int")
    middle = words.where(F.col("m").between(_SHORT - 1, _MIDDLE + 2)).select("term", F.explode(_half_keys(F.col("term"), F.array_distinct(F.array(half(F.col("m")), F.col("m") - half(F.col("m")))), 0)).alias("key"))
    sizes = F.array_distinct(F.transform(F.sequence(F.col("n") - 2, F.col("n") + 3), half))  # halves, the larger ones too, of words of such lengths
    asked_middle = left.where(F.col("n").between(_SHORT + 1, _MIDDLE)).select("query_term", "most", F.explode(_half_keys(F.col("query_term"), sizes, 1)).alias("key"))
    long = words.where(F.col("m") > _MIDDLE - 2).select("term", F.explode(_segment_keys(F.col("term"), F.col("m"), 0)).alias("key"))
    shifted = F.flatten(F.array(*[_segment_keys(F.col("query_term"), F.col("n") + F.lit(d), s) for d in range(-2, 3) for s in range(-2, 3)]))
    asked_long = left.where(F.col("n") > _MIDDLE).select("query_term", "most", F.explode(F.filter(shifted, lambda k: k.isNotNull())).alias("key"))
    met = asked.join(short, "key").unionByName(asked_middle.join(middle, "key")).unionByName(asked_long.join(long, "key")).select("query_term", "most", "term")
    near = save(met.where(F.abs(F.length("query_term") - F.length("term")) <= F.col("most")).distinct(), "near")
    exact = near.where("query_term = term").select("query_term", "term", F.lit(0).alias("edits"))
    far, a, b = F.levenshtein("query_term", "term", 4), F.col("query_term"), F.col("term")
    # two plain edits stand for a swap at most twice, so what is farther than four has no chance; farther than two, there is
    # a swap, so that at most one character of each word is not in the other
    alike = (_others(a, b) <= 1) & (_others(b, a) <= 1)
    likely = near.where((a != b) & (F.col("most") > 0) & (far >= 0) & ((far <= F.col("most")) | alike))
    found = F.filter(F.array(edits(a, b)), lambda e: e <= F.col("most"))  # evaluated once a pair
    return exact.unionByName(likely.select("query_term", "term", F.explode(found).alias("edits")))
