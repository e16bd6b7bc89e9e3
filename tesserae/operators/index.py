"""Tokens, postings and corpus statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = r"[\p{L}\p{N}]+"


def tokenize(text: Column, stop: Iterable[str] = ()) -> Column:
    """Lower-case runs of letters and digits, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    stop = list(stop)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


_RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+|[^\W_㐀-䶿一-鿿豈-﫿]+")
_WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}


def segment(text: str | None, words: frozenset[str], longest: int, smart: bool) -> list[str]:
    """Dictionary words of CJK runs, character pairs where there is none; other runs whole.

    ``smart`` takes the longest word at each place and goes on after it; otherwise every word counts.
    """
    out: list[str] = []
    for run in _RUN.findall((text or "").translate(_WIDE).lower()):
        if not "㐀" <= run[0] <= "﫿":
            out.append(run)
            continue
        at, free = 0, 0  # free: start of the part that no word covers
        def pairs(a: int, b: int) -> None:
            part = run[a:b]
            out.extend([part] if len(part) == 1 else [part[i : i + 2] for i in range(len(part) - 1)])
        covered = 0
        while at < len(run):
            found = [run[at : at + n] for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in words]
            if found:
                if free < at and covered <= free:
                    pairs(free, at)
                out.extend(found[:1] if smart else found)
                covered = max(covered, at + len(found[0]))
                at = at + len(found[0]) if smart else at + 1
                free = max(free, covered)
            else:
                at += 1
        if free < len(run):
            pairs(free, len(run))
    return out


def tokenize_udf(words: Iterable[str], stop: Iterable[str] = (), smart: bool = False):
    """A tokenizer with a user dictionary, as an Arrow UDF; full-width letters are folded first."""
    known = frozenset(w.translate(_WIDE).lower() for w in words)
    longest, drop = max(map(len, known), default=1), frozenset(stop)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for w in segment(t, known, longest, smart) if w not in drop])

    return run


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _reduced(tokens: Column, positions: bool) -> Column:
    """Tokens in order -> an array with one (term, tf, positions) for each distinct token, by sorting them in the row."""

    def runs(by_term: Column) -> Column:
        starts = F.filter(F.transform(by_term, lambda x, i: F.when((i > 0) & (F.get(by_term, i - 1)["t"] == x["t"]), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())

        def one(all_starts: Column, at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(all_starts, k + 1), F.size(by_term)) - at
            where = [F.transform(F.slice(by_term, at + 1, n), lambda x: x["i"]).alias("positions")] if positions else []
            return F.struct(F.get(by_term, at)["t"].alias("term"), n.cast("long").alias("tf"), *where)

        return _let(starts, lambda all_starts: F.transform(all_starts, lambda at, k: one(all_starts, at, k)))

    return _let(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), runs)


def build_postings(docs: DataFrame, fields: dict[str, Column], key: str = "_id", positions: bool = True, first: str | None = None) -> DataFrame:
    """(field, term, key, tf, len, positions) of tokenised ``fields``; one row per field, term and document.

    Tokens of one document are reduced in its own row, so nothing is shuffled here. ``first`` names a column that is
    true on one row for each document and field.
    """
    each = docs.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("tokens")) for f, c in fields.items()])).alias("f"))
    rows = each.select(key, "f.field", F.size("f.tokens").alias("len"), F.posexplode(_reduced(F.col("f.tokens"), positions)).alias("no", "p"))
    marks = [(F.col("no") == 0).alias(first)] if first else []
    return rows.select("field", "p.term", key, "p.tf", "len", *(["p.positions"] if positions else []), *marks)


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(postings: DataFrame, first: str) -> DataFrame:
    """(field, n_docs, avg_len) over the documents that have a token in the field, from postings with a ``first`` mark."""
    return postings.where(F.col(first)).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, avg_len: Column, idf_: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
