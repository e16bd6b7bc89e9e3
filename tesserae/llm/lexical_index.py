"""Ranked lexical search over a length-stratified index.

Documents are dealt into shards of bounded size where they are read; no text is shuffled. Within a shard they are
sorted by their length normaliser ``m``, so documents of equal ``m``, a stratum, are a range of numbers, and the
postings of a term stand by stratum and, within it, by term frequency: all documents of one ``m`` and ``tf`` have
the same impact, which is computed once. A shard is one row for each of its terms and one row for its documents.

A search joins the terms of the items, in blocks of items, to the shards' rows by term. For each shard and block a
task takes the greatest impact of each term in each stratum as the stratum's bound, visits strata by falling bound
and stops where the bound falls below the k-th score; what it emits is k rows an item. Ties are kept until the
document's id decides, so the result is that of scoring all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import save

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: What ends a term becomes a space, A-Z their small letters; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Fixed values of the score: parts of a hundred of the normaliser that go with the length, its factor, the scale of an impact.
BY_LENGTH, SPREAD, SCALE = 75, 8, 1_000_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id, which comes last among ties.
_NO_ID = np.iinfo(np.int64).max


def terms(text: Column) -> Column:
    """The array of terms of a text, with repeats; empty for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    n = docs.select(F.coalesce(F.regexp_count(F.col(text), F.lit(TERM)), F.lit(0)).cast("long").alias("n")).where("n > 0")
    got = n.agg(F.count(F.lit(1)), F.sum("n")).first()
    return got[0], got[1] or 0


def normaliser(n, n_docs: int, n_terms: int):
    return 100 - BY_LENGTH + BY_LENGTH * n * n_docs // n_terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + SPREAD * m)


# --- the index ---------------------------------------------------------------------------------------------

_ROW = "shard long, term string, docs array<int>, tfs array<int>, ids array<long>"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def shard_rows(shard: int, ids: list[int], counts: list[Counter], n_docs: int, n_terms: int, per_batch: int = 65536) -> Iterator[pa.RecordBatch]:
    """A shard's rows: (term null; docs: each document's m; ids) and, by term, (docs, tfs) by stratum, tf and document."""
    m = np.array([normaliser(sum(c.values()), n_docs, n_terms) for c in counts], np.int64)
    order = np.argsort(m, kind="stable")
    m = m[order]
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    number, doc, tf = [], [], []
    for at, i in enumerate(order):
        c = counts[i]
        number.append(np.fromiter((vocabulary[t] for t in c), np.int64, len(c)))
        tf.append(np.fromiter(c.values(), np.int64, len(c)))
        doc.append(np.full(len(c), at, np.int32))
    number, doc, tf = (np.concatenate(x) for x in (number, doc, tf))
    names = list(vocabulary)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    stratum = np.cumsum(np.concatenate([[0], np.diff(m) != 0])).astype(np.int64)
    number = rank[number]
    by = np.lexsort((tf, number * (stratum[-1] + 1) + stratum[doc]))  # stable: then by document
    number, doc, tf = number[by], doc[by], tf[by].astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([m.tolist()], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())), pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))], schema=_ARROW)
    starts = np.searchsorted(number, np.arange(len(names) + 1))
    for a in range(0, len(names), per_batch):
        b = min(a + per_batch, len(names))
        cuts, some = starts[a : b + 1] - starts[a], slice(starts[a], starts[b])
        named = pa.array([names[by_name[i]] for i in range(a, b)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard)), named, _lists(doc[some], cuts), _lists(tf[some], cuts), pa.nulls(b - a, pa.list_(pa.int64()))], schema=_ARROW)


def _index(n_docs: int, n_terms: int, most_docs: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() + 1) << 32
        ids: list[int] = []
        counts: list[Counter] = []
        held = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = raw.as_buffer()
                if not text or not (c := Counter(bytes(text).translate(_FOLD).split())):
                    continue
                ids.append(_NO_ID if doc is None else doc)
                counts.append(c)
                held += len(text)
                if len(ids) >= most_docs or held >= most_bytes:
                    yield from shard_rows(shard, ids, counts, n_docs, n_terms)
                    shard, ids, counts, held = shard + 1, [], [], 0
        if ids:
            yield from shard_rows(shard, ids, counts, n_docs, n_terms)

    return run


class LexicalIndex:
    """An index as its table of rows and the two sizes of its corpus."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_docs: int = 8192, most_bytes: int = 1 << 25) -> LexicalIndex:
    """The index of all documents with a term; a shard ends at ``most_docs`` documents or ``most_bytes`` of text.

    Null, empty and term-less texts are in no shard and count nowhere. Repeated rows and ids are documents of their
    own. A text of any length is taken whole. Other columns are not read. An empty table gives an empty index.
    """
    n_docs, n_terms = corpus_size(docs, text)
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = save(raw.mapInArrow(_index(n_docs, n_terms, most_docs, most_bytes), _ROW), "lexical")
    return LexicalIndex(rows, n_docs, n_terms)


# --- search ------------------------------------------------------------------------------------------------


class Visit:
    """One shard's postings of the terms that a block of items asks for."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], weights: list[int]):
        """``postings``: (docs, tfs) of each term, by stratum, tf and document; ``ids``: of documents, by m."""
        self.ids, self.n = ids, len(m)
        stratum = np.cumsum(np.concatenate([[0], np.diff(m) != 0])).astype(np.int64)
        self.begins = np.flatnonzero(np.concatenate([[True], np.diff(m) != 0]))
        self.sizes = np.diff(np.append(self.begins, self.n))
        self.docs = np.concatenate([d for d, _ in postings])
        tf = np.concatenate([t for _, t in postings]).astype(np.int64)
        length = np.array([len(d) for d, _ in postings])
        term = np.repeat(np.arange(len(postings)), length)
        s = stratum[self.docs]
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (s[1:] != s[:-1])])
        run = np.flatnonzero(new | np.concatenate([[True], tf[1:] != tf[:-1]]))  # documents of one term, stratum and tf
        per_run = np.array(weights, np.int64)[term[run]] * impacts(tf[run], m[self.docs[run]].astype(np.int64))
        self.impact = np.repeat(per_run, np.diff(np.append(run, len(tf))))
        self.first = np.flatnonzero(new)  # of each term and stratum
        self.end = np.append(self.first[1:], len(tf))
        self.stratum = s[self.first]
        self.most = self.impact[self.end - 1]  # impacts rise with tf
        cuts = np.searchsorted(term[self.first], np.arange(len(postings) + 1))
        self.entries = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        self.score = np.zeros(self.n, np.int64)

    def best(self, asked: list[tuple[int, int]], k: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best documents for (term, times) pairs: by falling score, then id; scores above 0."""
        e = np.concatenate([np.arange(self.entries[t].start, self.entries[t].stop) for t, _ in asked])
        times = np.repeat(np.array([n for _, n in asked], np.int64), [self.entries[t].stop - self.entries[t].start for t, _ in asked])
        bound = np.zeros(len(self.begins), np.int64)
        np.add.at(bound, self.stratum[e], self.most[e] * times)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound)]
        upto = np.cumsum(self.sizes[order])
        ids, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        rank = np.full(len(self.begins), len(order))
        rank[order] = np.arange(len(order))
        due = rank[self.stratum[e]]
        by = np.argsort(due, kind="stable")
        e, times, due = e[by], times[by], due[by]
        while at < len(order) and (len(ids) < k or bound[order[at]] >= scores[k - 1]):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
            if len(ids) >= k:  # none below the k-th score; an equal one may have a smaller id
                stop = min(stop, int(np.searchsorted(-bound[order], -scores[k - 1], "right")))
            some = slice(np.searchsorted(due, at), np.searchsorted(due, stop))
            length = self.end[e[some]] - self.first[e[some]]
            ends = np.cumsum(length)
            place = np.repeat(self.first[e[some]] - ends + length, length) + np.arange(ends[-1])
            np.add.at(self.score, self.docs[place], self.impact[place] * np.repeat(times[some], length))
            seen = order[at:stop]
            size = self.sizes[seen]
            cut = np.cumsum(size)
            docs = np.repeat(self.begins[seen] - cut + size, size) + np.arange(cut[-1])
            found = self.score[docs]
            self.score[docs] = 0
            good = found > 0 if len(ids) < k else found >= max(1, scores[k - 1])
            ids, scores = np.concatenate([ids, self.ids[docs[good]]]), np.concatenate([scores, found[good]])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores, at, chunk = ids[top], scores[top], stop, 2 * chunk
        return ids, scores


def _visit(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["term"].isna()].iloc[0]
        pdf = pdf[pdf["term"].notna()]
        out = []
        if len(pdf):
            visit = Visit(np.asarray(held["docs"], np.int64), np.asarray(held["ids"], np.int64), [(np.asarray(d), np.asarray(t)) for d, t in zip(pdf["docs"], pdf["tfs"])], pdf["weight"].tolist())
            asked: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, asks in enumerate(pdf["asks"]):
                for a in asks:
                    asked[a["item"]].append((t, a["times"]))
            for item in sorted(asked):
                docs, scores = visit.best(asked[item], k)
                out += zip(repeat(item), docs.tolist(), scores.tolist())
        found = pd.DataFrame(out, columns=["item", "doc", "score"]).astype("int64")
        return pd.DataFrame({"item": found["item"], "doc_id": found["doc"].astype("Int64").mask(found["doc"] == _NO_ID), "score": found["score"]})

    return run


def search(index: LexicalIndex, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", per_block: int = 512, broadcast_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0; ties by id, null last.

    Each row of ``items`` is an item of its own, also where ids repeat or are null; null texts and those without a term
    find nothing. Items are taken in blocks of ``per_block``. Terms are broadcast up to ``broadcast_terms`` of
    them; beyond that Spark joins by term.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = save(asked.select("item_id", "item", F.explode(terms(F.col("text"))).alias("term")), "asked")
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-asked.select("item").distinct().count() // per_block))))
    each = asked.groupBy("term", "item").agg(F.count(F.lit(1)).alias("times"))
    wanted = save(each.withColumn("block", block).groupBy("term", "block").agg(F.collect_list(F.struct("item", "times")).alias("asks")), "wanted")
    side = (lambda df: F.broadcast(df)) if wanted.count() <= broadcast_terms else (lambda df: df)
    rows = index.rows.where(F.col("term").isNotNull())
    df = save(rows.join(side(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df")), "df")
    weight = F.floor(1000 * F.ln((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = wanted.join(df, "term").select("term", "block", weight.cast("long").alias("weight"), "asks")
    hits = rows.join(side(weighed), "term").select("shard", "block", "term", "docs", "tfs", "ids", "weight", "asks")
    blocks = wanted.select("block").distinct()
    held = index.rows.where(F.col("term").isNull()).withColumn("block", F.explode(F.array(*[F.lit(r[0]) for r in blocks.collect()]).cast("array<long>")))
    none = F.lit(None).cast(hits.schema["asks"].dataType)
    both = hits.unionByName(held.select("shard", "block", "term", "docs", "tfs", "ids", F.lit(None).cast("long").alias("weight"), none.alias("asks")))
    best = both.groupBy("shard", "block").applyInPandas(_visit(k), "item long, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
e AS (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
p AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM e GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, count(*)::BIGINT AS times, any_value(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))))::BIGINT AS weight FROM q JOIN f USING (term), s GROUP BY item_id, term),
r AS (SELECT item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score FROM w JOIN p USING (term), s GROUP BY item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row))::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) <= 10"""
