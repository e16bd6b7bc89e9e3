"""Passages that stand in a document of smaller id, too, found by FM-indexes and removed.

A window is ``window`` consecutive words. Its anchor is the least hash among its short word groups, so equal windows
of two documents have the same anchor; consecutive windows of one anchor are a run. Anchors that only one text has,
and those whose neighbouring words agree with no other text, are dropped by counting; the runs of the others are dealt
by anchor into shards of bounded size. Each shard is an FM-index of its distinct runs, and the runs of all
documents are streamed through it: backward search gives, where a match is a window long, the interval of its
occurrences and the least document among them. Covered words go.

Equal word sequences are one text throughout, so copies cost a count. Runs are reduced to distinct ones before
they are dealt, and runs of an anchor that very many share are cut into single windows, dealt by their own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import save
from tesserae.llm.fm_index import FmIndex

#: Stands for a null id, which is larger than all.
_NO_ID = (1 << 63) - 1
GROUP = 5

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte at each of 64 places of a word; a word's hash is their sum.
_TABLE = np.random.default_rng(13).integers(0, 2**64, (64, 256), np.uint64).ravel()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, where it begins) of each word. Equal words have equal hashes; that is all that counts."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(~_WHITE[data])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.add.reduceat(_TABLE[((place & 63) << 8) + data[at]], first), at[first]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _groups(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return _mixed(out)


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x


class Runs:
    """Runs of windows of one anchor in texts that stand one after the other: anchor, first word, number of windows, text.

    ``texts`` are the texts' numbers of words; a run is of one text and of at most ``longest`` windows.
    """

    def __init__(self, h: np.ndarray, texts: np.ndarray, window: int, longest: int = 64):
        self.h, self.window = h, window
        self.begin = np.cumsum(texts) - texts
        self.end = self.begin + texts
        of = np.repeat(np.arange(len(texts)), texts)
        n = max(0, len(h) - window + 1)
        self.groups = _groups(h, GROUP)
        least = _least(self.groups, window - GROUP + 1) if n else np.zeros(0, np.uint64)
        good = of[:n] == of[window - 1 : window - 1 + n]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:n] != of[: n - 1]) | ~good[:-1]]) & good if n else good
        start = np.flatnonzero(new)
        stop = np.flatnonzero(np.concatenate([~good[1:] | new[1:], [True]]) & good) + 1 if n else start
        long = np.flatnonzero(stop - start > longest)
        if len(long):
            start = np.union1d(start, np.concatenate([np.arange(start[i], stop[i], longest) for i in long]))
            stop = np.minimum(np.append(start[1:], n), stop[np.searchsorted(stop, start, "right")])
        self.start, self.count, self.anchor, self.text = start, stop - start, least[start], of[start]

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, before, after) for each place of each run's anchor: hashes of the anchor with half of the rest of a window before, and after it.

        A window that two texts share holds one of the two. Where the text has no room on a side, its hash is 0.
        """
        half = (self.window - GROUP) // 2
        span = self.count + self.window - GROUP  # groups in the run's windows
        run = np.repeat(np.arange(len(span)), span)
        place = np.arange(len(run)) - np.repeat(np.cumsum(span) - span, span) + self.start[run]
        held = self.groups[place] == self.anchor[run]
        run, place = run[held], place[held]
        wide, of, none = _groups(self.h, GROUP + half), self.text[run], np.uint64(0)
        if not len(wide):
            return run, np.zeros(len(run), np.uint64), np.zeros(len(run), np.uint64)
        before = np.where(place - half >= self.begin[of], wide[np.maximum(place - half, 0)], none)
        after = np.where(place + GROUP + half <= self.end[of], wide[np.minimum(place, len(wide) - 1)] ^ np.uint64(1), none)
        return run, before, after


def _words(text: pa.Scalar) -> list[bytes]:
    return bytes(text.as_buffer()).split()  # of bytes: white space of ASCII only


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [_words(x) for x in batch.column(0)]
        sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([len(w) for w in words], pa.int64()), pa.array(sha, pa.binary()), pa.array([key_of(x) for x in sha], pa.int64())], ["doc", "text_hash", "n_words", "sha", "key"])


def _anchors(window: int, sides: bool, per_turn: int = 1 << 20):
    """(key, anchor) of each text's anchors, with 32 bits each of before and after if ``sides``; ``key`` stands for the sequence of words."""

    def rows_of(keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
        h, at = word_hashes(b"\n".join(texts))
        length = np.array([len(t) + 1 for t in texts], np.int64)
        bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum(length)]))
        runs, key = Runs(h, np.diff(bounds), window), np.array(keys, np.int64)
        if sides:
            run, before, after = runs.sides()
            both = (before & np.uint64(0xFFFFFFFF00000000)) | (after >> np.uint64(32))
            columns = [key[runs.text[run]], runs.anchor[run].view(np.int64), both.view(np.int64)]
        else:
            columns = [key[runs.text], runs.anchor.view(np.int64)]
        again = np.ones(max(0, len(columns[0]) - 1), bool)  # in texts of few words
        for c in columns:
            again &= c[1:] == c[:-1]
        stay = np.concatenate([np.ones(min(1, len(columns[0])), bool), ~again])
        return pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in columns], ["key", "anchor", "sides"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, held, seen = [], [], 0, set()
            for x in batch.column(0):
                words = _words(x)
                if len(words) < window:
                    continue
                joined = b" ".join(words)
                key = key_of(hashlib.sha256(joined).digest())
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(joined)
                    held += len(joined)
                if held >= per_turn:
                    yield rows_of(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield rows_of(keys, texts)

    return run


def _cut(window: int):
    """Runs of the anchors that stay, from (text, key, first, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, key, first, anchors in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                words, (h, _) = _words(x), word_hashes(bytes(x.as_buffer()))
                runs = Runs(h, np.array([len(h)]), window)
                anchor = runs.anchor.view(np.int64)
                stay = np.isin(anchor, anchors.values.to_numpy(zero_copy_only=False))
                for a, s, n in zip(anchor[stay].tolist(), runs.start[stay].tolist(), runs.count[stay].tolist()):
                    out.append((a, key, first, s, b" ".join(words[s : s + n + window - 1])))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "key", "first", "start", "content"])

    return run


def _single(window: int):
    """Runs cut into their windows, each under a hash of its own words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, first, start, content in zip(pdf["key"], pdf["first"], pdf["start"], pdf["content"]):
                words = content.split(b" ")
                for i in range(len(words) - window + 1):
                    c = b" ".join(words[i : i + window])
                    out.append((key_of(hashlib.blake2b(c, digest_size=8).digest()), key, first, start + i, c))
            yield pd.DataFrame(out, columns=["anchor", "key", "first", "start", "content"])

    return run


def _first_documents(window: int):
    """A shard: (anchor, content, first) -> (anchor, content_hash, firsts): for each window of the content, the least document that has it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index = FmIndex([c.split(b" ") for c in pdf["content"]], pdf["first"].to_numpy(np.int64))
        begins = np.concatenate([[0], index.ends[:-1] + 1])
        count = index.ends - begins - window + 1
        last = np.repeat(begins + window - 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())
        length, low, high = index.match(index.text, last, window)
        assert (length == window).all()  # each finds itself at least
        found = index.least_value(low, high)
        return pd.DataFrame({"anchor": pdf["anchor"], "content_hash": pdf["content_hash"], "firsts": np.split(found, np.cumsum(count)[:-1])})

    return run


def _removed(window: int):
    """(key, n_removed, kept_sha256, kept) from (text, key, starts of the windows that go)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, key, starts in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                words = _words(x)
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g)
                out.append((key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["key", "n_removed", "kept_sha256", "kept"])

    return run


def _shared(rows: DataFrame, column: str) -> DataFrame:
    """The values of ``column`` that texts of more than one key have."""
    spread = rows.groupBy(column).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return spread.where("low < high").select(column)


def dedup_passages(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", per_shard: int = 16384, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept.

    Each word that a window covers whose words also start in a document of smaller id is removed; ``kept`` is the rest,
    joined by a space, where words were removed, and null where the text's words all stay. Repeats within
    a document stay, and so do those among rows of one id. A null id is larger than all others. A null text has no word; texts
    shorter than a window lose nothing; long ones are taken whole; an empty table gives no rows. Other columns are not
    read. Two texts that share a window would be missed only if their keys, 64 bits of a SHA-256, were equal.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc")
    rows = docs.select(body, doc, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    marks = save(rows.mapInArrow(_marks, "doc long, text_hash long, n_words long, sha binary, key long"), "marks")
    groups = marks.groupBy("sha", "key").agg(F.min(F.struct("doc", "text_hash")).alias("place"))
    groups = save(groups.select("sha", "key", F.col("place.doc").alias("first"), F.col("place.text_hash").alias("text_hash")), "texts")

    anchors = rows.select("text").mapInArrow(_anchors(window, False), "key long, anchor long")
    sides = rows.select("text").mapInArrow(_anchors(window, True), "key long, anchor long, sides long")
    likely = save(sides.join(_shared(anchors, "anchor"), "anchor", "left_semi"), "likely")
    before, after = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(0xFFFFFFFF)
    named = F.transform(F.filter(F.array(F.struct(before.alias("x"), F.lit(0).alias("n")), F.struct(after.alias("x"), F.lit(1).alias("n"))), lambda s: s["x"] != 0), lambda s: F.xxhash64("anchor", s["x"], s["n"]))
    sided = likely.select("key", "anchor", F.explode(named).alias("side"))
    sure = sided.join(_shared(sided, "side"), "side", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))  # of one text
    sure = save(sure.join(groups.select("key", "first", "text_hash"), "key"), "sure")
    if (n := sure.count()) == 0:
        return _result(marks, groups, None, window)
    same = ["doc", "text_hash"]
    wanted = sure.select(F.col("first").alias("doc"), "text_hash", "key", "first", "anchors")
    some = rows.join(F.broadcast(wanted.select(*same)), same, "left_semi") if n <= broadcast_ids else rows
    texts = save(some.join(wanted.hint("merge"), same).select("text", "key", "first", "anchors"), "passages")

    schema = "anchor long, key long, first long, start int, content binary"
    runs = save(texts.mapInArrow(_cut(window), schema), "runs")
    distinct = runs.groupBy("anchor", "content").agg(F.min("first").alias("first"))
    counts = save(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_shard).select("anchor"), "frequent")
    if not counts.isEmpty():
        single = runs.join(counts, "anchor", "left_semi").select("key", "first", "start", "content").mapInPandas(_single(window), schema)
        runs = save(runs.join(counts, "anchor", "left_anti").unionByName(single), "runs")
        distinct = runs.groupBy("anchor", "content").agg(F.min("first").alias("first"))
    shards = max(1, -(-runs.count() // per_shard))
    dealt = distinct.withColumn("content_hash", F.xxhash64("content")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    firsts = save(dealt.groupBy("shard").applyInPandas(_first_documents(window), "anchor long, content_hash long, firsts array<long>"), "firsts")
    met = runs.select("key", "first", "start", "anchor", F.xxhash64("content").alias("content_hash")).join(firsts, ["anchor", "content_hash"])
    gone = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("first"), F.col("start") + i)), lambda s: s.isNotNull())
    gone = met.select("key", gone.alias("starts")).where(F.size("starts") > 0).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # of one text
    removed = texts.select("text", "key").join(gone, "key").select("text", "key", "starts").mapInArrow(_removed(window), "key long, n_removed long, kept_sha256 string, kept string")
    return _result(marks, groups, save(removed.dropDuplicates(["key"]), "removed"), window)


def _result(marks: DataFrame, groups: DataFrame, removed: DataFrame | None, window: int) -> DataFrame:
    """A text's first document loses what was found; later ones, of which every window starts in the first, all their words."""
    of = groups.select("sha", "key", "first")
    if removed is None:
        of = of.withColumns({"n_removed": F.lit(0).cast("long"), "kept_sha256": F.lit(None).cast("string"), "kept": F.lit(None).cast("string")})
    else:
        of = of.join(removed, "key", "left").select("sha", "key", "first", "n_removed", "kept_sha256", "kept")
    joined = marks.join(of, "sha")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
    own = F.coalesce("kept_sha256", F.lower(F.hex("sha")))
    return joined.select(
        F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(own).alias("kept_sha256"), F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM w),
e AS (SELECT r, doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS g FROM i),
f AS (SELECT g, min(doc_id) AS first FROM e GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + 13)) AS p FROM e JOIN f USING (g) WHERE first < doc_id),
n AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
k AS (SELECT w.r, string_agg(x.word, ' ' ORDER BY x.p) AS kept FROM w, (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) x LEFT JOIN gone g ON g.r = x.r AND g.p = x.p WHERE w.r = x.r AND g.p IS NULL GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""
