"""Language ID by unigram pieces with the segmentation summed out.

Pieces are those of a fixed public vocabulary, all of them. A language gives each piece a probability; a
word's probability is the sum over all its segmentations, which the forward algorithm gets in one pass.
Probabilities are fitted by expectation-maximisation on the word counts of a bounded sample of labelled rows,
until the likelihood hardly grows: expected piece counts are summed in Spark, and only the table of pieces by
languages, whose size the vocabulary bounds, comes back. Scoring adds up the log-probabilities of a text's words.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import held_out, save, words

UNKNOWN = 1e-7  # of a character that is no piece, in any language
_BATCHED = 32  # words up to this length are summed many at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=2)
def vocabulary(name: str) -> tuple[str, ...]:
    """The pieces of a SentencePiece model, lower case, in order."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return tuple(sorted({p.lower() for p in plain if p}))


def word_key(word: str) -> str:
    return "▁" + word


class Lattice:
    """The pieces that cover words, as arcs for the forward algorithm."""

    def __init__(self, pieces: tuple[str, ...]):
        self.pieces, self.ids = pieces, {p: i for i, p in enumerate(pieces)}
        self.max_piece = max(map(len, pieces), default=1)
        known: dict[int, int] = {}  # of each beginning of a piece, the piece that it is itself, if any
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, len(pieces))
            known[h] = i
        self.prefixes = np.array(sorted(known), np.uint64)
        self.piece_of = np.array([known[h] for h in sorted(known)], np.int64)

    def arcs(self, same_length: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> for each word the id of the piece there; len(pieces) if none, +1 for an unknown character."""
        n, m = len(same_length[0]), len(same_length)
        codes = np.frombuffer("".join(same_length).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64) + np.uint64(1)
        none, out = len(self.pieces), {}
        with np.errstate(over="ignore"):
            for i in range(n):
                at, h = np.arange(m), np.zeros(m, np.uint64)  # the words whose characters from i on begin a piece
                for j in range(i + 1, min(n, i + self.max_piece) + 1):
                    h = h * _BASE + codes[at, j - 1]
                    place = np.minimum(np.searchsorted(self.prefixes, h), len(self.prefixes) - 1)
                    alive = self.prefixes[place] == h
                    at, h = at[alive], h[alive]
                    ids = np.full(m, none)
                    ids[at] = self.piece_of[place[alive]]
                    if j == i + 1:
                        ids[ids == none] = none + 1
                    if j == i + 1 or (ids != none).any():
                        out[i, j] = ids
                    if not len(at):
                        break
        return out

    def table(self, probs: np.ndarray) -> np.ndarray:
        """Rows for no piece and for an unknown character added."""
        return np.vstack([probs, np.zeros((1, probs.shape[1])), np.full((1, probs.shape[1]), UNKNOWN)])

    def forward(self, arcs, n: int, table: np.ndarray) -> list[np.ndarray]:
        m = len(next(iter(arcs.values())))
        alpha = [np.ones((m, table.shape[1])), *(np.zeros((m, table.shape[1])) for _ in range(n))]
        for (i, j), ids in sorted(arcs.items(), key=lambda x: x[0][1]):
            alpha[j] += alpha[i] * table[ids]
        return alpha

    def log_probs(self, many: list[str], table: np.ndarray) -> np.ndarray:
        """log p of each word (as ``word_key`` has it) in each language."""
        out = np.zeros((len(many), table.shape[1]))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(many):
            if len(w) > _BATCHED:
                out[k] = self._long(w, table)
            else:
                by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            out[at] = np.log(self.forward(self.arcs([many[k] for k in at]), n, table)[n])
        return out

    def _long(self, word: str, table: np.ndarray) -> np.ndarray:
        """The same sum for one word of any length, scaled at each character."""
        alpha, scale, none = [np.ones(table.shape[1])], np.zeros(table.shape[1]), len(self.pieces)
        for j in range(1, len(word) + 1):
            now = np.zeros(table.shape[1])
            for i in range(max(0, j - self.max_piece), j):
                if (k := self.ids.get(word[i:j], none + (j == i + 1))) != none:
                    now = now + alpha[i - j] * table[k]
            alpha = [a / now for a in alpha[-self.max_piece :]] + [np.ones_like(now)]
            scale += np.log(now)
        return scale

    def expected(self, many: list[str], counts: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of the pieces in one language, and the words' log-likelihood."""
        table, total, likelihood = self.table(probs[:, None]), np.zeros(len(self.pieces) + 2), 0.0
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(many):
            if len(w) <= _BATCHED:
                by_length.setdefault(len(w), []).append(k)
            else:
                likelihood += counts[k] * self._expected_long(w, counts[k], table[:, 0].tolist(), total)
        for n, at in by_length.items():
            arcs, weight = self.arcs([many[k] for k in at]), counts[at]
            alpha = self.forward(arcs, n, table)
            beta = [np.zeros((len(at), 1)) for _ in range(n)] + [np.ones((len(at), 1))]
            for (i, j), ids in sorted(arcs.items(), key=lambda x: -x[0][0]):
                beta[i] += beta[j] * table[ids]
            for (i, j), ids in arcs.items():
                np.add.at(total, ids, (alpha[i] * table[ids] * beta[j] / alpha[n])[:, 0] * weight)
            likelihood += float(weight @ np.log(alpha[n][:, 0]))
        return total[:-2], likelihood

    def _expected_long(self, word: str, count: float, table: list[float], total: np.ndarray) -> float:
        """Adds the expected counts of a word of any length to ``total``, by sums scaled at each character; its log-probability."""
        n, m, none = len(word), self.max_piece, len(self.pieces)
        arcs = [[(i, k) for i in range(max(0, j - m), j) if (k := self.ids.get(word[i:j], none + (j == i + 1))) != none] for j in range(n + 1)]
        # alpha[j] is the sum up to j over the product of the scales up to j; a piece over several characters is scaled by those it spans
        alpha, scale, log_p = [1.0] + [0.0] * n, [1.0] * (n + 1), 0.0
        span = lambda i, j: math.prod(scale[i + 1 : j + 1])
        for j in range(1, n + 1):
            now = sum(alpha[i] * table[k] / span(i, j - 1) for i, k in arcs[j])
            alpha[j], scale[j] = 1.0, now
            log_p += math.log(now)
        beta = [0.0] * n + [1.0]
        for j in range(n, 0, -1):
            for i, k in arcs[j]:
                part = table[k] * beta[j] / span(i, j)
                beta[i] += part
                total[k] += count * alpha[i] * part
        return log_p


def _expect(pieces: tuple[str, ...], langs: list[str], probs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, total, likelihood = Lattice(pieces), np.zeros_like(probs), 0.0
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                k = langs.index(lang)
                for at in range(0, len(part), 20_000):
                    some = part.iloc[at : at + 20_000]
                    found, log_p = lattice.expected([word_key(w) for w in some["word"]], some["n"].to_numpy(float), probs[:, k])
                    total[:, k] += found
                    likelihood += log_p
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": np.append(piece, -1), "lang": np.append(lang, 0), "n": np.append(total[piece, lang], likelihood)})

    return run


class LanguageModel:
    """Piece probabilities, one column for each language."""

    def __init__(self, langs: list[str], pieces: tuple[str, ...], probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, pieces, probs

    def score(self, texts: Iterator[list[str | None]]) -> Iterator[list[tuple[str, float]]]:
        """(language, posterior under equal priors) of each text; ('und', 0.0) without a letter."""
        lattice = Lattice(self.pieces)
        table, known, logs = lattice.table(self.probs), {}, np.zeros((0, len(self.langs)))
        for batch in texts:
            out = []
            for at, split in _by_words(batch, 200_000):
                todo = list({w for ws in split for w in ws} - known.keys())
                fresh = lattice.log_probs([word_key(w) for w in todo], table)
                if len(known) + len(todo) > _CACHE:  # start anew; the words of this part are looked up again
                    known, logs = {}, np.zeros((0, len(self.langs)))
                    todo = list({w for ws in split for w in ws})
                    fresh = lattice.log_probs([word_key(w) for w in todo], table)
                known.update(zip(todo, range(len(known), len(known) + len(todo))))
                logs = np.vstack([logs, fresh])
                for text, ws in zip(batch[at : at + len(split)], split):
                    if not ws or not any(m.group().isalpha() or any(map(str.isalpha, m.group())) for m in _LETTERS.finditer(text)):
                        out.append(("und", 0.0))
                        continue
                    total = logs[[known[w] for w in ws]].sum(axis=0)
                    best = int(total.argmax())
                    out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
            yield out


def _by_words(texts: list[str | None], most: int) -> Iterator[tuple[int, list[list[str]]]]:
    """Parts of the texts, split into words, of about ``most`` words each: (index of the first, words of each)."""
    start, part, n = 0, [], 0
    for i, t in enumerate(texts):
        part.append((t or "").lower().split())
        n += len(part[-1])
        if n >= most:
            yield start, part
            start, part, n = i + 1, [], 0
    if part:
        yield start, part


def train(docs: DataFrame, name: str = "piece_bpe_32k", max_train: int = 2000, settled: float = 2e-3, smooth: float = 0.01, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fit on rows that aren't held out and have a text and a language; None if there is no such row.

    At most about ``max_train`` rows a language are used, chosen by a hash of the id. Steps end when one raises the
    log-likelihood by less than ``settled`` of it; as no step lowers it and it is below zero, there is such a step.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs, pieces = sorted(counts), vocabulary(name)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_train / counts[k]))]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < rate * 1_000_000)
    table = save(sample.select("lang", F.explode(words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    probs = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    before = -math.inf
    while True:
        summed = table.mapInPandas(_expect(pieces, langs, probs), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        now, found = float(summed.loc[summed["piece"] < 0, "n"].sum()), summed[summed["piece"] >= 0]
        probs = np.full_like(probs, smooth)
        probs[found["piece"], found["lang"]] += found["n"]
        probs /= probs.sum(axis=0)
        if now - before <= settled * -now:
            return LanguageModel(langs, pieces, probs)
        before = now


def predict(spark: SparkSession, model: LanguageModel | None, text: Column) -> Column:
    """struct(lang_pred string, score double); ``und`` with score 0 for a null text, one without a letter, or no model.

    Texts alike are scored alike, whatever rows they stand on; an empty table gives no rows. Of languages that score the
    same the first by name leads. A text of any length is scored whole, a very long word by sums scaled as they grow.
    """
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for found in shared.value.score(s.tolist() for s in batches):
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return run(text)
