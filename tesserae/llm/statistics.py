"""Statistics of texts as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.llm.common import WHITE, let, n_words, without_white

SYMBOLS = "#*$%&|<>"


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among ``characters``."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _covered(hashes: Column, window: int) -> Column:
    """Positions in windows whose hash stands twice or more in ``hashes``, one hash for each window start."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(pairs, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # each start covers ``window`` positions, less those that the start before it covers
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words in windows of ``window`` words that the text holds twice or more, the first included."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h, window)))

    return let(words, of)


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as long; all 0 for a null text."""
    from tesserae.llm.common import words

    body = F.coalesce(text, F.lit(""))
    return {
        "n_words": n_words(body),
        "word_chars": F.char_length(without_white(body)).cast("long"),
        "n_symbols": count_of(body, SYMBOLS).cast("long"),
        "n_dup_lines": dup_lines(body).cast("long"),
        "n_repeat_words": repeat_words(words(body)).cast("long"),
    }
