"""Best-fit packing with swap-based local search.

Documents are tokenised in place and cut only where they are longer than a sequence; what goes on is one
short row per piece. Full pieces are sequences of their own. The others are dealt by hash into bounded
groups, each packed in a task: best fit in order of falling length, then local search between underfull
bins - moves, one-for-one, two-for-one and one-for-two exchanges that raise the sum of squared fills - until
the bins are as few as their sizes allow or no exchange between any two of them gains. The pieces of the bins
that are still open then meet those of other groups in further rounds, each of at most half as many rows as
the last, until they are one group. Where over half of the pieces of a round are still in open bins, their sizes hardly fit
each other and no further round is made, as rounds might not end: of six groups of 2,000 pieces with three
laws of sizes that leaves 5,772 bins in place of 5,768, 6,022 of 6,010 and 1,237 of 1,236.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import save

END = 2

#: A run of white space beyond this goes to the JSON file's tokenizer: the pattern of the ranks overflows its stack between 0.7 and 1 million.
LONG_RUN = 100_000


@functools.lru_cache(maxsize=2)
def encoder(name: str):
    """Text to ids by the ranks of a byte-level BPE vocabulary; the strings of special tokens are ordinary text.

    The ranks are the vocabulary of the JSON file of the same name and give the same ids several times faster.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=2)
def _json_tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.lru_cache(maxsize=2)
def exact_encoder(name: str):
    """Text to the ids of the vocabulary's JSON file, in which an added token is one id.

    The ranks give these ids for all texts but two kinds, which the JSON file's tokenizer takes itself: those that
    hold the string of an added token, and those with a run of white space over ``LONG_RUN``.
    """
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    fast = encoder(name)

    def encode(text: str) -> list[int]:
        special = any(t in text for t in added)
        if special or len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in re.finditer(r"\s+", text)):
            return _json_tokenizer(name).encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def pieces(ids: np.ndarray, room: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the ids); only ids beyond ``room`` are cut, and only the first piece may be short."""
    first = len(ids) % room or room
    starts = [0, *range(first, len(ids), room)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(starts, [*starts[1:], len(ids)])]


def _cut(room: int, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = exact_encoder(vocabulary)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*encode(text or ""), END], "<u4")
                rows += [(doc, i, a, n, crc) for i, (a, n, crc) in enumerate(pieces(ids, room))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return run


def _lowest(mask: int, at_least: int) -> int:
    """The lowest set bit of ``mask`` from ``at_least`` on; -1 if there is none."""
    mask = mask >> at_least << at_least
    return (mask & -mask).bit_length() - 1


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins, as lists of indexes into ``sizes``: each item, the longest first, goes where it leaves least space."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        space = _lowest(mask, sizes[i])
        if space < 0:
            b, space = len(bins), room
            bins.append([])
        else:
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        bins[b].append(i)
        if space := space - sizes[i]:
            by_space[space].append(b)
            mask |= 1 << space
    return bins


class _Underfull:
    """The bins with space left, by that space, and what each holds as bit masks: its sizes and its sums of two sizes."""

    def __init__(self, bins: list[list[int]], sizes: list[int], room: int):
        self.bins, self.sizes, self.room = bins, sizes, room
        self.space = [room - sum(sizes[i] for i in b) for b in bins]
        self.one, self.two = [0] * len(bins), [0] * len(bins)
        self.members: dict[int, set[int]] = {}
        self.held: dict[int, tuple[int, int]] = {}  # of all members: sizes, and sizes or sums of two; bit 0 is for nothing
        for b in range(len(bins)):
            self.enter(b)

    def measure(self, b: int) -> None:
        one = twice = two = 0
        for i in self.bins[b]:
            bit = 1 << self.sizes[i]
            twice |= one & bit
            one |= bit
        for s in {self.sizes[i] for i in self.bins[b]}:
            two |= (one if twice >> s & 1 else one & ~(1 << s)) << s
        self.one[b], self.two[b] = one, two & ((2 << self.room) - 1)

    def enter(self, b: int) -> None:
        if 0 < self.space[b] < self.room:
            self.measure(b)
            self.members.setdefault(self.space[b], set()).add(b)
            one, any_ = self.held.get(self.space[b], (1, 1))
            self.held[self.space[b]] = (one | self.one[b], any_ | self.one[b] | self.two[b])

    def leave(self, b: int) -> None:
        s = self.space[b]
        if b not in self.members.get(s, ()):
            return
        self.members[s].discard(b)
        one = any_ = 1
        for o in self.members[s]:
            one, any_ = one | self.one[o], any_ | self.one[o] | self.two[o]
        self.held[s] = (one, any_)
        if not self.members[s]:
            del self.members[s], self.held[s]

    def exchange(self, a: int) -> tuple[int, tuple[int, ...], int, tuple[int, ...]] | None:
        """(gain, what ``a`` gives, the bin that takes it, what it gives back): the most that a bin can gain from ``a``.

        One is given for nothing, one or two, or two for one. Only exchanges that raise the sum of squared fills count:
        the bin that gains has room for it and is then fuller than ``a`` was.
        """
        gain, found = 0, None
        for space, (one, any_) in self.held.items():
            least = max(gain, space - self.space[a]) + 1
            for given, back, single in ((self.one[a], any_, True), (self.two[a], one, False)):
                while given and least <= space:
                    x = (given & -given).bit_length() - 1
                    given &= given - 1
                    at = max(0, x - space)
                    if fit := back >> at:  # the least that is large enough to make room
                        v = at + (fit & -fit).bit_length() - 1
                        if x - v >= least:
                            gain, found, least = x - v, (x, space, v, single), x - v + 1
        if not found:
            return None
        x, space, v, single = found
        gives = self.pick(a, x, single)
        for b in sorted(self.members[space]):
            if v == 0 or self.one[b] >> v & 1 or single and self.two[b] >> v & 1:
                return gain, gives, b, self.pick(b, v, v == 0 or bool(self.one[b] >> v & 1)) if v else ()
        raise AssertionError("masks name what no bin holds")

    def pick(self, b: int, total: int, single: bool) -> tuple[int, ...]:
        """One item, or two, of bin ``b`` that sum to ``total``."""
        if single:
            return (next(i for i in self.bins[b] if self.sizes[i] == total),)
        return next((i, j) for i, j in combinations(self.bins[b], 2) if self.sizes[i] + self.sizes[j] == total)


def local_search(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Exchange documents between underfull bins while the sum of squared fills grows; emptied bins go.

    The emptiest bins are emptied first, by the exchanges that gain most. Ends when the bins are as few as the
    sizes allow, or when no move, one-for-one, two-for-one or one-for-two exchange between any two bins gains.
    Each exchange raises a sum of bounded integers, so there is an end.
    """
    state = _Underfull([list(b) for b in bins], sizes, room)
    live = sum(map(bool, bins))
    fewest, changed = -(-sum(sizes[i] for b in bins for i in b) // room), True
    while changed and live > fewest:
        changed = False
        for a in sorted((b for group in state.members.values() for b in group), key=lambda b: (-state.space[b], b)):
            state.leave(a)
            while found := state.exchange(a):
                gain, gives, b, back = found
                state.leave(b)
                state.bins[b] = [i for i in state.bins[b] if i not in back] + list(gives)
                state.bins[a] = [i for i in state.bins[a] if i not in gives] + list(back)
                state.space[a], state.space[b], changed = state.space[a] + gain, state.space[b] - gain, True
                state.enter(b)
                state.measure(a)
            state.enter(a)
            if not state.bins[a]:
                live -= 1
                if live <= fewest:
                    break
    return [b for b in state.bins if b]


def pack(sizes: list[int], room: int) -> list[list[int]]:
    return local_search(best_fit(sizes, room), sizes, room)


_PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECE}, sequence_id long, offset long, fill long"


def _pack_group(room: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        sizes = pdf["length"].tolist()
        sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for members in pack(sizes, room):
            name, at = pdf["uid"][members[0]], 0
            for i in members:
                sequence[i], offset[i] = name, at
                at += sizes[i]
            fill[members] = at
        return pdf.drop(columns="group").assign(sequence_id=sequence, offset=offset, fill=fill)

    return run


def pack_documents(docs: DataFrame, room: int = 1024, vocabulary: str = "byte_bpe_50k", doc_id: str = "doc_id", text: str = "text", per_group: int = 8192) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids (``exact_encoder``) and an end id; a null text is an empty one, so it is the end id alone. Repeated
    rows and ids are packed like any other, texts of any length are cut whole, and pieces of equal length are packed in
    the order of a row number, so that ties don't matter. ``sequence_id`` is unique in the result, ``offset`` gapless
    from 0 in each sequence. An empty table gives no rows. Other columns are not read.
    """
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(_cut(room, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = save(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [cut.where(F.col("length") == room).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")}).select(*columns)]
    left = cut.where(F.col("length") < room)
    n, k = left.count(), 0
    while n:
        groups = -(-n // per_group)
        dealt = left.select("uid", "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(groups)).alias("group"))
        packed = save(dealt.groupBy("group").applyInPandas(_pack_group(room), _PACKED), f"packed{k}")
        still_open = packed.where(F.col("fill") < room).count()
        if groups == 1 or 2 * still_open > n:
            done.append(packed.select(*columns))
            break
        done.append(packed.where(F.col("fill") == room).select(*columns))
        left, n, k = packed.where(F.col("fill") < room), still_open, k + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
