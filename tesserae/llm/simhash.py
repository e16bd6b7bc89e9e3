"""SimHash near-duplicates: fingerprints that differ in at most ``distance`` bits are linked.

Blocks: the 64 bits are split into ``b`` blocks. A close pair differs in at most ``distance`` of them, so it
agrees on some ``b - distance`` blocks: with one key for each choice of that many blocks, every close pair
shares a key. More blocks give longer keys and smaller blocks of rows; ``blocks_for`` takes the number from
the count of fingerprints, and any number finds the same pairs. Only distinct fingerprints are compared, so
copies cost nothing here. Keys are counted, and the fingerprints of a key that too many share - a large family
of near copies - are met again under longer keys; at 16 blocks a key leaves 16 bits free, which bounds its rows.
Rows that share a key stand together in one sorted run; Hamming distances are checked there, and a run emits
a spanning forest of its links rather than all pairs, so a large group of near copies stays linear in output.
Groups are the connected components of the links, found by randomised contraction: every node takes the least
of its neighbourhood under a hash, edges are renamed and shrink by a constant factor each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import save

_PART = 65536


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; 0 where it has no word."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and white space of ASCII, only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - shingle + 1)
    ends = starts[shingle:] if len(words) >= shingle else starts[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PART):
        h = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[at : at + _PART], ends[at : at + _PART])][: n - at], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint as long (the same 64 bits)."""
    return _fingerprints(text.cast("binary"))


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of ``blocks - distance`` of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(bits, blocks - distance)]


def blocks_for(n: int, distance: int, most: float = 32.0) -> int:
    """The fewest blocks for which ``n`` even fingerprints share their rarest key with at most ``most`` others."""
    for blocks in range(distance + 2, 65):
        bits = 64 * (blocks - distance) // blocks
        if n / 2.0**bits <= most:
            return blocks
    return 64


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def forest(fps: np.ndarray, distance: int, direct: int = 4096) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges, each a link, that connect what the links among distinct ``fps`` connect."""
    if len(fps) > direct:  # blocks again, of the bits that vary here
        varying = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [1 << i for i in range(64) if int(varying) >> i & 1]
        runs = []
        for k in range(distance + 1):
            mask = np.uint64(sum(bits[k :: distance + 1]))
            order = np.argsort(fps & mask, kind="stable")
            cuts = np.flatnonzero(np.diff((fps & mask)[order])) + 1
            runs += [fps[r] for r in np.split(order, cuts) if len(r) > 1]
        if max(map(len, runs), default=0) <= len(fps) // 2:
            return [e for run in runs for e in forest(run, distance, direct)]
    edges, rest = [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            node, front = front[0], front[1:]
            hit = _near(rest, node, distance)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                edges.append((np.full(len(found), node, np.uint64), found))
                front = np.concatenate([front, found])
    return edges


def _links_in_runs(key: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    start = np.concatenate([[0], cuts])
    length = np.diff(np.concatenate([start, [len(key)]]))
    edges = []
    short = np.repeat((length > 1) & (length <= 8), length)
    at = np.flatnonzero(short)
    for lag in range(1, 8):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        hit = at[_near(fps[at], fps[at + lag], distance)]
        edges.append((fps[hit], fps[hit + lag]))
    for i in np.flatnonzero(length > 8):
        edges += forest(fps[start[i] : start[i] + length[i]], distance)
    return edges


def _as_stars(edges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The same connections with every node tied to one node of its own."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for a, b in edges:
        for x, y in zip(a.tolist(), b.tolist()):
            if (x := root(x)) != (y := root(y)):
                above[max(x, y)] = min(x, y)
    return [(x, r) for x in list(above) if (r := root(x)) != x]


def _link_partition(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def work(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            edges = [e for e in _links_in_runs(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]), distance) if len(e[0])]
            if stars := _as_stars(edges):
                a, b = (np.array([s[i] for s in stars], np.uint64).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the choice and the masked bits: equal neighbours are all that matters, rows come sorted by both
            raw = np.stack([batch["choice"].to_numpy(zero_copy_only=False).astype(np.int64), batch["bits"].to_numpy(zero_copy_only=False)], axis=1)
            key = np.ascontiguousarray(raw).view([("c", np.int64), ("k", np.int64)]).ravel()
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last:
                yield from work([*held, (key[:last], fps[:last])])
                held = []
            elif held and held[-1][0][-1] != key[-1]:
                yield from work(held)
                held = []
            held.append((key[last:].copy(), fps[last:].copy()))
        if held:
            yield from work(held)

    return run


#: From this many blocks on, all choices of blocks for a distance of 4 leave 16 bits free at most, so a key has at most 65,536 fingerprints.
_MOST_BLOCKS = 16


def near_links(fps: DataFrame, n: int, distance: int = 4, blocks: int | None = None, most: int = 50_000) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) that connect exactly what all pairs within ``distance`` connect.

    Fingerprints of keys that more than ``most`` share are met again under keys of two more blocks: pairs of such a key
    are among them, and the pigeonhole argument holds for any number of blocks. Counting is partial where the rows
    are, so a frequent key is not brought into one task.
    """
    blocks, found = blocks or blocks_for(n, distance), None
    while True:
        signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, distance)]
        keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])).alias("key")
        dealt, hot = fps.select("fp", keys).select("fp", "key.choice", "key.bits"), None
        if blocks < _MOST_BLOCKS:
            hot = save(dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"), "hot")
            hot = None if hot.isEmpty() else hot
        few = dealt.repartition("choice", "bits") if hot is None else dealt.join(hot, ["choice", "bits"], "left_anti").repartition("choice", "bits")
        links = few.sortWithinPartitions("choice", "bits", "fp").mapInArrow(_link_partition(distance), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if hot is None:
            return found
        fps, blocks = save(dealt.join(hot, ["choice", "bits"], "left_semi").select("fp").distinct(), "family"), min(blocks + 2, _MOST_BLOCKS)


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): one root for each connected component, for the nodes that have an edge."""
    rounds: list[DataFrame] = []
    edges = save(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        salt = F.lit(len(rounds))
        both = edges.union(edges.select("b", "a"))
        least = F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("n")))
        chosen = both.groupBy(F.col("a").alias("node")).agg(least.alias("m")).select("node", F.least("m", F.struct(F.xxhash64("node", salt).alias("h"), F.col("node").alias("n")))["n"].alias("root"))
        chosen = save(chosen, "contract")
        rounds.append(chosen)
        to = lambda c: chosen.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        renamed = edges.join(to("a"), F.col("a") == F.col("_a")).join(to("b"), F.col("b") == F.col("_b"))
        edges = save(renamed.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1]
    for earlier in rounds[-2::-1]:
        up = out.select(F.col("node").alias("via"), F.col("root").alias("top"))
        out = earlier.join(up, F.col("root") == F.col("via"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return save(out, "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size, text_hash, root.

    A null text, like one without words, has fingerprint zero and is linked like any other. Rows with equal
    fingerprints are in one component, repeated ids included. ``component_id`` is the smallest id in the
    component; null ids are ignored there, and it is null if all ids of the component are. ``root`` names the
    component even where ids repeat or are null. An empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = save(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp"), F.xxhash64(body).alias("text_hash")), "simhash")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = connected(near_links(nodes.select("fp"), nodes.count(), distance, blocks))
    tied = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", "root")
    groups = tied.where("root is not null").groupBy("root").agg(F.min("first").alias("id"), F.sum("n").alias("size"))
    linked = tied.where("root is not null").select("fp", "root").join(groups, "root").select("fp", "id", "size", "root")
    alone = tied.where("root is null").select("fp", F.col("first").alias("id"), F.col("n").alias("size"), F.col("fp").alias("root"))
    of = save(linked.unionByName(alone), "membership")
    return rows.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("id").alias("component_id"), F.col("size").alias("component_size"), "text_hash", "root"
    )


def representatives(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the one document of each component of ``near_duplicates`` that stays: the smallest id, null last.

    Where several rows have that id, the one with the smallest text_hash stays; in a component without ids too.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return found.groupBy("root").agg(F.min(order).alias("m")).select("m.doc_id", "m.text_hash")
