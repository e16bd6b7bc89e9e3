"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts form a group that stays together. Groups are dealt by hash into bounded buckets; in each bucket
the differencing method repeatedly takes the two partial partitions of largest spread and combines them in
opposite order. A bucket's result is again a partial partition, so buckets are combined by the same method
in further levels until one is left. No task sees more than about ``per_bucket`` partial partitions.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import number_rows, save


def difference(loads: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions (each a list of k loads) into one.

    Returns, for each input, where each of its slots went, and the loads of the result.
    """
    k = len(loads[0])
    nodes: list[tuple] = [(row,) for row in loads]  # (loads,) or (loads, left, its order, right, its order)
    heap = [(min(row) - max(row), i) for i, row in enumerate(loads)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = nodes[a][0], nodes[b][0]
        down = sorted(range(k), key=lambda j: -x[j])
        up = sorted(range(k), key=lambda j: y[j])
        row = [x[i] + y[j] for i, j in zip(down, up)]
        nodes.append((row, a, down, b, up))
        heapq.heappush(heap, (min(row) - max(row), len(nodes) - 1))
    places: list[list[int] | None] = [None] * len(nodes)
    places[-1] = list(range(k))
    for i in range(len(nodes) - 1, len(loads) - 1, -1):
        _, a, down, b, up = nodes[i]
        for child, order in ((a, down), (b, up)):
            at = [0] * k
            for new, old in enumerate(order):
                at[old] = places[i][new]
            places[child] = at
    return places[: len(loads)], nodes[-1][0]


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("item")
    places, total = difference([[int(x) for x in row] for row in pdf["loads"]])
    return pd.DataFrame({"item": pdf["item"].values, "bucket": pdf["bucket"].values, "places": places, "total": [total] + [None] * (len(pdf) - 1)})


def shard_groups(groups: DataFrame, n_shards: int, per_bucket: int = 4096) -> DataFrame:
    """(item long, bytes long) -> (item, shard int)."""
    zeros = [F.lit(0).cast("long")] * (n_shards - 1)
    level = groups.select("item", F.array(F.col("bytes"), *zeros).alias("loads"))
    n, depth, placed = groups.count(), 0, []
    while True:
        buckets = max(1, -(-n // per_bucket))
        dealt = level.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(depth)), F.lit(buckets)))
        done = save(dealt.groupBy("bucket").applyInPandas(_bucket, "item long, bucket long, places array<int>, total array<long>"), f"shard{depth}")
        placed.append(done.select("item", "bucket", "places"))
        if buckets == 1:
            break
        level = done.where(F.col("total").isNotNull()).select(F.col("bucket").alias("item"), F.col("total").alias("loads"))
        n, depth = level.count(), depth + 1
    out = placed[0].select("item", "bucket", F.col("places")[0].alias("shard"))
    for up in placed[1:]:
        up = up.select(F.col("item").alias("of"), F.col("bucket").alias("above"), "places")
        out = out.join(up, out["bucket"] == up["of"]).select("item", F.col("above").alias("bucket"), F.get("places", F.col("shard")).alias("shard"))
    return out.select("item", "shard")


def shard_documents(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 1. A null text counts as an empty one and shares its group.
    Rows with equal texts share a shard, repeated ids included. Shards hold near-equal bytes as far as the
    groups allow; a group above an eighth of all bytes fills a shard alone. Slots count from 0 in each shard.
    An empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = save(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("item"), F.monotonically_increasing_id().alias("row")), "sizes")
    n = base.count()
    if not n:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    where = shard_groups(base.groupBy("item").agg(F.sum("size").alias("bytes")), n_shards, per_bucket)
    placed = base.join(where, "item").drop("item")
    return number_rows(placed, ["shard"], ["doc_id", "text_crc32", "size", "row"], n, "slot").drop("row")  # the row spreads rows that are alike
