"""The latest change of each document as keyed state, with vectors that are tried again by timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesserae.operators.vectors import Encoder

#: What needs state by key is kept by this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "_id string, micros bigint, text string, content_vector array<float>, tries int"
_STATE = "micros bigint, text string, tries int, waits boolean"


class LatestChange(StatefulProcessor):
    """Of each document the latest change. A change gives a row with its vector, or without one where its text could not be encoded.

    Late and repeated changes change nothing; of changes of one time the greatest text counts. What failed is tried again
    after ``wait`` milliseconds, doubled each time, without a new change, at most ``most`` times; a later change starts anew.
    The state says whether a timer waits, so timers are asked for only where there is one.
    """

    def __init__(self, encode: Encoder, wait: int, most: int):
        self.encode, self.wait, self.most = encode, wait, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", _STATE)

    def _tried(self, key: str, micros: int, text: str, tries: int, now: int) -> Row:
        vector, waits = None, False
        if text:
            try:
                vector = self.encode([text])[0]
            except Exception:  # whatever the encoder says, the timer comes back to it
                vector = None
            if waits := vector is None and tries < self.most:
                self.handle.registerTimer(now + self.wait * 2**tries)
        self.latest.update((micros, text, tries + 1, waits))
        return Row(_id=key, micros=micros, text=text, content_vector=None if vector is None else [float(x) for x in vector], tries=tries + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.latest.get()
        best = (held[0], held[1]) if held else None
        new = best
        for row in rows:
            found = (int(row["micros"]), row["text"] or "")
            new = found if new is None or found > new else new
        if new != best:
            if held and held[3]:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            yield self._tried(key[0], *new, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.latest.get()
        if held:
            yield self._tried(key[0], held[0], held[1], held[2], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stream_latest(changes: DataFrame, encode: Encoder, wait: int = 60_000, most: int = 8, key: str = "_id", ts: str = "updated_at", text: str = "text") -> DataFrame:
    """(_id, updated_at, text, content_vector, tries) for each change that is the latest of its document, and for each new try.

    State is one small row a document, kept by Spark by key; the session's state store must be ``PROVIDER``. The last row
    of each document by (updated_at, tries) is the document as the batch upsert has it. Null keys and times are left out.
    Timers are looked at in every batch; a trigger that ends, such as ``availableNow``, ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    from pyspark.sql import functions as F

    rows = changes.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(text).alias("text"))
    found = rows.groupBy("_id").transformWithState(LatestChange(encode, wait, most), OUT, "Update", "ProcessingTime")
    return found.select("_id", F.timestamp_micros("micros").alias("updated_at"), "text", "content_vector", "tries")
