"""The chunks that a live stream still has: retention, consumption and expiry in keyed state.

Each stream's state is a map of the chunks that are left and one row of bounds: its newest chunk and
how far it is consumed, so a chunk that comes late is judged as one that came in time. A chunk goes

- ``consumed``, when a range (first, last) is used up: all up to ``last``, but chunk 0 only if a range begins there;
- ``old``, when it is more than ``keep`` behind the newest;
- ``expired``, by a timer, when the watermark is ``after`` beyond its time.

All three only ever grow, so what is left does not depend on the order of arrival or on the batches. The
map has at most ``keep`` + 1 chunks. A stream without chunks ends its state ``idle`` after its last row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearken.operators import streams as R

GONE = "stream long, chunk_idx long, reason string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NEVER = -(1 << 62)


class ChunkStore(StatefulProcessor):
    def __init__(self, keep: int, after_ms: int, idle_ms: int) -> None:
        self.keep, self.after, self.idle = keep, after_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk_idx long", "at long")
        self.bounds = handle.getValueState("bounds", "newest long, upto long, zero boolean, seen long, timer long")

    def _state(self) -> tuple[dict[int, int], list]:
        held = {k[0]: v[0] for k, v in self.chunks.iterator()} if self.chunks.exists() else {}
        return held, list(self.bounds.get()) if self.bounds.exists() else [_NEVER, _NEVER, False, _NEVER, _NEVER]

    def _reason(self, chunk: int, at: int, bounds: list, now: int) -> str | None:
        newest, upto, zero = bounds[:3]
        if chunk <= upto and (chunk > 0 or zero):
            return "consumed"
        if chunk < newest - self.keep:
            return "old"
        return "expired" if at + self.after <= now else None

    def _settled(self, key: tuple, held: dict[int, int], before: dict[int, int], bounds: list, now: int) -> pd.DataFrame:
        """Put down what is left, set the timer for what goes next, and return what went."""
        gone = [(key[0], c, why) for c, at in held.items() if (why := self._reason(c, at, bounds, now))]
        went = {c for _, c, _ in gone}
        left = {c: at for c, at in held.items() if c not in went}
        for c in before.keys() - left.keys():
            self.chunks.removeKey((c,))
        for c, at in left.items():
            if before.get(c) != at:
                self.chunks.updateValue((c,), (at,))
        wanted = min(left.values()) + self.after if left else bounds[3] + self.idle
        if bounds[4] != wanted:
            if bounds[4] > now:
                self.handle.deleteTimer(bounds[4])
            self.handle.registerTimer(wanted)
            bounds[4] = wanted
        self.bounds.update(tuple(bounds))
        return pd.DataFrame(gone, columns=["stream", "chunk_idx", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, bounds = self._state()
        before = dict(held)
        for part in rows:
            first, last, at = (part[c].to_numpy() for c in ("first", "last", "at_ms"))
            chunk = (part["kind"] == "chunk").to_numpy()
            bounds[3] = max(bounds[3], int(at.max()))
            if chunk.any():
                bounds[0] = max(bounds[0], int(first[chunk].max()))
            if not chunk.all():
                bounds[1] = max(bounds[1], int(last[~chunk].max()))
                bounds[2] = bool(bounds[2] or (first[~chunk] == 0).any())
            for c, t in zip(first[chunk].tolist(), at[chunk].tolist(), strict=True):
                held[c] = min(t, held.get(c, t))
            # What cannot stay goes at once, so that a long batch is not held either.
            if len(held) > 4 * (self.keep + 1):
                went = {c: why for c, t in held.items() if c not in before and (why := self._reason(c, t, bounds, now))}
                for c in went:
                    del held[c]
                yield pd.DataFrame([(key[0], c, why) for c, why in went.items()], columns=["stream", "chunk_idx", "reason"])
        yield self._settled(key, held, before, bounds, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, bounds = self._state()
        if not held and bounds[3] + self.idle <= now:
            self.bounds.clear()
            return
        bounds[4] = _NEVER if bounds[4] <= now else bounds[4]
        yield self._settled(key, held, dict(held), bounds, now)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which map state and timers need, for queries that start meanwhile."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)


def events_of(chunks: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """(stream, chunk_idx, at) and (stream, first, last, at) as one stream of events."""
    of = lambda df, kind, first, last: df.select(F.col("stream").cast("long").alias("stream"), F.lit(kind).alias("kind"), F.col(first).cast("long").alias("first"), F.col(last).cast("long").alias("last"), "at")
    events = of(chunks, "chunk", "chunk_idx", "chunk_idx")
    return events if consumed is None else events.unionByName(of(consumed, "range", "first", "last"))


def gone_chunks(events: DataFrame, keep: int = 7, after_ms: int = 3_600_000, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """(stream, chunk_idx, reason) of the chunks that go, of a stream of ``events_of``. A chunk that comes again
    after it went goes again. A row that is older than the watermark when it comes is not looked at."""
    timed = events.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("stream").transformWithStateInPandas(ChunkStore(keep, after_ms, idle_ms), GONE, "append", "eventTime")


def kept_chunks(chunks: DataFrame, consumed: DataFrame, keep: int, after_ms: int, now_ms: int) -> DataFrame:
    """The same of tables, at a watermark: the chunks (stream, chunk_idx, at) that are left."""
    left = R.purged(R.retained(chunks, "stream", keep), consumed.select("stream", F.col("first").alias("start"), F.col("last").alias("end")), "stream")
    return left.filter(F.unix_millis("at") + after_ms > now_ms)
