"""Keyed state of the live streams on ``transformWithState`` (RocksDB): feature rings and vessel windows.

Spark's timers drive both: state waits in the store until the watermark passes it, so a key needs no new data to
release rows or to leave the window. State lives in RocksDB, outside the JVM heap; no whole key is ever in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Released rows of a key that are put into one frame.
_FLUSH = 8192
#: Waiting readings of a key that share one entry of the state when they come from several chunks.
_BLOCK = 256
#: The microseconds of a missing time.
_NAT = -(1 << 63)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def micros(column: pd.Series) -> np.ndarray:
    """Microseconds since the epoch of a timestamp column."""
    return column.to_numpy(dtype="datetime64[us]").astype(np.int64)


def ring_features(ring: np.ndarray, values: np.ndarray, lags: list[int], windows: list[int]) -> dict[str, np.ndarray]:
    """Lags and rolling means of ``values``, which follow the values of ``ring``; NaN where the history is too short."""
    series = np.concatenate([ring, values])
    at = np.arange(len(ring), len(series))
    out = {}
    for k in lags:
        out[f"lag_{k}"] = np.where(at >= k, series[np.maximum(at - k, 0)], np.nan)
    for w in windows:
        means = np.full(len(at), np.nan)
        if len(series) >= w:
            inside = at >= w - 1
            means[inside] = np.lib.stride_tricks.sliding_window_view(series, w).mean(axis=1)[at[inside] - w + 1]
        out[f"roll_mean_{w}"] = means
    return out


class FeatureRing(StatefulProcessor):
    """Lag and rolling features of each reading once the watermark has passed it.

    ``ring`` (list state): the key's last ``need`` readings in time order, in runs of a quarter. ``pending`` (map state): readings that wait for the
    watermark, in blocks of neighbouring time chunks; a block's key is the number of its first chunk, and it ends where the
    next one begins. A block holds one chunk, or up to ``_BLOCK`` readings of several: every call to the store is a round trip
    to the JVM, so a sparse key costs a few calls whatever its span, and a backfill of one hot key is still read chunk by chunk. One event-time
    timer per key stands at its oldest waiting reading. A reading that arrives twice (same time and tie) counts once.
    """

    def __init__(self, key: str, ts: str, tie: str, value: str, lags: list[int], windows: list[int], chunk_seconds: int = 3600):
        self.names = (key, ts, tie, value)
        self.lags, self.windows = lags, windows
        self.need = max(lags + windows)
        self.run = max(1, self.need // 4)
        self.chunk = chunk_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "us array<bigint>, tie array<bigint>, val array<double>")
        self.pending = handle.getMapState("pending", "chunk bigint", "us array<bigint>, tie array<bigint>, val array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, ts, tie, value = self.names
        oldest = None
        starts = None
        for frame in rows:
            if not len(frame):
                continue
            us, ties = micros(frame[ts]), frame[tie].to_numpy(np.int64)
            val = frame[value].to_numpy(np.float64)
            starts = sorted(k[0] for k in self.pending.keys()) if starts is None else starts
            block = np.maximum(np.searchsorted(starts, us // self.chunk, "right") - 1, 0)
            by = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by], prepend=-1))
            kept = list(starts)
            for lo, hi in zip(edges, np.append(edges[1:], len(by))):
                part = by[lo:hi]
                at = starts[block[part[0]]] if starts else None
                kept += self._put(at, us[part], ties[part], val[part])
                if at is not None:
                    kept.remove(at)
            starts = sorted(kept)
            oldest = int(us.min()) if oldest is None else min(oldest, int(us.min()))
        if oldest is not None:
            self.handle.registerTimer(_due(oldest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ring = [reading for run in self.ring.get() for reading in zip(*run)]
        last = ring[-1][:2] if ring else None
        ready: list[tuple] = []
        chunks = sorted(k[0] for k in self.pending.keys())
        for at in chunks:
            if at * self.chunk > limit:
                break
            us, ties, val = (np.array(x, t) for x, t in zip(self.pending.getValue((at,)), (np.int64, np.int64, np.float64)))
            if last is not None:  # not newer than the ring: arrived too late
                new = (us > last[0]) | ((us == last[0]) & (ties > last[1]))
                us, ties, val = us[new], ties[new], val[new]
            n = int(np.searchsorted(us, limit, "right"))
            if n < len(us):
                self.pending.updateValue((at,), (us[n:].tolist(), ties[n:].tolist(), val[n:].tolist()))
                self.handle.registerTimer(_due(int(us[n])))
            else:
                self.pending.removeKey((at,))
            if n:
                ready.append((us[:n], ties[:n], val[:n]))
                last = (int(us[n - 1]), int(ties[n - 1]))
            if sum(len(r[0]) for r in ready) >= _FLUSH:
                frame, ring = self._features(key, ring, ready)
                ready = []
                yield frame
            if n < len(us):
                break
        else:
            at = None
        if ready:
            frame, ring = self._features(key, ring, ready)
            yield frame
        self.ring.put([tuple(map(list, zip(*ring[i: i + self.run]))) for i in range(0, len(ring), self.run)])
        if at is not None and at * self.chunk > limit:
            self.handle.registerTimer(_due(self.pending.getValue((at,))[0][0]))

    def _features(self, key, ring: list, ready: list[tuple]) -> tuple[pd.DataFrame, list]:
        us, ties, val = (np.concatenate(x) for x in zip(*ready))
        features = ring_features(np.array([r[2] for r in ring], np.float64), val, self.lags, self.windows)
        tail = slice(-self.need, None)
        return self._frame(key, us, ties, val, features), (ring + list(zip(us[tail].tolist(), ties[tail].tolist(), val[tail].tolist())))[-self.need:]

    def _frame(self, key, us, ties, val, features: dict[str, np.ndarray]) -> pd.DataFrame:
        key_col, ts, tie, value = self.names
        return pd.DataFrame({key_col: [key[0]] * len(us), ts: us.astype("datetime64[us]"), tie: ties, value: val, **features})

    def _put(self, at: int | None, us, ties, val) -> list[int]:
        """New readings into the block that begins at ``at`` (None: there is none), each (time, tie) once; where the blocks it becomes begin."""
        if at is not None:
            old = self.pending.getValue((at,))
            us, ties, val = np.append(np.array(old[0], np.int64), us), np.append(np.array(old[1], np.int64), ties), np.append(np.array(old[2], np.float64), val)
        by = np.lexsort((ties, us))
        once = np.append(True, (np.diff(us[by]) != 0) | (np.diff(ties[by]) != 0))
        by = by[once]
        us, ties, val = us[by], ties[by], val[by]
        begins = {}
        for lo, hi in self._cuts(us // self.chunk):
            first = int(us[lo] // self.chunk)
            if at is not None and not begins:
                first = min(first, at)
            begins[first] = None
            self.pending.updateValue((first,), (us[lo:hi].tolist(), ties[lo:hi].tolist(), val[lo:hi].tolist()))
        if at is not None and at not in begins:
            self.pending.removeKey((at,))
        return list(begins)

    @staticmethod
    def _cuts(chunks: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of a block's readings (by their chunks, ascending): all of them, or half-full runs of whole chunks."""
        if len(chunks) <= _BLOCK:
            return [(0, len(chunks))]
        edges = np.append(np.flatnonzero(np.diff(chunks)) + 1, len(chunks)).tolist()
        out, lo, end = [], 0, 0
        for hi in edges:
            if end > lo and hi - lo > _BLOCK // 2:
                out.append((lo, end))
                lo = end
            end = hi
        return [*out, (lo, end)]


class PackedFeatureRing(FeatureRing):
    """The same with one row of arrays per frame: a key's few readings in twenty columns cost more to hand over than to compute.

    ``val`` holds the value and the features of each reading, one reading after the other; ``unpacked`` makes them rows again.
    """

    def schema(self, key_type: str) -> str:
        return f"{self.names[0]} {key_type}, us array<bigint>, tie array<bigint>, val array<double>"

    def _frame(self, key, us, ties, val, features: dict[str, np.ndarray]) -> pd.DataFrame:
        cells = np.column_stack([val, *features.values()]).ravel()
        return pd.DataFrame({self.names[0]: [key[0]], "us": [us], "tie": [ties], "val": [cells]})

    def unpacked(self, df: DataFrame) -> DataFrame:
        key, ts, tie, value = self.names
        cells = [value, *[f"lag_{k}" for k in self.lags], *[f"roll_mean_{n}" for n in self.windows]]
        cell = lambda j: F.get("val", F.col("_i") * F.lit(len(cells)) + F.lit(j))
        rows = df.select(key, F.posexplode("us").alias("_i", "_us"), "tie", "val")
        at = F.timestamp_add("MICROSECOND", F.col("_us"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
        return rows.select(key, F.when(F.col("_us") != F.lit(_NAT), at).alias(ts),
                           F.get("tie", F.col("_i")).alias(tie), *[F.when(~F.isnan(cell(j)), cell(j)).alias(c) for j, c in enumerate(cells)])


def _due(us: int) -> int:
    """The timer that fires as soon as the watermark (milliseconds) has reached a time: timers fire once the watermark is past them."""
    return -(-us // 1000) - 1


class LatestInWindow(StatefulProcessor):
    """The latest row of each key while it lies in the window behind the newest event time; output is changes only.

    ``latest`` (value state) holds one row per key; a timer at its time fires once the watermark, which trails the newest event by
    the window, has passed it. Output: the key's new latest row with change ``upsert``, or its last row with ``delete``.
    """

    def __init__(self, key: str, ts: str, tie: str, columns: list[str], schema: str):
        self.key, self.ts, self.tie, self.columns, self.schema = key, ts, tie, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", f"us bigint, tie bigint, row struct<{self.schema}>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.latest.get() if self.latest.exists() else None
        best = (have[0], have[1]) if have else None
        found = None
        for frame in rows:
            if not len(frame):
                continue
            us, ties = micros(frame[self.ts]), frame[self.tie].to_numpy(np.int64)
            i = int(np.lexsort((ties, us))[-1])
            if best is None or (int(us[i]), int(ties[i])) > best:
                best, found = (int(us[i]), int(ties[i])), frame[self.columns].iloc[[i]]
        if found is None:
            return
        if have:
            self.handle.deleteTimer(have[0] // 1000)
        self.handle.registerTimer(best[0] // 1000)
        self.latest.update((*best, _plain(found)))
        yield found.assign(**{self.key: key[0], "change": "upsert"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latest.exists():
            return
        us, _, row = self.latest.get()
        if us // 1000 != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.latest.clear()
        gone = pd.DataFrame([list(row)], columns=self.columns)
        yield gone.assign(**{self.key: key[0], "change": "delete"})


def _plain(frame: pd.DataFrame) -> tuple:
    """One row as Python values, NULL for what is missing."""
    out = []
    for c in frame.columns:
        v = frame[c].iloc[0]
        out.append(None if pd.isna(v) else v.to_pydatetime() if hasattr(v, "to_pydatetime") else v.item() if hasattr(v, "item") else v)
    return tuple(out)
