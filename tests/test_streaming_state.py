"""Keyed streaming state: feature rings, vessel windows, and the keyed tables that their changes go to."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdlake.functions.scalars import ntz_lit
from crowdlake.operators import windows as W
from crowdlake.streaming import jobs as ST
from crowdlake.streaming import state as S
from crowdlake.streaming.keyed import KeyedTable

T0 = dt.datetime(2025, 8, 20)
VESSELS = "id_str string, time_utc timestamp_ntz, event_id bigint, lon double, lat double, speed_cm_s double"


def minute(n):
    return T0 + dt.timedelta(minutes=n)


# -- rings -----------------------------------------------------------------------------------------------------

class FakeState:
    """In-process state of one key with the calls the processors use; counts the rows that are held at once."""

    def __init__(self):
        self.ring, self.map, self.timers, self.read = [], {}, [], 0

    def getListState(self, *_):
        return self

    def getMapState(self, *_):
        return FakeMap(self)

    def get(self):
        return iter(self.ring)

    def put(self, rows):
        self.ring = list(rows)

    def registerTimer(self, ms):
        self.timers.append(ms)


class FakeMap:
    def __init__(self, state):
        self.state = state

    def keys(self):
        return iter(list(self.state.map))

    def containsKey(self, k):
        return k in self.state.map

    def getValue(self, k):
        self.state.read = max(self.state.read, len(self.state.map[k][0]))
        return self.state.map[k]

    def updateValue(self, k, v):
        self.state.map[k] = v

    def removeKey(self, k):
        del self.state.map[k]


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def ring(chunk=3600):
    p = S.FeatureRing("k", "ts", "tie", "v", [1, 3], [2], chunk)
    p.init(FakeState())
    return p


def frame(us, tie, v):
    return pd.DataFrame({"k": ["a"] * len(us), "ts": np.array(us, np.int64).astype("datetime64[us]"), "tie": np.array(tie, np.int64), "v": np.array(v, float)})


def test_ring_reads_a_hot_backfill_chunk_by_chunk(monkeypatch):
    """50,000 readings of one key, shuffled over frames: no more than a chunk is read at once, frames stay bounded, timers are due."""
    monkeypatch.setattr(S, "_FLUSH", 1000)
    n, step = 50_000, 10_000_000  # a reading every 10 s, 360 an hour
    rng = np.random.RandomState(1)
    order, values = rng.permutation(n), rng.rand(n)
    p = ring()
    for lo in range(0, n, 7000):
        i = order[lo: lo + 7000]
        assert list(p.handleInputRows(("a",), iter([frame(i * step, i, values[i])]), Watermark(0))) == []
    limit = (n - 100) * step // 1000
    out = list(p.handleExpiredTimer(("a",), Watermark(limit), None))
    assert p.handle.read == 360 and max(map(len, out)) < 1000 + 360
    got = pd.concat(out)
    assert got["tie"].tolist() == list(range(n - 100 + 1))
    assert np.array_equal(got["lag_3"].to_numpy()[3:], values[: n - 100 - 2])
    assert np.allclose(got["roll_mean_2"].to_numpy()[1:], (values[1: n - 99] + values[: n - 100]) / 2)
    assert len(p.handle.ring) == 3 and p.handle.timers[-1] == S._due((n - 99) * step)
    rest = pd.concat(p.handleExpiredTimer(("a",), Watermark(n * step // 1000), None))
    assert rest["tie"].tolist() == list(range(n - 99, n)) and not p.handle.map


def test_ring_drops_repeats_and_late_rows():
    p = ring()
    minute_us = 60_000_000
    first = frame([1 * minute_us, 2 * minute_us, 2 * minute_us], [1, 2, 3], [10, 20, 30])
    list(p.handleInputRows(("a",), iter([first, frame([], [], []), first]), Watermark(0)))
    out = pd.concat(p.handleExpiredTimer(("a",), Watermark(60_000 * 2), None))
    assert out["v"].tolist() == [10, 20, 30]
    list(p.handleInputRows(("a",), iter([first, frame([3 * minute_us], [4], [40])]), Watermark(60_000 * 2)))
    out = pd.concat(p.handleExpiredTimer(("a",), Watermark(60_000 * 9), None))
    assert out["v"].tolist() == [40] and out["lag_1"].tolist() == [30]
    assert list(p.handleExpiredTimer(("a",), Watermark(60_000 * 9), None)) == []


def test_ring_of_a_sparse_key_costs_few_calls(monkeypatch):
    """A month of 66 readings is one entry of the state, written once; blocks that fill up are cut, and rows before the first block move it."""
    calls = []
    monkeypatch.setattr(FakeMap, "updateValue", lambda self, k, v: (calls.append(len(v[0])), self.state.map.update({k: v})))
    rng = np.random.RandomState(2)
    us = np.sort(rng.choice(30 * 86_400, 66, replace=False)).astype(np.int64) * 1_000_000
    p = ring()
    list(p.handleInputRows(("a",), iter([frame(us, np.arange(66), np.arange(66.0))]), Watermark(0)))
    assert calls == [66] and list(p.handle.map) == [(int(us[0]) // 3_600_000_000,)]
    out = pd.concat(p.handleExpiredTimer(("a",), Watermark(31 * 86_400_000), None))
    assert out["tie"].tolist() == list(range(66)) and not p.handle.map

    us = rng.choice(30 * 86_400, 3000, replace=False).astype(np.int64) * 1_000_000
    p = ring()
    for lo in range(0, 3000, 70):
        i = np.arange(lo, min(lo + 70, 3000))
        list(p.handleInputRows(("a",), iter([frame(us[i], i, i)]), Watermark(0)))
        held = sorted(p.handle.map.items())
        assert all(a[1][0][-1] // 3_600_000_000 < b[0][0] for a, b in zip(held, held[1:]))
    assert max(len(v[0]) for v in p.handle.map.values()) <= S._BLOCK and len(p.handle.map) < 40
    got = pd.concat(p.handleExpiredTimer(("a",), Watermark(31 * 86_400_000), None))
    assert got["tie"].tolist() == np.argsort(us).tolist()


def test_packed_frames_hold_the_same_rows(spark):
    """One row of arrays a key, made rows again by Spark: equal to the plain frames, NULL where a time, a value or a history is missing."""
    plain, packed = ring(), S.PackedFeatureRing("k", "ts", "tie", "v", [1, 3], [2])
    packed.init(FakeState())
    rows = frame([3_000_001, 1_000_000, 2_000_000, 4_000_000, S._NAT], [3, 1, 2, 4, 5], [30, 10, np.nan, 40, 50])
    out = []
    for p in (plain, packed):
        list(p.handleInputRows(("a",), iter([rows]), Watermark(0)))
        out.append(pd.concat(p.handleExpiredTimer(("a",), Watermark(9000), None)))
    assert len(out[1]) == 1
    listed = [(r.k, r.us.tolist(), r.tie.tolist(), r.val.tolist()) for r in out[1].itertuples()]
    got = packed.unpacked(spark.createDataFrame(listed, packed.schema("string"))).orderBy("ts").collect()
    want = [tuple(None if pd.isna(v) else v for v in r) for r in out[0].itertuples(index=False, name=None)]
    assert [tuple(r) for r in got] == [(k, ts and ts.to_pydatetime(), *rest) for k, ts, *rest in want] and got[0].ts is None


def test_features_of_a_replayed_stream(spark, tmp_dir):
    """Files delivered twice, the stream stopped and started between them: each reading comes out once, as in batch."""
    rnd = random.Random(6)
    rows = [(s, minute(3 * i), s * 1000 + i, float(rnd.randint(0, 40))) for s in (1, 2) for i in range(40)]
    rows += [(1, minute(3 * i + 1), 5000 + i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "sensor bigint, ts timestamp_ntz, event_id bigint, count double")
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ckpt"))
    first, later = df.where(F.col("ts") < ntz_lit(minute(60))), df.where(F.col("ts") >= ntz_lit(minute(60)))
    for part in (first, first, later):
        part.coalesce(1).write.mode("append").parquet(src)
        feats = ST.stream_features(ST.file_stream(spark, src, df.schema, max_files_per_trigger=1), "sensor", "ts", "event_id", "count", [1, 5], [3])
        ST.run_available(feats, sink, ckpt)
    want = W.lag_and_rolling_simple(df, "sensor", ["ts", "event_id"], "count", [1, 5], [3]).where(F.col("ts") <= ntz_lit(max(r[1] for r in rows) - dt.timedelta(minutes=15)))

    def plain(d):
        return sorted(tuple(None if v is None or v != v else round(v, 9) for v in r) for r in d.select("event_id", "lag_1", "lag_5", "roll_mean_3").collect())

    assert plain(spark.read.parquet(sink)) == plain(want)


# -- vessel window ---------------------------------------------------------------------------------------------

def test_vessel_window_changes(spark, tmp_dir):
    """Newer rows replace, older ones do not, vessels leave once others move the clock, late rows never enter."""
    batches = [[("A", minute(0), 1, 4.8, 52.3, 1.0), ("B", minute(1), 2, 4.8, 52.3, None), ("A", minute(0), 9, 4.9, 52.3, 1.0)],
               [("A", minute(10), 3, 4.9, 52.4, 2.0), ("B", minute(0), 4, 0.0, 0.0, 0.0)],
               [("C", minute(20), 5, 4.7, 52.2, 3.0), (None, minute(20), 6, 4.7, 52.2, 3.0)],
               [("D", minute(2), 7, 4.7, 52.2, 3.0), ("C", minute(20), 8, 4.6, 52.2, 3.0)]]
    src, ckpt = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "ckpt")
    table = ST.vessel_window_sink(os.path.join(tmp_dir, "table"), buckets=4)
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, VESSELS).coalesce(1).write.mode("append").parquet(src)
        stream = ST.stream_latest_in_window(ST.file_stream(spark, src, spark.createDataFrame([], VESSELS).schema), 15)

        def apply(batch, batch_id):
            seen.append(sorted((r.id_str or "", r.event_id, r.change) for r in batch.collect()))
            ST.vessel_window_upsert(table)(batch, batch_id)

        ST.run_available(stream, None, ckpt, foreach_batch=apply)
        now = {r.id_str: r.event_id for r in ST.vessel_window_table(spark, table, stream.schema, 15).collect()}
    assert now == {"A": 3, "C": 8, None: 6}
    flat = [c for b in seen for c in b]
    assert ("B", 2, "delete") in flat and ("B", 4, "upsert") not in flat and not any(c[0] == "D" for c in flat)
    assert [c for c in flat if c[0] == "A"] == [("A", 9, "upsert"), ("A", 3, "upsert")]  # changes only, A never leaves


# -- keyed table -----------------------------------------------------------------------------------------------

SCHEMA = "k bigint, t bigint, v string"


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_dir):
    table = KeyedTable(os.path.join(tmp_dir, "t"), "k", ["t"], buckets=8, keep_versions=2)
    rows = spark.createDataFrame([(k, 1, f"v{k}") for k in range(200)], SCHEMA)
    assert table.read(spark, rows.schema).count() == 0
    table.merge(rows, 0)
    before = table._manifest(spark, 0)
    assert len(before) == 8
    table.merge(spark.createDataFrame([(7, 2, "new"), (7, 0, "old"), (7, 2, "new")], SCHEMA), 1)
    after = table._manifest(spark, 1)
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r.k: r.v for r in table.read(spark, rows.schema).collect()}
    assert got == {k: "new" if k == 7 else f"v{k}" for k in range(200)}
    table.merge(spark.createDataFrame([(7, 1, "older")], SCHEMA), 2)
    assert {r.v for r in table.read(spark, rows.schema).where("k = 7").collect()} == {"new"}


def test_keyed_table_deletes_replays_and_prunes(spark, tmp_dir):
    table = KeyedTable(os.path.join(tmp_dir, "t"), "k", ["t"], buckets=2, keep_versions=2)
    schema = SCHEMA + ", gone boolean"
    table.merge(spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", None), (None, 1, "n", False)], schema), 0, F.col("gone"))
    for _ in range(2):  # the second run of a batch changes nothing
        table.merge(spark.createDataFrame([(1, 2, "a", True), (None, 2, "m", False)], schema), 1, F.col("gone"))
    read = table.read(spark, spark.createDataFrame([], schema).schema)
    assert sorted(map(str, map(tuple, read.select("k", "v").collect()))) == ["(2, 'b')", "(None, 'm')"]
    table.merge(spark.createDataFrame([(2, 3, "b", True)], schema), 2, F.col("gone"))
    table.merge(spark.createDataFrame([], schema), 3, F.col("gone"))
    assert table.versions(spark) == [2, 3]
    assert [r.v for r in table.read(spark, read.schema).collect()] == ["m"]
    named = {f.split("/")[1] for v in (2, 3) for f in table._manifest(spark, v).values()}
    assert set(os.listdir(os.path.join(tmp_dir, "t", "data"))) == named


def test_keyed_table_reader_sees_whole_versions(spark, tmp_dir, monkeypatch):
    """A reader that opened the table before a batch, and one while the batch is being written, both read whole versions."""
    table = KeyedTable(os.path.join(tmp_dir, "t"), "k", ["t"], buckets=2)
    table.merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), 0)
    early = table.read(spark, spark.createDataFrame([], SCHEMA).schema)
    commit, during = KeyedTable._commit, []

    def watched(self, s, version, folders):
        during.append(sorted(r.v for r in self.read(s, early.schema).collect()))
        commit(self, s, version, folders)

    monkeypatch.setattr(KeyedTable, "_commit", watched)
    table.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "b")], SCHEMA), 1)
    assert during == [["a", "a"]] and sorted(r.v for r in early.collect()) == ["a", "a"]
    assert sorted(r.v for r in table.read(spark, early.schema).collect()) == ["b", "b"]

    def broken(self, s, version, folders):
        raise OSError("no space")

    monkeypatch.setattr(KeyedTable, "_commit", broken)
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(1, 3, "c")], SCHEMA), 2)
    assert sorted(r.v for r in table.read(spark, early.schema).collect()) == ["b", "b"]
