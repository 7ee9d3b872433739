"""Streaming forms give what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riftscan.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "device_id bigint, event_id bigint, ts timestamp, success bigint"


def rows():
    out = []
    for k in range(60):
        out.append((k % 2, k, T0 + dt.timedelta(milliseconds=700 * k + (5000 if k > 30 else 0)), int(k % 5 != 0)))
    return out


def drain(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture
def source(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(rows()[20 * k : 20 * (k + 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_quota(spark, source):
    batch = ev.quota(spark.createDataFrame(rows(), SCHEMA), 7)
    got = drain(spark, ev.quota_stream(source, 7), "quota_out")
    key = lambda df: sorted((r.device_id, r.event_id, r.admitted, r.remaining) for r in df.collect())
    assert key(got) == key(batch)
    used, state = {}, []
    for d, e, _, ok in rows():
        admitted = used.get(d, 0) < 7
        used[d] = used.get(d, 0) + int(admitted and ok)
        state.append((d, e, admitted, max(0, 7 - used[d])))
    assert key(batch) == sorted(state)
    assert {r.device_id: r.used for r in ev.usage(spark.createDataFrame(rows(), SCHEMA), 7).collect()} == used


def test_debounce(spark, source):
    batch = ev.debounced(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert sum(r.n_events for r in batch) == 60 and all(r.fires > r.started for r in batch)
    near = spark.createDataFrame([(1, 1, T0, 1), (1, 2, T0 + dt.timedelta(seconds=2), 1), (1, 3, T0 + dt.timedelta(seconds=4.001), 1)], SCHEMA)
    assert sorted(r.n_events for r in ev.debounced(near).collect()) == [1, 2]
    got = drain(spark, ev.debounced_stream(source, late="0 seconds"), "debounced_out").collect()
    assert {(r.device_id, r.started, r.n_events) for r in got} <= {(r.device_id, r.started, r.n_events) for r in batch}
    assert got


def test_latest_and_two_phase(spark):
    updates = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c"), ("m", 9, "z")], "key string, seq int, value string")
    ready = spark.createDataFrame([("k", 2), ("m", 1)], "key string, ready_seq int")
    assert {(r.key, r.value) for r in ev.latest(updates, ready).collect()} == {("k", "b")}
    assert {(r.key, r.value) for r in ev.latest(updates).collect()} == {("k", "c"), ("m", "z")}
    seen = []
    ev.two_phase(lambda df, phase: seen.append((phase, df.count())), lambda df: df.withColumn("x", F.lit(1)))(updates, 0)
    assert seen == [("raw", 4), ("enriched", 4)]
