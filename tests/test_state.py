"""Timers, expiry and the ledger against a plain replay, also after a restart or a stop in between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riftscan.streaming import events as ev
from riftscan.streaming import ledger

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "device_id bigint, event_id bigint, ts timestamp, success bigint"


def made():
    r, out, now = random.Random(9), [], 0
    for k in range(80):
        now += r.choice((0, 300, 1000, 2000, 2000, 2001, 5000))
        out.append((k % 3, k, T0 + dt.timedelta(milliseconds=now), int(k % 4 != 0)))
    return out


def put(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{k}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    q.awaitTermination()


def bursts(rows, merge):
    found = {}
    for d, _, t, _ in sorted(rows, key=lambda x: x[2]):
        mine = found.setdefault(d, [])
        gap = dt.timedelta(seconds=2)
        if mine and (t - mine[-1][1] < gap or merge and t - mine[-1][1] == gap):
            mine[-1] = (mine[-1][0], t, mine[-1][2] + 1)
        else:
            mine.append((t, t, 1))
    return {(d, a, b + dt.timedelta(seconds=2), n) for d, xs in found.items() for a, b, n in xs}


@pytest.mark.parametrize("merge", [False, True])
def test_timers(spark, tmp_path, merge):
    rows = made()
    late = (9, 999, T0 + dt.timedelta(days=1), 1)  # moves the watermark past all others
    parts = [rows[:30], rows[30:], [late]]
    random.Random(1).shuffle(parts[0])
    (tmp_path / "in").mkdir()
    stream = lambda: ev.fire_at_edge(source(spark, tmp_path / "in"), late="1 hour", merge_at_edge=merge)
    for k, part in enumerate(parts):  # stopped and started again before each part
        put(spark, tmp_path / "in", k, part)
        run(stream(), tmp_path / "out", tmp_path / "cp")
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("device_id", "started", "fires", "n_events").collect()]
    assert len(got) == len(set(got))
    assert set(got) == bursts(rows, merge)


def test_idle_devices_expire(spark, tmp_path):
    rows = made()
    (tmp_path / "in").mkdir()
    for k in range(4):
        put(spark, tmp_path / "in", k, rows[20 * k : 20 * k + 20])
        run(ev.quota_stream_expiring(source(spark, tmp_path / "in"), 2, 9000, "1 second"), tmp_path / "out", tmp_path / "cp")
    want, state = [], {}
    for d, e, t, ok in rows:
        used, seen = state.get(d, (0, t))
        used = 0 if t - seen > dt.timedelta(seconds=9) else used
        admitted = used < 2
        used += int(admitted and ok)
        state[d] = (used, t)
        want.append((d, e, admitted, 2 - used))
    got = [(x.device_id, x.event_id, x.admitted, x.remaining) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want)
    assert len({w[2] for w in want}) == 2


def test_ledger_after_a_stop(spark, tmp_path):
    rows, path = made(), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for k in range(3):
        put(spark, tmp_path / "in", k, rows[20 * k : 20 * k + 20])
    fails = {"left": 2}

    def enrich(df):
        if fails["left"]:
            fails["left"] -= 1
            raise RuntimeError("stopped")
        return df.withColumn("advice", F.lit("x"))

    def start():
        q = source(spark, tmp_path / "in").writeStream.foreachBatch(ledger.two_phase_table(path, enrich)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            start()
    assert ledger.phase_rows(spark, path, "raw").count() == 20
    start()
    for phase in ledger.PHASES:
        assert sorted(x.event_id for x in ledger.phase_rows(spark, path, phase).collect()) == list(range(60))
    # rows without an entry are not seen, and are replaced when the batch comes again
    extra = spark.createDataFrame([(1, 77, T0, 1)], SCHEMA)
    extra.union(extra).write.parquet(ledger.place(path, "rows", "raw", 50))
    assert ledger.phase_rows(spark, path, "raw").count() == 60
    for _ in range(2):
        ledger.two_phase_table(path, enrich)(extra, 50)
    for phase in ledger.PHASES:
        assert ledger.phase_rows(spark, path, phase).where("event_id = 77").count() == 1
    assert ledger.ledger(spark, path).count() == 8
    ledger.two_phase_table(path, enrich)(extra.limit(0), 51)
    assert ledger.ledger(spark, path).where("batch = 51 and n_rows = 0").count() == 2
