"""Event-driven behaviour: quotas, debounced triggers, latest values.

Each has a batch form (windows or aggregates over a table of events) and a
streaming form over an unbounded one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 20
GAP = "2 seconds"


def quota(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``events`` (device_id, ts, event_id, success) with admitted and remaining.

    A request is admitted while the device has had fewer than ``limit``
    successes; an admitted one counts if it succeeds.
    """
    before = Window.partitionBy("device_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum(F.col("success").cast("bigint")).over(before), F.lit(0))
    now = F.least(F.lit(limit), prior + F.col("success"))
    return events.withColumn("admitted", prior < limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - now).cast("bigint"))


def usage(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Successes counted for each device, at most ``limit``."""
    return events.groupBy("device_id").agg(F.least(F.lit(limit), F.sum("success")).cast("bigint").alias("used"))


def quota_stream(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The quota over a stream: a device's count is state, kept in checkpoints."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        admitted, remaining = [], []
        for ok in rows["success"]:
            admitted.append(used < limit)
            used += int(used < limit and ok > 0)
            remaining.append(max(0, limit - used))
        state.update((used,))
        yield pd.DataFrame({"device_id": rows["device_id"], "event_id": rows["event_id"], "admitted": admitted, "remaining": remaining})

    return events.groupBy("device_id").applyInPandasWithState(admit, "device_id bigint, event_id bigint, admitted boolean, remaining bigint", "used bigint", "append", GroupStateTimeout.NoTimeout)


def quota_stream_expiring(events: DataFrame, limit: int = LIMIT, idle_ms: int = 86_400_000, late: str = "1 minute") -> DataFrame:
    """``quota_stream`` that forgets devices: one without an event for more than ``idle_ms`` starts anew.

    Whether it does is told by the times of its events alone, not by when
    batches ran; the timer only takes away state that no event can need. Events
    more than ``late`` behind the last one seen are dropped.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, seen = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        admitted, remaining = [], []
        for t, ok in zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), rows["success"]):
            if seen is not None and t - seen > idle_ms * 1000:
                used = 0
            seen = t if seen is None else max(seen, t)
            admitted.append(used < limit)
            used += int(used < limit and ok > 0)
            remaining.append(max(0, limit - used))
        state.update((used, seen))
        state.setTimeoutTimestamp(max(seen // 1000 + idle_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"device_id": rows["device_id"], "event_id": rows["event_id"], "admitted": admitted, "remaining": remaining})

    rows = events.where("ts is not null").withWatermark("ts", late).groupBy("device_id")
    return rows.applyInPandasWithState(admit, "device_id bigint, event_id bigint, admitted boolean, remaining bigint", "used bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def debounced(events: DataFrame, gap: str = GAP) -> DataFrame:
    """One trigger for each burst of events of a key, at the end of its quiet time. Batch or (with a watermark) stream."""
    return events.groupBy("device_id", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("n_events")).select("device_id", F.col("burst.start").alias("started"), F.col("burst.end").alias("fires"), "n_events")


def fire_at_edge(events: DataFrame, gap_ms: int = 2000, late: str = "1 minute", merge_at_edge: bool = False) -> DataFrame:
    """device_id, started, fires, n_events of each burst of a stream, by a timer for each device.

    A burst fires ``gap_ms`` after its last event, once the watermark says that
    none can come before. An event at the very time at which the timer is due
    comes after it and starts a new burst, unless ``merge_at_edge`` (then as
    ``debounced``). Events may come in any order within ``late``; later ones are
    dropped. State is the bursts that have not fired, and goes with the last.
    """
    gap = gap_ms * 1000

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bursts = sorted(zip(*state.get)) if state.exists else []
        for batch in batches:
            bursts += [(t, t, 1) for t in batch["ts"].astype("datetime64[us]").astype("int64").tolist()]
        merged: list[list[int]] = []
        for first, last, n in sorted(bursts):
            if merged and (first - merged[-1][1] < gap or merge_at_edge and first - merged[-1][1] == gap):
                merged[-1] = [merged[-1][0], max(last, merged[-1][1]), merged[-1][2] + n]
            else:
                merged.append([first, last, n])
        now = state.getCurrentWatermarkMs() * 1000
        due = [b for b in merged if b[1] + gap <= now]
        left = [b for b in merged if b[1] + gap > now]
        if left:
            state.update(tuple(list(x) for x in zip(*left)))
            state.setTimeoutTimestamp(-(-min(b[1] + gap for b in left) // 1000))
        elif state.exists:
            state.remove()
        at = lambda values: pd.to_datetime(pd.Series(values, dtype="int64"), unit="us")
        yield pd.DataFrame({"device_id": [key[0]] * len(due), "started": at([b[0] for b in due]), "fires": at([b[1] + gap for b in due]), "n_events": [b[2] for b in due]})

    rows = events.where("ts is not null").withWatermark("ts", late).groupBy("device_id")
    return rows.applyInPandasWithState(fire, "device_id bigint, started timestamp, fires timestamp, n_events bigint", "firsts array<bigint>, lasts array<bigint>, counts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def debounced_stream(events: DataFrame, gap: str = GAP, late: str = "1 minute") -> DataFrame:
    return debounced(events.withWatermark("ts", late), gap)


def latest(updates: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """The last value of each key (key, seq, value), of those not after its ready time (key, ready_seq) if given."""
    if ready is not None:
        updates = updates.join(ready, "key").where("seq <= ready_seq")
    return updates.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def two_phase(batch_writer: Callable[[DataFrame, str], None], enrich: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hand over raw results at once, then the enriched ones under the same ids."""

    def of(batch: DataFrame, _: int) -> None:
        batch_writer(batch, "raw")
        batch_writer(enrich(batch), "enriched")

    return of
