"""Keyed state: the sliding feature window per device, and liveness from heartbeats."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldpulse.functions.payload import numeric_values
from fieldpulse.schemas import FEATURE_WIDTH, FEATURE_WINDOW

VECTOR_COLUMNS = ["id", "device_id", "device_type", "ts", "payload", "features"]
VECTOR_SCHEMA = "id bigint, device_id string, device_type string, ts timestamp, payload string, features array<double>"


SLICE = 2_000_000  # numbers worked on together
BUCKETS = 4 * 1024  # groups of devices in a large fleet; each is one call with all its rows of a batch


class RecentReadings(StatefulProcessor):
    """Keeps the numbers of a device's last readings and emits one feature vector per reading.

    Devices come in groups, so that a call is worth its cost: its rows are sorted by (device, ts, id) and
    the statistics of all its devices are computed at once, `SLICE` numbers at a time. Beside the
    rows of the group, which `maxFilesPerTrigger` bounds, memory does not grow. The state is a map
    from device to its last `size` readings; only the devices of a batch are read and written.
    With `forget_after_ms` a device goes from it after being silent for that long.
    """

    def __init__(self, size: int = FEATURE_WINDOW, forget_after_ms: int | None = None) -> None:
        self.size = size
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getMapState("recent", "device_id string", "readings array<array<double>>", self.forget_after_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        code, names = pd.factorize(frame["device_id"], use_na_sentinel=False)
        order = np.lexsort((frame["id"].to_numpy(), frame["ts"].to_numpy(), code))
        numbers = frame["values"].to_numpy()[order]
        begin = np.searchsorted(code[order], np.arange(len(names) + 1))
        values, device, first, source = [], [], [], []
        for i, name in enumerate(names):
            name = "" if name is None or name is pd.NA or name != name else "=" + name
            kept = self.recent.getValue((name,))
            before = [np.asarray(v, float) for v in kept[0]] if kept else []
            own = [np.asarray(v, float) for v in numbers[begin[i] : begin[i + 1]]]
            self.recent.updateValue((name,), ([v.tolist() for v in (before + own)[-self.size :]],))
            values += before + own
            device += [i] * (len(before) + len(own))
            first += [not before and j == 0 for j in range(len(before) + len(own))]
            source += [-1] * len(before) + order[begin[i] : begin[i + 1]].tolist()
        device, first, source = np.array(device), np.array(first), np.array(source)
        step = max(1, SLICE // (self.size * max(1, max(map(len, values)))))
        for at in range(0, len(values), step):
            back = max(0, at - self.size + 1)
            part = slice(back, at + step)
            vectors = feature_rows(values[part], device[part], first[part], self.size)
            new = np.flatnonzero(source[at : at + step] >= 0)
            out = frame.iloc[source[at : at + step][new]]
            yield out.drop(columns=["values", "group"], errors="ignore").assign(features=list(vectors[at - back :][new]))[VECTOR_COLUMNS]

    def close(self) -> None:
        pass


def feature_rows(values: list[np.ndarray], device: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A feature vector for each reading: its numbers, and the statistics of its device's last `size` readings.

    Readings are in order of device and time. Mean, deviation, least and greatest are those of all
    numbers together; a device's first reading has four copies of its first number.
    """
    n = len(values)
    count = np.fromiter(map(len, values), np.int64, n)
    width = max(int(count.max(initial=0)), 1)
    there = np.arange(width) < count[:, None]
    padded = np.zeros((n, width))
    padded[there] = np.concatenate([np.zeros(0), *values])

    def windows(a: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.pad(a, ((size - 1, 0), (0, 0))), size, axis=0)

    same = windows(device[:, None] + 1) == device[:, None, None] + 1
    inside, numbers = (windows(there) & same).reshape(n, -1), windows(padded).reshape(n, -1)
    total = inside.sum(axis=1)
    mean = numbers.sum(axis=1, where=inside) / np.maximum(total, 1)
    std = np.sqrt(((numbers - mean[:, None]) ** 2).sum(axis=1, where=inside) / np.maximum(total, 1))
    low = numbers.min(axis=1, where=inside, initial=np.inf)
    high = numbers.max(axis=1, where=inside, initial=-np.inf)
    stats = np.where(total[:, None] > 0, np.stack([mean, std, low, high], axis=1), 0.0)
    stats[first] = padded[first, :1]
    vectors = np.zeros((n, max(width, FEATURE_WIDTH) + 4))
    vectors[:, :width] = padded
    for j in range(4):
        vectors[np.arange(n), count + j] = stats[:, j]
    return vectors[:, :FEATURE_WIDTH]


def stateful_features(
    readings: DataFrame, size: int = FEATURE_WINDOW, forget_after_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Streaming form of the feature vectors; the window per device lives in the state store.

    `buckets` belongs to the checkpoint: a query must be restarted with the same number.
    """
    rows = readings.select("id", F.col("device_id").cast("string").alias("device_id"), "device_type", "ts", "payload")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("device_id"), F.lit(buckets)))
    # dealt out before the payloads are read: files that cannot be split would have it done in one task
    grouped = rows.repartition("group").withColumn("values", numeric_values(F.col("payload"))).groupBy("group")
    return grouped.transformWithStateInPandas(
        RecentReadings(size, forget_after_ms), outputStructType=VECTOR_SCHEMA, outputMode="Append",
        timeMode="None" if forget_after_ms is None else "ProcessingTime",
    )


class Liveness(StatefulProcessor):
    """Node status from heartbeats and silence; emits a row on every change."""

    def __init__(self, timeout_ms: int, event_time: bool) -> None:
        self.timeout_ms = timeout_ms
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "status string, last_ms bigint")

    def _now(self, timers: Any) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _change(self, key: Any, status: str, at_ms: int) -> Row:
        return Row(node_id=key[0], status=status, changed_at_ms=at_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = max(row["ms"] for row in rows)
        status, last = self.node.get() if self.node.exists() else ("joining", 0)
        last = max(last, newest if self.event_time else self._now(timerValues))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in ("joining", "suspect"):
            status = "alive"
            yield self._change(key, status, last)
        if status not in ("dead", "leaving"):
            # one past the limit: exactly at the timeout a node still counts as alive
            self.handle.registerTimer(last + self.timeout_ms + 1)
        self.node.update((status, last))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, last = self.node.get()
        silent = max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()) - last
        after = "dead" if silent > 2 * self.timeout_ms else "suspect"
        if after == "suspect":
            self.handle.registerTimer(last + 2 * self.timeout_ms + 1)
        if after != status:
            self.node.update((after, last))
            yield self._change(key, after, last + silent)

    def close(self) -> None:
        pass


def liveness_changes(
    heartbeats: DataFrame, timeout_seconds: float = 10.0, event_time: bool = False, lateness: str = "1 minute"
) -> DataFrame:
    """Stream of (node_id, ts) -> stream of status changes.

    In processing time a node is suspected when nothing has come for the timeout; in
    event time when the watermark has passed its last heartbeat by the timeout. Heartbeats
    may arrive up to `lateness` out of order in event time.
    """
    beats = heartbeats.withWatermark("ts", lateness) if event_time else heartbeats
    rows = beats.select(F.col("node_id").cast("string").alias("node_id"), "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("node_id").transformWithState(
        Liveness(int(timeout_seconds * 1000), event_time),
        outputStructType="node_id string, status string, changed_at_ms bigint",
        outputMode="Append",
        timeMode="EventTime" if event_time else "ProcessingTime",
    )
