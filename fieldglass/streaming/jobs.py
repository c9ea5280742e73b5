"""Structured Streaming jobs built on the batch definitions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldglass.functions.vectors import METHODS
from fieldglass.sources.versions import write_version


def events_per_window(events: DataFrame, time_col: str, width: str) -> DataFrame:
    """Events per tumbling window; the same plan serves batch and stream."""
    return events.groupBy(F.window(time_col, width).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("start"), "events"
    )


def events_per_second(stream: DataFrame, time_col: str, late: str = "10 seconds") -> DataFrame:
    """Rate per second; a second is emitted once the watermark has passed it, later events are dropped."""
    return events_per_window(stream.withWatermark(time_col, late), time_col, "1 second")


def _score(current: list[float], baseline: list[float], method: str) -> float:
    import numpy as np

    p, q = np.asarray(current, dtype=float), np.asarray(baseline, dtype=float)
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    if method == "euclidean":
        return float(np.sqrt(((p - q) ** 2).sum()))
    if method == "wasserstein":
        return float(np.abs(np.sort(p) - np.sort(q)).mean())
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log(p / m), 0.0) + np.where(q > 0, q * np.log(q / m), 0.0)
    return float(np.sqrt(max(terms.sum() / 2, 0.0)))


class DriftState(StatefulProcessor):
    """Keeps the last distribution of each entity and scores the next one against it."""

    def __init__(self, key: str, key_type: str, time_col: str, bins: list[str], method: str):
        self.key, self.time_col, self.bins, self.method = key, time_col, bins, method

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "dist array<double>, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(self.time_col)
        previous = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, values in zip(data[self.time_col], data[self.bins].fillna(0.0).to_numpy(dtype=float)):
            mass = values.sum()
            dist = (values / mass if mass > 0 else values).tolist()
            out.append((key[0], ts, 0.0 if previous is None else _score(dist, list(previous), self.method)))
            previous = dist
        self.last.update((previous, data[self.time_col].iloc[-1].to_pydatetime()))
        yield pd.DataFrame(out, columns=[self.key, self.time_col, "score"])

    def close(self) -> None:
        pass


def drift_stream(stream: DataFrame, key: str, time_col: str, bins: list[str], method: str = "jensenshannon") -> DataFrame:
    """Drift scores as rows arrive: one row per entity and time step, in time order within a batch.

    Needs the RocksDB state store. The state is one distribution per entity, so
    input should arrive aggregated per time step.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    key_type = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=DriftState(key, key_type, time_col, bins, method),
        outputStructType=f"{key} {key_type}, {time_col} timestamp, score double",
        outputMode="append",
        timeMode="none",
    )


class EventTimeDrift(StatefulProcessor):
    """Sums arriving rows by time step and scores the steps the watermark has passed, in order of time.

    State of an entity: its open steps, its last closed distribution and the time until that is kept.
    """

    def __init__(self, key: str, time_col: str, bins: list[str], method: str, keep_ms: int):
        self.key, self.time_col, self.bins, self.method, self.keep_ms = key, time_col, bins, method, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "step long", "mass array<double>")
        self.last = handle.getValueState("last", "dist array<double>, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            steps = batch[self.time_col].to_numpy().astype("datetime64[us]").astype("int64")
            sums = batch[self.bins].fillna(0.0).astype(float).groupby(steps).sum()
            for step, mass in zip(sums.index.tolist(), sums.to_numpy()):
                held = self.open.getValue((step,)) if self.open.containsKey((step,)) else None
                if held is None:
                    self.handle.registerTimer(-(-step // 1000))
                self.open.updateValue((step,), ((mass if held is None else mass + held[0]).tolist(),))
        yield pd.DataFrame(columns=[self.key, self.time_col, "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import numpy as np

        passed = timerValues.getCurrentWatermarkInMs()
        closed = sorted((step, mass) for (step,), (mass,) in self.open.iterator() if step <= passed * 1000)
        before = self.last.get() if self.last.exists() else None
        if not closed:
            if before is not None and before[1] <= passed:
                self.last.clear()
            yield pd.DataFrame(columns=[self.key, self.time_col, "score"])
            return
        mass = np.array([m for _, m in closed], dtype=float)
        total = mass.sum(axis=1, keepdims=True)
        dist = np.divide(mass, total, out=mass.copy(), where=total > 0)
        steps = np.array([step for step, _ in closed], dtype="int64")
        known = before is not None and steps[0] <= before[1] * 1000
        base = np.vstack([before[0] if known else np.zeros(len(self.bins)), dist[:-1]])
        fresh = np.concatenate([[not known], np.diff(steps) > self.keep_ms * 1000])  # the step before is forgotten
        scores = np.where(fresh, 0.0, _score_rows(dist, base, self.method))
        for step in steps.tolist():
            self.open.removeKey((step,))
        until = -(-int(steps[-1]) // 1000) + self.keep_ms
        self.last.update((dist[-1].tolist(), until))
        self.handle.registerTimer(until)
        yield pd.DataFrame({self.key: [key[0]] * len(steps), self.time_col: steps.astype("datetime64[us]"), "score": scores})

    def close(self) -> None:
        pass


def _score_rows(current, baseline, method: str):
    """Score of each row of a matrix against the same row of another; a row without mass scores 0."""
    import numpy as np

    if method == "euclidean":
        score = np.sqrt(((current - baseline) ** 2).sum(axis=1))
    elif method == "wasserstein":
        score = np.abs(np.sort(current, axis=1) - np.sort(baseline, axis=1)).mean(axis=1)
    else:
        middle = (current + baseline) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(current > 0, current * np.log(current / middle), 0.0)
            terms += np.where(baseline > 0, baseline * np.log(baseline / middle), 0.0)
        score = np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0.0))
    return np.where((current.sum(axis=1) > 0) & (baseline.sum(axis=1) > 0), score, 0.0)


def drift_stream_by_event_time(
    stream: DataFrame,
    key: str,
    time_col: str,
    bins: list[str],
    method: str = "jensenshannon",
    late: str = "1 hour",
    keep: timedelta = timedelta(days=30),
) -> DataFrame:
    """Drift scores whatever the order of arrival: rows of an entity and time step are added up, and a step is scored once the
    watermark has passed it, against the step before it in time.

    Rows older than ``late`` are dropped by the watermark, and rows without a time. An entity's last distribution is forgotten when
    no step follows within ``keep``; its next step then scores 0 as a first one. The state of an entity is
    one distribution and its steps within ``late``. Needs the RocksDB state store.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    key_type = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(time_col).cast("timestamp").alias(time_col), *bins).filter(F.col(time_col).isNotNull())
    return rows.withWatermark(time_col, late).groupBy(key).transformWithStateInPandas(
        statefulProcessor=EventTimeDrift(key, time_col, bins, method, keep // timedelta(milliseconds=1)),
        outputStructType=f"{key} {key_type}, {time_col} timestamp, score double",
        outputMode="append",
        timeMode="EventTime",
    )


def ingest_documents(stream: DataFrame, chunker, target: str, checkpoint: str, source: str = "source_doc"):
    """Chunk arriving documents and replace what is stored for their sources in the versioned store ``target``.

    A batch writes its own rows alone, as one version named after it, so a restart repeats nothing.
    ``chunker`` turns a batch of documents into chunk rows with the source column; read the store
    with ``versions.read_live``.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_version(chunker(batch), target, source, f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
