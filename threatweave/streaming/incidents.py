"""Flow incidents as a stream, with the emit-and-clear rule in keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threatweave.functions.columns import parse_window
from threatweave.operators.incidents import INCIDENT_COLUMNS, STATEFUL_SCHEMA, WindowState, triggers

STATE = "at array<bigint>, label array<string>, port array<int>, conf array<bigint>, p array<double>, m array<double>"


# Incidents handed back at once.
OUT_ROWS = 4096


def in_order(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of one key in one micro-batch as ``ord, at, label, port, conf, p, m, live``, by time and ``ord``.

    All are held, but packed: some 50 bytes each, labels as numbers. The trigger's input
    limit bounds them.
    """
    names: dict = {}
    parts = [(
        b["ord"].to_numpy(), b["at"].to_numpy(np.int64), np.array([names.setdefault(x, len(names)) for x in b["label"]], np.int32),
        b["port"].to_numpy(), b["conf"].to_numpy(np.int8), b["p"].to_numpy(np.float64), b["m"].to_numpy(np.float64), b["live"].to_numpy(bool),
    ) for b in batches]
    columns = []
    for i in range(8):
        columns.append(np.concatenate([p[i] for p in parts]))
        parts = [(*p[:i], None, *p[i + 1:]) for p in parts]
    labels, order = list(names), np.lexsort((columns[0], columns[1]))
    for a in range(0, len(order), OUT_ROWS):
        ord_, at, label, *rest = (c[order[a:a + OUT_ROWS]].tolist() for c in columns)
        for o, t, k, *others in zip(ord_, at, label, *rest):
            yield o, t, labels[k], *others


def incident_stream(alerts: DataFrame, window: str = "30s", delay: str = "1 minute") -> DataFrame:
    """Incidents per triggering alert. State is one window of alerts per key and is
    dropped once the watermark has left it behind."""
    width = parse_window(window) * 1_000_000
    keyed = (
        triggers(alerts)
        .withColumn("event_time", F.timestamp_micros("at"))
        .withWatermark("event_time", delay)
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = WindowState(width, zip(*state.get) if state.exists else ())
        out, last = [], 0
        for ord_, last, *alert in in_order(batches):
            incident = held.push(last, *alert)
            if incident:
                out.append({**incident, "key": key[0], "alert_ord": ord_})
            if len(out) == OUT_ROWS:
                yield pd.DataFrame(out, columns=INCIDENT_COLUMNS)
                out = []
        columns = [list(c) for c in zip(*held.rows)] if held.rows else [[] for _ in range(6)]
        state.update(tuple(columns))
        last_ms = last // 1000
        state.setTimeoutTimestamp(max(last_ms + width // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=INCIDENT_COLUMNS)

    return keyed.groupBy("key").applyInPandasWithState(
        step, STATEFUL_SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def sliding_counts(alerts: DataFrame, window: str = "30 seconds", slide: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Triggering alerts per key over sliding windows."""
    trig = triggers(alerts).filter("live").withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", delay)
    return trig.groupBy("key", F.window("event_time", window, slide)).agg(
        F.count("*").alias("n"), F.sum("conf").alias("confirmed"), F.approx_count_distinct("port").alias("ports")
    )
