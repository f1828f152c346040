"""Insert-once event tables and acknowledged delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatweave.session import cut


def dedupe_events(events: DataFrame, key: str = "event_id", order: str = "ord") -> DataFrame:
    """First write per id wins."""
    first = Window.partitionBy(key).orderBy(order)
    return events.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def insert_new(batch: DataFrame, stored: DataFrame, key: str = "event_id", order: str = "ord") -> DataFrame:
    """Rows of ``batch`` to append: new ids only, each once."""
    return dedupe_events(batch, key, order).join(stored.select(key), key, "left_anti")


def unacked(events: DataFrame, acks: DataFrame, key: str = "event_id") -> DataFrame:
    """Events without an acknowledgement."""
    return events.join(acks.select(key), key, "left_anti")


def in_time_order(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.orderBy(ts)


Deliver = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def deliver_sessions(sessions: DataFrame, deliver: Deliver) -> DataFrame:
    """Hand each partition of sessions to ``deliver``; returns (session_id, acked).

    ``deliver`` yields frames with ``session_id`` and boolean ``acked``. It runs
    once per task attempt, so delivery is at least once. The answer is written
    down before anything reads it, so reading it again delivers nothing.
    """
    return cut(sessions.mapInPandas(deliver, "session_id string, acked boolean"))


def acks_of(members: DataFrame, delivered: DataFrame) -> DataFrame:
    """Event ids of acknowledged sessions, to append to the acks table."""
    return members.join(delivered.filter("acked").select("session_id"), "session_id", "left_semi").select("event_id", "session_id")


def export_counts(sessions: DataFrame, acks: DataFrame) -> DataFrame:
    """One row: exported events and sessions seen."""
    return acks.agg(F.count("*").alias("exported")).crossJoin(sessions.agg(F.count("*").alias("sessions")))
