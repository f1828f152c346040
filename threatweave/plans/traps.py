"""Trap export cycle: stored events to sessions to acknowledged delivery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatweave.operators import sessions as S
from threatweave.operators import store


def export_cycle(events: DataFrame, acks: DataFrame, deliver: store.Deliver, gap: str = "300s") -> tuple[DataFrame, DataFrame]:
    """One cycle; returns (new acknowledgements, counts)."""
    waiting = store.unacked(store.dedupe_events(events), acks)
    sessions = S.trap_sessions(waiting, gap)
    delivered = store.deliver_sessions(sessions, deliver)
    done = store.acks_of(S.session_members(waiting, gap), delivered)
    return done, store.export_counts(delivered, done)


def accept_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Example delivery that refuses single-event sessions."""
    for pdf in batches:
        yield pd.DataFrame({"session_id": pdf["session_id"], "acked": pdf["event_count"] > 1})


def session_rows(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id", "source", "event_count", F.array_join("actions", ",").alias("actions"), "confidence",
        F.unix_micros("start_time").alias("start_at"), F.unix_micros("end_time").alias("end_at"),
    )


def pattern_rows(sessions: DataFrame) -> DataFrame:
    """Sessions per attack pattern and source kind."""
    return (
        sessions.select(F.explode("attack_patterns").alias("pattern"), "event_count")
        .groupBy("pattern").agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"))
    )
