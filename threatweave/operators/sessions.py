"""Gap sessions of trap events per source.

Events shrink to one row per (source, slot) before the shuffle, where a slot is
as long as the gap, so two events of a slot always share a session. Slots are
then chained per source: one row per slot in the time span, however many events
a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatweave.functions.columns import micros, parse_window
from threatweave.functions.fixed import ATTACK_PATTERNS


def source_key(source: str = "source") -> Column:
    """Remote address if there is one, else file path, else ``local``."""
    ip = F.col(f"{source}.remote_ip")
    return F.coalesce(F.when(ip != "", ip), F.col(f"{source}.file_path"), F.lit("local"))


def chain_slots(slots: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Add ``run_start``, the first instant of the gap-free run each slot belongs to.

    ``slots``: keys, slot, first_at, last_at, with slots no longer than the gap.
    """
    order = Window.partitionBy(*keys).orderBy("slot")
    apart = F.coalesce(F.col("first_at") - F.lag("last_at").over(order) > gap_us, F.lit(True))
    return (
        slots.withColumn("_opens", F.when(apart, F.col("first_at")))
        .withColumn(
            "run_start",
            F.last("_opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("_opens")
    )


def _with_slot(events: DataFrame, gap_us: int) -> DataFrame:
    at = micros("ts")
    return events.withColumns({"source_key": source_key(), "at": at, "slot": F.floor(at / gap_us)})


def _slots(events: DataFrame, gap_us: int) -> DataFrame:
    per_slot = (
        _with_slot(events, gap_us)
        .groupBy("source_key", "slot")
        .agg(
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.count("*").alias("n"),
            F.min(F.struct("at", "ord", "event_id")).alias("opening"),
            F.collect_set("action").alias("actions"),
        )
    )
    return chain_slots(per_slot, ["source_key"], gap_us)


def attack_patterns(actions: str | Column, patterns: dict = ATTACK_PATTERNS) -> Column:
    """Names of the patterns that share an action with the session, in table order."""
    actions = F.col(actions) if isinstance(actions, str) else actions
    return F.array_compact(
        F.array(
            *[
                F.when(F.arrays_overlap(actions, F.array(*map(F.lit, needed))), F.lit(name))
                for name, needed in patterns.items()
            ]
        )
    )


def trap_sessions(events: DataFrame, gap: str = "300s", patterns: dict = ATTACK_PATTERNS) -> DataFrame:
    """One row per session. ``events``: event_id, action, source, ts, ord."""
    slots = _slots(events, parse_window(gap) * 1_000_000)
    sessions = slots.groupBy("source_key", "run_start").agg(
        F.min("opening").alias("opening"),
        F.sum("n").alias("event_count"),
        F.max("last_at").alias("end_at"),
        # Actions are a small fixed vocabulary; the list has one entry per slot.
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("actions")))).alias("actions"),
    )
    return sessions.select(
        F.col("opening.event_id").alias("session_id"),
        F.col("source_key").alias("source"),
        "event_count",
        "actions",
        attack_patterns("actions", patterns).alias("attack_patterns"),
        F.lit("HIGH").alias("confidence"),
        F.timestamp_micros("run_start").alias("start_time"),
        F.timestamp_micros("end_at").alias("end_time"),
    )


def session_members(events: DataFrame, gap: str = "300s") -> DataFrame:
    """The events with the ``session_id`` they belong to.

    A table rather than a list per session: a session has no size limit.
    """
    gap_us = parse_window(gap) * 1_000_000
    slots = _slots(events, gap_us)
    run = Window.partitionBy("source_key", "run_start")
    named = slots.select("source_key", "slot", F.min("opening").over(run)["event_id"].alias("session_id"))
    return _with_slot(events, gap_us).join(named, ["source_key", "slot"]).drop("slot", "at", "source_key")
