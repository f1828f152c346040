"""Correlation jobs: rule matching, alerts and reports over a table of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatweave.functions.fixed import ENTITY_FIELDS
from threatweave.functions.raw import with_fields
from threatweave.operators import alerts as A
from threatweave.operators.adapt import adapt_events
from threatweave.operators.normalize import normalize_events, run_counters, split_rejects
from threatweave.operators.rules import rule_tables
from threatweave.operators.sequence import match_sequences
from threatweave.session import shared_dir


def correlate(events: DataFrame, ruleset: dict, retention: str = "6h", dedupe: bool = True, bucket: str = "10m") -> DataFrame:
    """Events and rules to alerts, as one job."""
    rules, steps = rule_tables(events.sparkSession, ruleset)
    chains = match_sequences(events, rules, steps, retention)
    return A.build_alerts(chains, events, rules, steps, dedupe, bucket)


def chain_list(events: DataFrame, ruleset: dict) -> DataFrame:
    """Completed chains as text, one row per rule and start event."""
    rules, steps = rule_tables(events.sparkSession, ruleset)
    return match_sequences(events, rules, steps).select(
        "rule_id", F.array_join(F.col("ords").cast("array<string>"), ">").alias("chain"), "start_at", "end_at"
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "rule_id", F.array_join("event_ids", ">").alias("chain"), "severity", "severity_score",
        F.round("confidence", 6).alias("confidence"), "key_entity", "bucket",
    )


def alert_keys(alerts: DataFrame) -> DataFrame:
    return alerts.select("rule_id", F.array_join("event_ids", ">").alias("chain"), "key_entity", "bucket", "completion_ord")


def alert_scores(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "rule_id", F.array_join("event_ids", ">").alias("chain"), "severity_score",
        F.round("confidence", 6).alias("confidence"), F.round("entity_strength", 6).alias("entity_strength"),
        F.array_join("scoring_notes", "|").alias("notes"),
    )


def alert_steps(alerts: DataFrame) -> DataFrame:
    """One row per explained step of each alert, with the entity that linked it."""
    step = F.col("step")
    link = F.filter("matches", lambda m: m["transition"] == F.concat_ws("->", (step["step_index"] - 1).cast("string"), step["step_index"].cast("string")))
    return (
        alerts.select(
            "rule_id", "start_ord", F.col("explanation.entity_matches").alias("matches"),
            F.explode("explanation.steps").alias("step"),
        )
        .withColumn("link", F.get(link, F.lit(0)))
        .select(
            "rule_id", "start_ord", step["step_index"].alias("step_index"),
            step["expected_event_type"].alias("event_type"), step["matched_event_id"].alias("event_id"),
            F.coalesce(step["seconds_from_prev"], F.lit(-1)).alias("seconds_from_prev"),
            F.coalesce("link.path", F.lit("")).alias("path"), F.coalesce("link.value", F.lit("")).alias("value"),
        )
    )


def alert_entities(alerts: DataFrame) -> DataFrame:
    """Entities found along each alert, as ``field=value`` text in contract order."""
    found = [
        F.when(F.try_element_at("matched_entities", F.lit(f)).isNotNull(),
               F.concat(F.lit(f"{f}="), F.try_element_at("matched_entities", F.lit(f))))
        for f in ENTITY_FIELDS
    ]
    return alerts.select("rule_id", "start_ord", F.concat_ws(";", *found).alias("entities"))


def rule_report(alerts: DataFrame) -> DataFrame:
    """Alert counts and mean confidence per rule."""
    return alerts.groupBy("rule_id").agg(
        F.count("*").alias("alerts"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.max("severity_score").alias("max_severity_score"),
    )


def normalized(raw: DataFrame, strict: bool, now=None) -> DataFrame:
    """Adapt by kind and normalise; rows without a source are errors."""
    return normalize_events(adapt_events(with_fields(raw)), source=None, strict=strict, now=now)


def event_rows(events: DataFrame) -> DataFrame:
    """Normalised events with nested columns as text."""
    blank = F.lit("")
    return events.select(
        "ord", "event_type", "source", "severity", F.round("confidence", 9).alias("confidence"),
        F.unix_micros("ts").alias("ts_us"), F.coalesce("stage", blank).alias("stage"),
        F.array_join("tags", "|").alias("tags"),
        *[F.coalesce(f"entities.{f}", blank).alias(f) for f in ENTITY_FIELDS],
    )


def replay(raw: DataFrame, ruleset: dict, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw events to (alerts, rejects, counters).

    Records are dealt evenly and normalised once, into files of the shared folder: each
    step of a rule, the alerts and the counters read the few columns they need from there.
    """
    spark = raw.sparkSession
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}/normalized"
    normalized(raw.repartition("ord"), strict).write.parquet(folder)
    norm = spark.read.parquet(folder)
    good, rejects = split_rejects(norm)
    alerts = correlate(good, ruleset)
    return alerts, rejects, run_counters(norm, alerts)
