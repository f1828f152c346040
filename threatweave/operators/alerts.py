"""From completed chains to scored, explained and de-duplicated alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatweave.functions.columns import parse_window
from threatweave.functions.fixed import (
    ENTITY_FIELDS,
    KEY_ENTITY_PREFERENCE,
    NOTE_BUMPED,
    NOTE_WEAK_ENTITY,
    NOTE_WEAK_EVIDENCE,
    SEVERITY_SCORES,
)


def assemble_chains(chains: DataFrame, events: DataFrame) -> DataFrame:
    """Attach the events of each chain as ``chain``, an array in step order.

    Chains travel as narrow lists of ``ord``; the events are joined once here,
    whatever the number of steps.
    """
    slots = chains.select("rule_id", "start_ord", "start_at", "end_at", F.posexplode("ords").alias("pos", "ord"))
    payload = events.select(
        "ord",
        F.struct(
            "event_id", F.unix_micros("ts").alias("at"), "ord", "event_type", "source",
            "severity", "confidence", "tags", "entities",
        ).alias("event"),
    )
    return (
        slots.join(payload, "ord")
        # A group is one chain, so its list is as long as its rule.
        .groupBy("rule_id", "start_ord", "start_at", "end_at")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "event"))).alias("slots"))
        .select("rule_id", "start_ord", "start_at", "end_at", F.col("slots.event").alias("chain"))
    )


def key_entity(chain: str = "chain", preference=KEY_ENTITY_PREFERENCE) -> Column:
    """First non-blank entity, by preferred path and then by chain order."""
    choices = []
    for field in preference:
        values = F.col(f"{chain}.entities.{field}")
        filled = F.filter(values, lambda v: F.length(F.trim(v)) > 0)
        choices.append(F.concat(F.lit(f"entities.{field}="), F.get(filled, F.lit(0))))
    return F.coalesce(*choices, F.lit("no_key_entity"))


def with_signature(alerts: DataFrame, bucket: str = "10m", preference=KEY_ENTITY_PREFERENCE) -> DataFrame:
    """Add what identifies one incident: key entity and time bucket of the first event."""
    size_us = max(1, parse_window(bucket)) * 1_000_000
    last_at = F.col("end_at")
    completed = F.array_max(
        F.transform(F.filter("chain", lambda e: e["at"] == last_at), lambda e: e["ord"])
    )
    return alerts.withColumns(
        {
            "key_entity": key_entity("chain", preference),
            "bucket": F.floor(F.col("start_at") / size_us),
            "completion_ord": completed,
        }
    )


def dedupe_alerts(chains: DataFrame, bucket: str = "10m", preference=KEY_ENTITY_PREFERENCE) -> DataFrame:
    """Keep the first alert to complete per rule, key entity and bucket.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a
    crowded signature sends one row per task.
    """
    signed = with_signature(chains, bucket, preference)
    first = Window.partitionBy("rule_id", "key_entity", "bucket").orderBy(
        "end_at", "completion_ord", "start_at", "start_ord"
    )
    return signed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _entity_map(event: Column) -> Column:
    pairs = [x for f in ENTITY_FIELDS for x in (F.lit(f"entities.{f}"), event["entities"][f])]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.length(F.trim(v)) > 0)


def explain_chains(chains: DataFrame, steps: DataFrame) -> DataFrame:
    """Add per-step explanation and the shared entity of each transition."""
    per_rule = (
        steps.groupBy("rule_id")
        .agg(F.sort_array(F.collect_list(F.struct("step_no", "event_type", "same"))).alias("rule_steps"))
    )
    with_rule = chains.join(F.broadcast(per_rule), "rule_id")

    def step(e: Column, i: Column) -> Column:
        before = F.get(F.col("chain"), i - 1)
        delta = F.when(i > 0, F.floor((e["at"] - before["at"]) / 1_000_000))
        return F.struct(
            i.alias("step_index"),
            F.get(F.col("rule_steps"), i)["event_type"].alias("expected_event_type"),
            e["event_id"].alias("matched_event_id"),
            e["at"].alias("matched_at"),
            delta.alias("seconds_from_prev"),
            F.lit(True).alias("where_checks_passed"),
        )

    def link(i: Column) -> Column:
        prev = F.try_element_at(F.col("chain_entities"), i)
        cur = F.try_element_at(F.col("chain_entities"), i + 1)
        same = F.try_element_at(F.col("rule_steps"), i + 1)["same"]
        path = F.get(F.filter(same, lambda p: F.try_element_at(prev, p) == F.try_element_at(cur, p)), F.lit(0))
        return F.struct(
            F.concat_ws("->", (i - 1).cast("string"), i.cast("string")).alias("transition"),
            (F.size(same) > 0).alias("constrained"),
            path.alias("path"),
            F.try_element_at(cur, path).alias("value"),
        )

    return (
        with_rule.withColumn("explanation_steps", F.transform("chain", step))
        .withColumn("chain_entities", F.transform("chain", _entity_map))
        .withColumn("_links", F.transform(F.sequence(F.lit(1), F.size("chain") - 1), link))
        .withColumn(
            "entity_matches",
            F.transform(
                F.filter("_links", lambda m: m["path"].isNotNull()),
                lambda m: F.struct(m["transition"].alias("transition"), m["path"].alias("path"), m["value"].alias("value")),
            ),
        )
        .withColumn("entity_strength", entity_strength("_links"))
        .drop("_links", "chain_entities", "rule_steps")
    )


def entity_strength(links: str) -> Column:
    """Mean of 1.0 per matched and 0.5 per unmatched constrained transition; 1.0 if none."""
    marks = F.transform(
        F.filter(links, lambda m: m["constrained"]),
        lambda m: F.when(m["path"].isNotNull(), F.lit(1.0)).otherwise(F.lit(0.5)),
    )
    total = F.aggregate(marks, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(marks) > 0, total / F.size(marks)).otherwise(F.lit(1.0))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def harmonic_mean(values: Column) -> Column:
    """Harmonic mean of the positive values; 0 when there is none."""
    good = F.filter(values, lambda v: v > 0)
    inverse = F.aggregate(good, F.lit(0.0), lambda a, v: a + F.lit(1.0) / v)
    return F.when(F.size(good) > 0, F.size(good) / inverse).otherwise(F.lit(0.0))


def score_chains(chains: DataFrame, rules: DataFrame) -> DataFrame:
    """Add alert confidence, severity score and scoring notes.

    Needs ``entity_strength`` from :func:`explain_chains`.
    """
    meta = rules.select(
        "rule_id", F.col("name").alias("rule_name"), "description",
        F.col("severity").alias("rule_severity"), F.col("confidence").alias("rule_confidence"),
    )
    base = F.lit(None).cast("int")
    for label, points in SEVERITY_SCORES.items():
        base = F.when(F.col("rule_severity") == label, F.lit(points)).otherwise(base)
    severities = F.transform("chain.severity", lambda s: F.coalesce(s, F.lit(1)))
    confidences = F.transform("chain.confidence", lambda c: _clamp(F.coalesce(c, F.lit(0.0))))
    mean_severity = F.aggregate(severities, F.lit(0.0), lambda a, s: a + s) / F.size("chain")
    scored = chains.join(F.broadcast(meta), "rule_id").withColumns(
        {
            "evidence": harmonic_mean(confidences),
            "base_score": F.coalesce(base, F.lit(5)),
            "mean_severity": mean_severity,
        }
    )
    bumped = (F.col("mean_severity") >= 8) & (F.col("base_score") < 9)
    strength = _clamp(F.col("entity_strength"))
    combined = (0.60 * _clamp(F.col("rule_confidence")) + 0.40 * F.col("evidence")) * strength
    return scored.select(
        *chains.columns,
        "rule_name",
        F.when(F.length("description") > 0, F.col("description")).otherwise(F.col("rule_name")).alias("description"),
        "rule_severity",
        "rule_confidence",
        F.col("rule_severity").alias("severity"),
        F.when(bumped, F.col("base_score") + 1).otherwise(F.col("base_score")).alias("severity_score"),
        _clamp(combined).alias("confidence"),
        F.array_compact(
            F.array(
                F.when(F.col("evidence") < 0.5, F.lit(NOTE_WEAK_EVIDENCE)),
                F.when(strength < 0.75, F.lit(NOTE_WEAK_ENTITY)),
                F.when(bumped, F.lit(NOTE_BUMPED)),
            )
        ).alias("scoring_notes"),
    )


def matched_entities(chain: str = "chain") -> Column:
    """First non-null value of each entity over the chain, as a map; blanks are kept."""
    pairs = []
    for field in ENTITY_FIELDS:
        known = F.filter(F.col(f"{chain}.entities.{field}"), lambda v: v.isNotNull())
        pairs += [F.lit(field), F.get(known, F.lit(0))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def build_alerts(chains: DataFrame, events: DataFrame, rules: DataFrame, steps: DataFrame, dedupe: bool = True, bucket: str = "10m") -> DataFrame:
    """Alert records from completed chains."""
    full = assemble_chains(chains, events)
    # Duplicates leave before the wide columns are computed.
    full = dedupe_alerts(full, bucket) if dedupe else with_signature(full, bucket)
    scored = score_chains(explain_chains(full, steps), rules)
    identity = F.concat_ws("|", "rule_id", F.array_join("chain.event_id", ","))
    return scored.select(
        F.sha2(identity, 256).alias("alert_id"),
        "rule_id", "rule_name", "description", "rule_severity", "rule_confidence",
        "severity", "severity_score", "confidence",
        F.col("chain.event_id").alias("event_ids"),
        F.col("chain").alias("events"),
        matched_entities().alias("matched_entities"),
        F.struct(F.col("explanation_steps").alias("steps"), "entity_matches").alias("explanation"),
        "entity_strength",
        "scoring_notes",
        "key_entity", "bucket", "start_at", "end_at", "start_ord", "completion_ord",
    )
