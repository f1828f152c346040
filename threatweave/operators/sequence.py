"""Ordered multi-step matching over time and shared entities.

For every event that satisfies step 0 of a rule, step ``i`` takes the earliest
event (by time, then arrival) at or after the previous one that satisfies the
step and shares one of its ``same`` entities, within the step's window, the
rule's span and the retention. There is no backtracking.

No pair of events is ever built. "Earliest candidate at or after t" is a
look-ahead over the distinct instants of one entity value, and it is cut into
short time slices so that a value that holds a large share of all events is
spread over many tasks:

1. both sides shrink to one row per (rule, path, value, instant) before the
   shuffle, so a slice holds at most its own number of microseconds;
2. inside a slice, one pass from the end carries the next candidate back;
3. across slices, the same pass runs over one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatweave.functions.columns import micros, parse_window
from threatweave.operators.rules import eligible_steps, entity_at, step_candidates
from threatweave.session import cut, local_table, use_utc

SLICE_US = 60 * 1_000_000
KEY = ["rule_id", "path_no", "value"]


def _events_in(events: DataFrame) -> DataFrame:
    return events.select(
        "ord", micros("ts").alias("ts_us"), "event_type", "confidence", "severity", "tags", "entities"
    )


PATHS = "rule_id string, path_no int, path string, within_s bigint"
HERE = (
    "rule_id string, event_type string, min_confidence double, min_severity int, tag_any array<string>, "
    "n_steps int, max_span_s bigint, path_no int, path string"
)


def _paths(steps: list[dict]) -> list[tuple]:
    """One entry per rule and ``same`` path of a step; a free step has one empty path."""
    return [(s, n, path) for s in steps for n, path in enumerate(s["same"] or [None])]


def _path_table(spark: SparkSession, steps: list[dict]) -> DataFrame:
    rows = [(s["rule_id"], n, path, s["within_s"]) for s, n, path in _paths(steps)]
    return local_table(spark, rows, PATHS)


def _step_table(spark: SparkSession, steps: list[dict]) -> DataFrame:
    """Step conditions, one row per path; step 0 has no path to follow."""
    rows = [
        (
            s["rule_id"], s["event_type"], s["min_confidence"], s["min_severity"], s["tag_any"],
            s["n_steps"], s["max_span_s"], n, path,
        )
        for s, n, path in (_paths(steps) if steps and steps[0]["step_no"] else [(s, 0, None) for s in steps])
    ]
    return local_table(spark, rows, HERE)


def _value() -> Column:
    # A step without ``same`` compares everything with everything: one shared value.
    return F.when(F.col("path").isNull(), F.lit("")).otherwise(entity_at(F.col("path")))


def _look_ahead(points: DataFrame) -> DataFrame:
    """Earliest candidate at or after each wanted instant of each key.

    ``points``: KEY, at, slice, wanted, cand_ord (lowest arrival order at that
    instant, NULL when the instant has no candidate).
    """
    cand_at = F.when(F.col("cand_ord").isNotNull(), F.col("at"))
    back = Window.partitionBy(*KEY, "slice").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = points.select(
        *KEY, "slice", "at", "wanted",
        F.last(cand_at, ignorenulls=True).over(back).alias("in_at"),
        F.last("cand_ord", ignorenulls=True).over(back).alias("in_ord"),
    ).filter("wanted")

    heads = points.groupBy(*KEY, "slice").agg(
        F.min(cand_at).alias("head_at"),
        F.min_by("cand_ord", cand_at).alias("head_ord"),
        # Reads the same columns as the pass above, so both share one shuffle.
        F.max("wanted").alias("wanted"),
    )
    after = Window.partitionBy(*KEY).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = heads.select(
        *KEY, "slice", "wanted",
        F.last("head_at", ignorenulls=True).over(after).alias("later_at"),
        F.last("head_ord", ignorenulls=True).over(after).alias("later_ord"),
    ).filter("wanted").drop("wanted")
    found = inside.join(later, [*KEY, "slice"], "left")
    return found.select(
        *KEY, "at",
        F.coalesce("in_at", "later_at").alias("next_at"),
        F.coalesce("in_ord", "later_ord").alias("next_ord"),
    ).filter("next_at IS NOT NULL")


def _advance(chains: DataFrame, events: DataFrame, here: list[dict]) -> DataFrame:
    """Extend every open chain by one step; chains without a match fall away."""
    spark = events.sparkSession
    wanted = (
        chains.join(F.broadcast(_path_table(spark, here)), "rule_id")
        .withColumn("value", _value())
        .filter("value IS NOT NULL")
        .select(
            *KEY, F.col("prev_at").alias("at"), "start_ord", "start_at", "limit_at", "n_steps", "ords",
            F.least("limit_at", F.col("prev_at") + F.col("within_s") * 1_000_000).alias("upto"),
        )
    )
    cands = (
        step_candidates(events, _step_table(spark, here))
        .withColumn("value", _value())
        .filter("value IS NOT NULL")
        .select(*KEY, F.col("ts_us").alias("at"), "ord")
    )
    points = (
        wanted.select(*KEY, "at", F.lit(True).alias("wanted"), F.lit(None).cast("bigint").alias("ord"))
        .unionByName(cands.withColumn("wanted", F.lit(False)))
        .groupBy(*KEY, "at")
        .agg(F.max("wanted").alias("wanted"), F.min("ord").alias("cand_ord"))
        .withColumn("slice", F.floor(F.col("at") / SLICE_US))
    )
    nxt = _look_ahead(points)
    best = F.min(F.struct("next_at", "next_ord"))
    return (
        wanted.join(nxt, [*KEY, "at"])
        .filter("next_at <= upto")
        # Several paths may match: the earliest event over all of them counts.
        .groupBy("rule_id", "start_ord")
        .agg(
            best.alias("hit"),
            F.any_value("start_at").alias("start_at"),
            F.any_value("limit_at").alias("limit_at"),
            F.any_value("n_steps").alias("n_steps"),
            F.any_value("ords").alias("ords"),
        )
        .select(
            "rule_id", "start_ord", "start_at", "limit_at", "n_steps",
            F.concat("ords", F.array("hit.next_ord")).alias("ords"),
            F.col("hit.next_at").alias("prev_at"),
            F.col("hit.next_ord").alias("prev_ord"),
        )
    )


def match_sequences(
    events: DataFrame, rules: DataFrame, steps: DataFrame, retention: str = "6h"
) -> DataFrame:
    """Completed chains: rule_id, start_ord, start_at, end_at (micros), ords.

    ``events`` needs ``ord``: a unique BIGINT that keeps arrival order, which
    breaks ties between events of the same instant.
    """
    spark = use_utc(events.sparkSession)
    plan = eligible_steps(rules, steps)
    ev = _events_in(events)
    keep_us = parse_window(retention) * 1_000_000

    span = F.least(F.col("max_span_s") * 1_000_000, F.lit(keep_us))
    chains = step_candidates(ev, _step_table(spark, [s for s in plan if s["step_no"] == 0])).select(
        "rule_id", F.col("ord").alias("start_ord"), F.col("ts_us").alias("start_at"),
        (F.col("ts_us") + span).alias("limit_at"), "n_steps",
        F.array("ord").alias("ords"), F.col("ts_us").alias("prev_at"), "entities",
    )
    done = None
    # As many rounds as the longest rule has steps: a property of the rules, not of the data.
    for step_no in range(1, max((s["n_steps"] for s in plan), default=0)):
        if step_no > 1:
            # Every round reads its chains twice; without a cut a rule of k steps
            # would redo the first round 2^k times.
            chains = open_chains.join(
                ev.select(F.col("ord").alias("prev_ord"), "entities"), "prev_ord"
            )
        chains = _advance(chains, ev, [s for s in plan if s["step_no"] == step_no])
        if any(s["n_steps"] > step_no + 1 for s in plan):
            chains = cut(chains)
        open_chains = chains.filter(F.col("n_steps") > step_no + 1)
        ready = chains.filter(F.col("n_steps") == step_no + 1).select(
            "rule_id", "start_ord", "start_at", F.col("prev_at").alias("end_at"), "ords"
        )
        done = ready if done is None else done.unionByName(ready)
    if done is None:
        done = chains.limit(0).select("rule_id", "start_ord", "start_at", F.col("start_at").alias("end_at"), "ords")
    return done
