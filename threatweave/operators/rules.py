"""Rule tables, step predicates and rule lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatweave.functions.columns import parse_window
from threatweave.functions.fixed import ENTITY_FIELDS
from threatweave.session import local_table

RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("max_span_s", T.LongType()),
    ]
)
STEPS_SCHEMA = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("step_no", T.IntegerType(), False),
        T.StructField("event_type", T.StringType()),
        T.StructField("within_s", T.LongType()),
        T.StructField("same", T.ArrayType(T.StringType())),
        T.StructField("min_confidence", T.DoubleType()),
        T.StructField("min_severity", T.IntegerType()),
        T.StructField("tag_any", T.ArrayType(T.StringType())),
    ]
)


def rule_tables(spark: SparkSession, ruleset: dict) -> tuple[DataFrame, DataFrame]:
    """Turn a rule set into its two tables, filling in defaults.

    Both come from the caller's own rule list, so their size is that list's size
    and they may be broadcast. ``rule_ord`` tells two rules of one id apart:
    :func:`lint_rules` reports them, :func:`eligible_steps` refuses them.
    """
    rules, steps = [], []
    for n, rule in enumerate(ruleset.get("rules", [])):
        span = rule.get("max_span")
        rules.append(
            (
                n,
                rule["id"],
                rule["name"],
                rule.get("description", ""),
                bool(rule.get("enabled", True)),
                rule["severity"],
                float(rule["confidence"]),
                None if span is None else parse_window(span),
            )
        )
        for i, step in enumerate(rule["sequence"]):
            where = step.get("where") or {}
            within = step.get("within")
            sev, conf = where.get("min_severity"), where.get("min_confidence")
            steps.append(
                (
                    n,
                    rule["id"],
                    i,
                    str(step["event_type"]).strip(),
                    None if within is None else parse_window(within),
                    list(step.get("same") or []),
                    None if conf is None else float(conf),
                    None if sev is None else int(sev),
                    list(where.get("tag_any") or []),
                )
            )
    return local_table(spark, rules, RULES_SCHEMA), local_table(spark, steps, STEPS_SCHEMA)


def eligible_steps(rules: DataFrame, steps: DataFrame) -> list[dict]:
    """Steps of enabled rules with at least two steps, with the rule's own bounds.

    The rule set decides the shape of the plan, so it is read on the driver. Two
    rules of one id are an error: their alerts could not be told apart.
    """
    given = rules.collect()
    ids = [r["rule_id"] for r in given]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"rule ids given twice: {repeated}")
    spans = {r["rule_id"]: r["max_span_s"] for r in given if r["enabled"]}
    rows = [r.asDict() for r in steps.collect() if r["rule_id"] in spans]
    sizes: dict[str, int] = {}
    for r in rows:
        sizes[r["rule_id"]] = sizes.get(r["rule_id"], 0) + 1
    return [
        {**r, "max_span_s": spans[r["rule_id"]], "n_steps": sizes[r["rule_id"]]}
        for r in rows
        if sizes[r["rule_id"]] >= 2
    ]


def step_predicate() -> Column:
    """Thresholds and tags of a step against an event; names resolve after the join."""
    return (
        (F.col("min_confidence").isNull() | (F.coalesce(F.col("confidence"), F.lit(0.0)) >= F.col("min_confidence")))
        & (F.col("min_severity").isNull() | (F.coalesce(F.col("severity"), F.lit(0)) >= F.col("min_severity")))
        & (
            (F.size("tag_any") == 0)
            | F.coalesce(F.arrays_overlap(F.col("tags"), F.col("tag_any")), F.lit(False))
        )
    )


def step_candidates(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events joined to every rule step they satisfy on their own."""
    return events.join(F.broadcast(steps), "event_type").filter(step_predicate())


def entity_at(path: Column, entities: str = "entities") -> Column:
    """Value of the entity a path names; NULL when it is missing or blank."""
    out = None
    for field in ENTITY_FIELDS:
        hit = path == f"entities.{field}"
        value = F.col(f"{entities}.{field}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(F.length(F.trim(out)) > 0, out)


def lint_rules(events: DataFrame, rules: DataFrame, steps: DataFrame) -> DataFrame:
    """Rule-set issues, including steps that no event of the table satisfies.

    ``rule_id, step_no`` (-1: the rule), ``level, issue``. Every rule but the first of
    its id is one ``duplicate_id`` error; the other issues are looked for in each rule
    by itself. Windows between steps only matter to rules of two steps or more.
    """
    nth = F.row_number().over(Window.partitionBy("rule_id").orderBy("rule_ord"))
    repeated = rules.select("rule_id", nth.alias("nth")).filter("nth > 1").select(
        "rule_id", F.lit(-1).alias("step_no"), F.lit("error").alias("level"), F.lit("duplicate_id").alias("issue"))

    def warn(df: DataFrame, issue: str, step: Column) -> DataFrame:
        return df.select("rule_id", step.cast("int").alias("step_no"), F.lit("warning").alias("level"), F.lit(issue).alias("issue"))

    no_step = F.lit(-1)
    several = steps.filter("step_no = 1").select("rule_ord")
    first = warn(
        steps.filter("step_no = 0 AND within_s IS NOT NULL").join(F.broadcast(several), "rule_ord", "left_semi"),
        "within_on_first_step", F.col("step_no"))
    totals = steps.filter("step_no > 0").groupBy("rule_ord").agg(F.sum("within_s").alias("total"))
    span = warn(rules.join(F.broadcast(totals), "rule_ord").filter("total > max_span_s"), "within_exceeds_max_span", no_step)
    noisy = warn(rules.filter("confidence < 0.5"), "low_confidence", no_step)
    covered = step_coverage(events, steps)
    dead = warn(covered.filter("n_events = 0"), "step_never_met", F.col("step_no"))
    return repeated.unionByName(first).unionByName(span).unionByName(noisy).unionByName(dead)


def step_coverage(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Number of events that satisfy each rule step, zero included; rules of one id are counted apart."""
    keys = ["rule_ord", "rule_id", "step_no"]
    hits = (
        step_candidates(events.select("event_type", "confidence", "severity", "tags"), steps)
        .groupBy(*keys).agg(F.count("*").alias("n_events"))
    )
    # One row per rule step at most, so this side is as small as the rule set.
    return (
        steps.select(*keys).join(F.broadcast(hits), keys, "left")
        .select("rule_id", "step_no", F.coalesce("n_events", F.lit(0)).alias("n_events"))
    )
