"""Normalise raw events into one schema, row by row and without failing the job.

Strict mode marks a bad row with an error; lenient mode repairs what it can.
Rows keep their place: ``error`` is NULL for good ones, and :func:`split_rejects`
separates the two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatweave.functions.columns import staged, strip
from threatweave.functions.fixed import ALIASES, DOMAIN, ENTITY_FIELDS, IPV4, NORMALIZED_KEYS
from threatweave.functions.raw import (
    KEYS,
    all_present,
    first_kind,
    first_text,
    is_flag,
    is_list,
    is_number,
    is_text,
    kind_at,
    text_at,
    truthy,
    with_fields,
)

ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
BASIC_ISO = r"^\d{8}(T\d{6}(Z|[+-]\d{2}:?\d{2})?)?$"
WEB = r"(?i)^https?://"


TYPED = ("timestamp", "severity", "confidence")
ADDRESSES = ("src_ip", "dst_ip", "ip")


def _flag(t: Column) -> Column:
    return F.when(t == "true", 1.0).otherwise(0.0)


def parse_time(t: Column, kind: Column) -> Column:
    """Instant of a trimmed ISO text (UTC unless it says otherwise) or of epoch seconds."""
    seconds = F.when(is_flag(kind), _flag(t)).when(is_number(kind), t.try_cast("double"))
    from_text = F.when(t.rlike(ISO), F.try_to_timestamp(F.replace(t, F.lit(","), F.lit(".")))).when(
        t.rlike(BASIC_ISO), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(
            t, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"T(\d{2})(\d{2})(\d{2})", "T$1:$2:$3")))
    from_number = F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint"))
    return F.when(is_text(kind), from_text).otherwise(from_number)


def parse_int(t: Column, kind: Column) -> Column:
    """Whole number: numbers lose their fraction, texts must be whole already."""
    return (
        F.when(is_text(kind), F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")))
        .when(is_flag(kind), _flag(t).cast("bigint"))
        .when(is_number(kind), t.try_cast("double").try_cast("bigint"))
    )


def parse_float(t: Column, kind: Column) -> Column:
    return F.when(is_flag(kind), _flag(t)).when(is_text(kind) | is_number(kind), t.try_cast("double"))


def filled(t: Column) -> Column:
    return F.when(F.length(t) > 0, t)


def bad_ip(t: Column) -> Column:
    """Neither blank nor an IPv4 address."""
    return F.coalesce((F.length(t) > 0) & ~t.rlike(IPV4), F.lit(False))


def domain_part(t: Column) -> Column:
    """A trimmed text in lower case; of a URL its host."""
    low = F.lower(t)
    return F.when(low.rlike(r"^https?://"), F.regexp_extract(low, r"^https?://([^/:]*)", 1)).otherwise(low)


def good_domain(host: Column) -> Column:
    return F.when(host.rlike(DOMAIN) & (F.length(host) <= 253), host)


def clean_url(t: Column) -> Column:
    return F.when(t.rlike(WEB), t)


def _entities(strict: bool) -> Column:
    """Cleaned entities. In lenient mode one bad address empties all three, and the
    domain is then no longer taken from the URL."""
    bad = F.col("_bad_ip")
    domain = F.coalesce("_own_domain", "_url_domain")
    values = {name: F.when(F.col(f"p_{name}").rlike(IPV4), F.col(f"p_{name}")) for name in ADDRESSES}
    if not strict:
        values = {k: F.when(~bad, v) for k, v in values.items()}
        domain = F.when(bad, F.col("_own_domain")).otherwise(domain)
    values |= {"domain": domain, "url": clean_url(F.col("p_url"))}
    values |= {name: filled(F.col(f"p_{name}")) for name in ("user", "host", "email_from", "email_to")}
    return F.struct(*[values[name].alias(name) for name in ENTITY_FIELDS])


def _tags() -> Column:
    given = text_at("tags")
    listed = F.transform(F.from_json(given, "array<string>"), lambda t: F.coalesce(t, F.lit("None")))
    pieces = F.when(is_list(kind_at("tags")), listed).otherwise(F.split(given, ","))
    return F.coalesce(F.filter(F.transform(pieces, strip), lambda t: F.length(t) > 0), F.array().cast("array<string>"))


def normalize_events(
    df: DataFrame,
    source: str | None = "replay",
    default_severity: int = 3,
    default_confidence: float = 0.6,
    strict: bool = True,
    now: Column | None = None,
    id_columns: tuple[str, ...] = ("ord",),
) -> DataFrame:
    """Normalised events with an ``error`` column.

    ``df``: ``raw`` STRING (JSON object) and ``ord`` BIGINT, with the record maps
    when it comes from :func:`threatweave.operators.adapt.adapt_events`.
    ``source`` names rows that bring none; with None they are errors. ``now``
    stands in for a missing timestamp in lenient mode (default: the query's start).
    The event id is a hash of the record, its source and ``id_columns``: name columns
    there that do not change when the input is split or listed in another way.
    """
    if KEYS not in df.columns:
        df = with_fields(df)
    if "adapt_error" not in df.columns:
        df = df.withColumn("adapt_error", F.lit(None).cast("string"))
    now = F.current_timestamp() if now is None else now

    named = F.when(truthy("source"), F.when(is_text(kind_at("source")), text_at("source")))
    if source is not None:
        named = F.when(truthy("source"), named).otherwise(F.lit(source))
    flagged = F.coalesce((text_at("is_phishing") == "true") & is_flag(kind_at("is_phishing")), F.lit(False))

    # Step by step, each reading values of the one before instead of repeating it.
    picked = staged(
        df,
        {f"p_{name}": strip(first_text(names)) for name, names in ALIASES.items()}
        | {f"k_{name}": first_kind(ALIASES[name]) for name in TYPED}
        | {
            "_done": F.coalesce(all_present(NORMALIZED_KEYS), F.lit(False)) & F.col("adapt_error").isNull(),
            "_source": strip(named), "_flagged": flagged, "_tags": _tags(),
        },
    )
    typed = staged(
        picked,
        {
            "_type": F.coalesce("p_event_type", F.when(F.col("_flagged"), "phishing_detected")),
            "_ts": parse_time(F.col("p_timestamp"), F.col("k_timestamp")),
            "_sev": F.when(F.col("k_severity").isNull(), F.lit(default_severity)).otherwise(parse_int(F.col("p_severity"), F.col("k_severity"))),
            "_conf": F.when(F.col("k_confidence").isNull(), F.lit(float(default_confidence))).otherwise(parse_float(F.col("p_confidence"), F.col("k_confidence"))),
            "_bad_ip": reduce(lambda a, b: a | b, [bad_ip(F.col(f"p_{a}")) for a in ADDRESSES]),
            "_own_host": domain_part(F.col("p_domain")),
            "_url_host": domain_part(F.col("p_url")),
        },
    )
    typed = staged(typed, {"_own_domain": good_domain(F.col("_own_host")), "_url_domain": good_domain(F.col("_url_host"))})
    no_time = F.col("k_timestamp").isNull()
    # The first failing check names the error.
    checks = [
        (F.col("adapt_error").isNotNull(), F.col("adapt_error")),
        (F.col(KEYS).isNull(), F.lit("not a JSON object")),
        (F.col("_source").isNull(), F.lit("missing source")),
        (F.col("_type").isNull(), F.lit("missing event_type")),
        (no_time & F.lit(strict), F.lit("missing timestamp")),
        (~no_time & F.col("_ts").isNull(), F.lit("invalid timestamp")),
        (F.col("_sev").isNull(), F.lit("invalid severity")),
        (F.col("_conf").isNull(), F.lit("invalid confidence")),
        (~F.col("_conf").between(0.0, 1.0) & F.lit(strict), F.lit("confidence out of range")),
        (~F.col("_sev").between(1, 10) & F.lit(strict), F.lit("severity out of range")),
        (F.col("_bad_ip") & F.lit(strict), F.lit("malformed ip")),
        (F.length("_type") == 0, F.lit("blank event_type")),
        (F.length("_source") == 0, F.lit("missing source")),
    ]
    error = F.coalesce(*[F.when(bad, message) for bad, message in checks])

    is_done = F.col("_done")
    given = F.from_json(text_at("entities"), T.StructType([T.StructField(f, T.StringType()) for f in ENTITY_FIELDS]))
    # A row that is normalised already passes as it is, without the checks.
    final = {
        "event_id": F.when(is_done, text_at("event_id")).otherwise(F.sha2(F.concat_ws("|", "raw", "_source", *[F.col(c).cast("string") for c in id_columns]), 256)),
        "ts": F.when(is_done, parse_time(strip(text_at("timestamp")), kind_at("timestamp"))).when(no_time, now).otherwise(F.col("_ts")),
        "event_type": F.when(is_done, text_at("event_type")).otherwise(F.col("_type")),
        "source": F.when(is_done, text_at("source")).otherwise(F.col("_source")),
        "severity": F.when(is_done, parse_int(text_at("severity"), kind_at("severity"))).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), "_sev"))).cast("int"),
        "confidence": F.when(is_done, parse_float(text_at("confidence"), kind_at("confidence"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_conf"))),
        "stage": F.when(is_done, text_at("stage")).otherwise(filled(F.col("p_stage"))),
        "attack_technique": F.when(is_done, text_at("attack_technique")).otherwise(filled(F.col("p_attack_technique"))),
        "tags": F.col("_tags"),
        "entities": F.when(is_done, given).otherwise(_entities(strict)),
        "error": F.when(~is_done, error),
    }
    return staged(typed, final).select("ord", *final, "raw")


def contract_violations(events: DataFrame) -> DataFrame:
    """Add ``violations``: what a normalised row breaks of the event contract."""
    rules = {
        "event_id": F.coalesce(F.length("event_id") < 8, F.lit(True)),
        "timestamp": F.col("ts").isNull(),
        "event_type": F.coalesce(F.length(strip("event_type")) == 0, F.lit(True)),
        "source": F.coalesce(F.length(strip("source")) == 0, F.lit(True)),
        "severity": ~F.coalesce(F.col("severity").between(1, 10), F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
        "entities": F.col("entities").isNull(),
        "raw": F.col("raw").isNull(),
    }
    return events.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()])))


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects); rejects keep position, message and the raw record."""
    good = normalized.filter("error IS NULL").drop("error")
    return good, normalized.filter("error IS NOT NULL").select("ord", "error", "raw")


def run_counters(normalized: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of totals for a run."""
    seen = normalized.agg(
        F.count("*").alias("total_input"),
        F.count_if(F.col("error").isNull()).alias("normalized_ok"),
        F.count_if(F.col("error").isNotNull()).alias("normalized_failed"),
    )
    return seen.crossJoin(alerts.agg(F.count("*").alias("alerts_emitted")))
