"""Bring payloads of the known producers into the raw event form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.functions.raw import has_key, is_flag, kind_at, put, text_at, truthy

TIME_NAMES = ("time", "ts", "event_time")


def _first(rows: Column, names, default: str | None = None) -> tuple[Column, Column]:
    """Text and kind under the first truthy name, for the given rows."""
    texts = F.coalesce(*[F.when(truthy(n), text_at(n)) for n in names], *([F.lit(default)] if default else []))
    kinds = F.coalesce(*[F.when(truthy(n), kind_at(n)) for n in names], F.lit("STRING"))
    return F.when(rows, texts), kinds


def _copy(rows: Column, name: str) -> tuple[Column, Column]:
    return F.when(rows, text_at(name)), kind_at(name)


def adapt_events(df: DataFrame, kind_col: str = "kind", raw_source: str = "raw") -> DataFrame:
    """Apply the adapter each row's kind names; other kinds get ``adapt_error``.

    ``df`` holds the record maps of :func:`threatweave.functions.raw.with_fields`.
    Keys a record already has are never overwritten.
    """
    string = F.lit("STRING")
    kind = F.coalesce(F.col(kind_col), F.lit("raw"))
    network, phishing, intel = kind == "network", kind == "phishing", kind == "url_intel"
    adapted = network | phishing | intel
    source = (
        F.when(network, "network_analysis").when(phishing, "phishing_detector").when(intel, "url_intel")
        .when(kind == "raw", raw_source)
    )
    flagged = F.coalesce((text_at("is_phishing") == "true") & is_flag(kind_at("is_phishing")), F.lit(False))
    indicator = text_at("indicator")
    routed = intel & truthy("indicator") & ~has_key("domain") & ~has_key("url") & ~has_key("ip")
    is_url = indicator.startswith("http://") | indicator.startswith("https://")
    is_domain = F.contains(indicator, F.lit(".")) & ~F.replace(indicator, F.lit("."), F.lit("")).rlike(r"^\p{Nd}+$")
    additions = [
        ("source", source, string),
        ("event_type", *_first(network, ("alert_type", "type", "name"), "network_anomaly")),
        ("event_type", F.when(phishing & flagged, "phishing_detected"), string),
        ("event_type", *_first(phishing & ~flagged, ("type",), "phishing_alert")),
        ("event_type", *_first(intel, ("type", "name"), "intel_indicator")),
        ("timestamp", *_first(adapted, TIME_NAMES)),
        ("confidence", *_copy(network, "score")),
        ("confidence", *_copy(intel, "risk_score")),
        ("from", *_copy(phishing, "sender")),
        ("to", *_copy(phishing, "recipient")),
        ("url", *_copy(phishing, "link")),
        ("url", F.when(routed & is_url, indicator), string),
        ("domain", F.when(routed & ~is_url & is_domain, indicator), string),
        ("ip", F.when(routed & ~is_url & ~is_domain, indicator), string),
    ]
    known = adapted | (kind == "raw")
    return put(df, additions).withColumn("adapt_error", F.when(~known, F.concat(F.lit("unknown kind: "), kind)))
