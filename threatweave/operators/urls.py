"""Score a table of URLs with native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.functions.columns import SPACE, any_of, stable_hash, staged
from threatweave.functions.fixed import (
    GENERIC_SUFFIXES,
    HIGH_RISK_TLDS,
    LEGITIMATE_TLDS,
    PHISHING_KEYWORDS,
    RISK_ADVICE,
    RISK_LEVELS,
    SECOND_LEVEL_SUFFIXES,
    SHORTENERS,
    URL_FEATURES,
    URL_PATTERNS,
)

# RFC 3986 appendix B, with the scheme held to its own characters.
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://|//)?([^/?#]*)"
SUFFIXES = tuple(dict.fromkeys((*GENERIC_SUFFIXES, *HIGH_RISK_TLDS, *LEGITIMATE_TLDS, *SECOND_LEVEL_SUFFIXES)))
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def _count(c: Column, keep: str) -> Column:
    """Number of characters of a class."""
    return F.length(c) - F.length(F.regexp_replace(c, keep, ""))


def keyword_count(low: Column, keywords=PHISHING_KEYWORDS) -> Column:
    """Keywords found anywhere in the text; one listed twice counts twice."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(low, F.lit(k)).cast("int")
    return total


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""
    chars = F.split(c, "")
    n = F.length(c)
    shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def rule_depth(rules) -> int:
    """Labels of the longest rule: no longer part of a host has to be looked at."""
    if isinstance(rules, DataFrame):
        return rules.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 1
    return max((r.count(".") + 1 for r in rules), default=1)


def suffix_rules(labels: Column, depth: int) -> Column:
    """Every rule that may speak of a host: for each number of last labels the plain
    rule, the wildcard in place of the first of them, and the exception.

    Each comes with the labels that it leaves to the suffix: an exception one less.
    """
    n = F.size(labels)

    def of(k):
        plain = F.array_join(F.slice(labels, n - k + 1, k), ".")
        below = F.array_join(F.slice(labels, n - k + 2, k - 1), ".")
        return F.array(*[
            F.struct(rule.alias("rule"), F.lit(exception).alias("exception"), width.alias("width"))
            for rule, exception, width in (
                (plain, False, k), (F.concat(F.lit("*."), below), False, k), (F.concat(F.lit("!"), plain), True, k - 1))
        ])

    return F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(depth))), of))


def listed_width(labels: Column, rules) -> Column:
    """Labels of the suffix by a list of rules; NULL where no rule fits.

    An exception wins, then the rule of most labels.
    """
    fits = F.filter(suffix_rules(labels, rule_depth(rules)), lambda c: c["rule"].isin(*rules))
    return F.array_max(F.transform(fits, lambda c: F.struct(c["exception"], c["width"].alias("width"))))["width"]


def host_widths(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, width) of each host that a rule of a table fits; ``hosts`` are lower-case and distinct."""
    said = hosts.select("host", F.inline(suffix_rules(F.split("host", r"\."), rule_depth(rules))))
    fits = said.join(rules.select(F.lower("rule").alias("rule")).distinct(), "rule")
    return fits.groupBy("host").agg(F.max(F.struct("exception", "width"))["width"].alias("width"))


def url_parts(df: DataFrame, url: str = "url", suffixes=SUFFIXES) -> DataFrame:
    """Add host, path, query, suffix, domain and subdomain of each URL.

    ``suffixes`` are rules of any number of labels: ``co.uk``, wildcards ``*.ck`` and
    exceptions ``!www.ck``. Of the rules that fit a host an exception wins, then the
    longest. A table with a column ``rule`` serves for long lists; it meets each
    distinct host once. Without a rule a two-letter last label is a country suffix; an
    address has none.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, PARTS, 1))
    path = F.regexp_extract(u, PARTS, 3)
    # Parameters of the last path segment are not part of the path.
    path = F.when(scheme.isin("", "http", "https", "ftp"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    host = F.regexp_replace(F.regexp_extract(u, AUTHORITY, 1), r"^.*@|:\d*$", "")
    df = staged(df, {"path": path, "query": F.regexp_extract(u, PARTS, 4), "host": F.rtrim(host, F.lit("."))})
    low = F.split(F.lower("host"), r"\.")
    if isinstance(suffixes, DataFrame):
        widths = host_widths(df.select(F.lower("host").alias("host")).distinct(), suffixes)
        df = df.withColumn("_host", F.lower("host")).join(
            widths.select(F.col("host").alias("_host"), F.col("width").alias("_listed")), "_host", "left").drop("_host")
        listed = F.col("_listed")
    else:
        listed = listed_width(low, suffixes)
    address = F.col("host").rlike(rf"^{IPV4}$|^\[")
    country = F.get(low, F.size(low) - 1).rlike("^[a-z]{2}$")
    width = F.when(address, 0).otherwise(F.coalesce(listed, country.cast("int"), F.lit(0)))
    df = staged(df, {"_address": address, "_width": width, "_labels": F.split("host", r"\.")})
    n, w = F.size("_labels"), F.col("_width")
    own = F.coalesce(F.get("_labels", n - w - 1), F.lit(""))
    sub = F.when(n - w - 1 > 0, F.array_join(F.slice("_labels", F.lit(1), n - w - 1), ".")).otherwise("")
    return staged(
        df,
        {
            "suffix": F.when(w > 0, F.array_join(F.slice("_labels", n - w + 1, w), ".")).otherwise(""),
            "domain": F.when(F.col("_address"), F.col("host")).otherwise(own),
            "subdomain": F.when(F.col("_address"), "").otherwise(sub),
        },
    ).drop("_address", "_width", "_labels", "_listed")


def url_features(df: DataFrame, url: str = "url", suffixes=SUFFIXES) -> DataFrame:
    """Add the feature columns and ``tld``."""
    parts = url_parts(df, url, suffixes)
    u = F.coalesce(F.col(url), F.lit(""))
    tld = F.lower("suffix")
    registered = F.when(F.length("suffix") > 0, F.concat_ws(".", "domain", "suffix")).otherwise(F.col("domain"))
    first = staged(
        parts,
        {
            "_url": u, "_low": F.lower(u), "tld": tld, "registered_domain": registered,
            "num_digits": _count(u, r"[\p{Nd}²³¹]"),
            "num_letters": _count(u, r"\p{L}"),
            "num_special_chars": F.length(F.regexp_replace(u, r"[\p{L}\p{N}]", "")),
            "phishing_keyword_count": keyword_count(F.lower(u)),
        },
    )
    u, n = F.col("_url"), F.length("_url")
    pairs = F.filter(F.split("query", "&"), lambda p: p.rlike("^[^=]*=."))
    keys = F.transform(pairs, lambda p: F.regexp_replace(F.substring_index(p, "=", 1), r"\+", " "))
    keys = F.transform(keys, lambda k: F.coalesce(F.try_url_decode(k), k))
    tokens = F.size(F.filter(F.split("_low", f"[{SPACE}]+"), lambda t: t != ""))

    def ratio(part: str) -> Column:
        return F.when(n > 0, F.col(part) / n).otherwise(0.0)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    https = flag(u.startswith("https://"))
    values = {
        "url_length": n,
        "domain_length": F.length("registered_domain"),
        "path_length": F.length("path"),
        "num_subdomains": F.when(F.length("subdomain") > 0, F.size(F.split("subdomain", r"\."))).otherwise(0),
        "digit_ratio": ratio("num_digits"),
        "letter_ratio": ratio("num_letters"),
        "special_char_ratio": ratio("num_special_chars"),
        "phishing_keyword_ratio": F.when(tokens > 0, F.col("phishing_keyword_count") / tokens).otherwise(0.0),
        "is_https": https,
        "is_http": flag(u.startswith("http://")),
        "has_path": flag((F.length("path") > 0) & (F.col("path") != "/")),
        "has_query": flag(F.length("query") > 0),
        "num_params": F.size(F.array_distinct(keys)),
        "has_subdomain": flag(F.length("subdomain") > 0),
        "is_high_risk_tld": flag(F.col("tld").isin(*HIGH_RISK_TLDS)),
        "is_legitimate_tld": flag(F.col("tld").isin(*LEGITIMATE_TLDS)),
        # A hash that every process agrees on.
        "tld_encoded": F.when(F.length("tld") > 0, stable_hash(0, "tld") % 1000).otherwise(0).cast("int"),
        "uses_ip_address": flag(u.rlike(IPV4) | u.rlike(r"\[([0-9a-fA-F:]+)\]")),
        "has_suspicious_symbols": flag(u.rlike(r"[@%&*]")),
        "has_double_slash": flag(F.contains("path", F.lit("//"))),
        "has_ssl": https,
        "url_depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "is_shortened": flag(any_of(u, SHORTENERS)),
        "entropy": entropy(F.col("registered_domain")),
    }
    return first.withColumns(values).drop("_url", "_low")


def feature_vector(df: DataFrame) -> DataFrame:
    """The frozen feature list in order; a feature that is missing is 0."""
    have = set(df.columns)
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(0)) if f in have else F.lit(0) for f in URL_FEATURES})


def quick_features(df: DataFrame, url: str = "url") -> DataFrame:
    """The few features scoring needs, without suffix lookup: what follows the last
    dot of the URL counts as its suffix."""
    u = F.coalesce(F.col(url), F.lit(""))
    tld = F.lower(F.substring_index(F.substring_index(u, ".", -1), "/", 1))
    netloc = F.regexp_extract(u, PARTS, 2)
    dots = F.size(F.split(netloc, r"\."))
    return df.withColumns(
        {
            "is_high_risk_tld": tld.isin(*HIGH_RISK_TLDS).cast("int"),
            "phishing_keyword_count": keyword_count(F.lower(u)),
            "uses_ip_address": u.rlike(IPV4).cast("int"),
            "url_length": F.length(u),
            "num_subdomains": F.when(F.length(netloc) > 0, F.greatest(F.lit(0), dots - 2)).otherwise(0),
            "special_char_ratio": F.when(F.length(u) > 0, F.length(F.regexp_replace(u, r"[\p{L}\p{N}]", "")) / F.length(u)).otherwise(0.0),
        }
    )


def risk_score(p: Column) -> Column:
    """0 to 100 from the model's probability and the features beside it."""
    structure = (
        F.when(F.col("uses_ip_address") == 1, 10).when(F.col("url_length") > 150, 5).when(F.col("num_subdomains") > 3, 3).otherwise(0)
    )
    total = (
        F.floor(p * 60)
        + F.when(F.col("is_high_risk_tld") == 1, 10).otherwise(0)
        + F.least(F.col("phishing_keyword_count") * 3, F.lit(15))
        + structure
        + F.when(F.col("special_char_ratio") > 0.3, 5).otherwise(0)
    )
    return F.least(total, F.lit(100)).cast("int")


def risk_level(score: Column) -> Column:
    level = F.lit("MINIMAL")
    for least, name in reversed(RISK_LEVELS):
        level = F.when(score >= least, name).otherwise(level)
    return level


def recommendation(level: Column) -> Column:
    advice = F.create_map(*[F.lit(x) for kv in RISK_ADVICE.items() for x in kv])
    return F.coalesce(F.try_element_at(advice, level), F.lit("Risk assessment unavailable"))


def detection_reasons(p: Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(F.col("is_high_risk_tld") == 1, F.concat(F.lit("High-risk TLD detected: "), "tld")),
            F.when(F.col("phishing_keyword_count") > 0, F.concat(F.lit("Contains "), F.col("phishing_keyword_count").cast("string"), F.lit(" phishing keywords"))),
            F.when(F.col("url_length") > 150, F.lit("Suspiciously long URL")),
            F.when(F.col("special_char_ratio") > 0.3, F.lit("High special character ratio")),
            F.when(F.col("uses_ip_address") == 1, F.lit("Uses IP address instead of domain")),
            F.when(p > 0.9, F.lit("Very high phishing probability (>90%)")),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No specific indicators detected")))


def url_risk(df: DataFrame, p: str = "p", threshold: float = 0.35) -> DataFrame:
    """Verdict columns for URLs with features and a probability ``p``."""
    prob = F.col(p)
    scored = df.withColumn("risk_score", risk_score(prob))
    return scored.withColumns(
        {
            "is_phishing": prob >= threshold,
            "prediction": F.when(prob >= threshold, "PHISHING").otherwise("LEGITIMATE"),
            "phishing_probability": F.round(prob, 4),
            "confidence": F.when(prob > 0.8, "HIGH").when(prob > 0.5, "MEDIUM").otherwise("LOW"),
            "detection_reasons": detection_reasons(prob),
            "risk_level": risk_level(F.col("risk_score")),
            "recommendation": recommendation(risk_level(F.col("risk_score"))),
        }
    )


def url_batch_stats(scored: DataFrame) -> DataFrame:
    """One row of totals; a row without verdict counts as safe, and an empty table has no rate."""
    n, bad = F.count("*"), F.count_if(F.col("is_phishing"))
    return scored.agg(
        n.alias("total_urls"), bad.alias("phishing_count"), (n - bad).alias("safe_count"),
        F.when(n > 0, F.round(bad / n * 100, 2)).alias("phishing_rate"),
    )


def url_host_rollup(scored: DataFrame) -> DataFrame:
    """Risk per registered domain."""
    return scored.groupBy("registered_domain").agg(
        F.count("*").alias("urls"), F.count_if(F.col("is_phishing")).alias("phishing"),
        F.max("risk_score").alias("max_risk"), F.sum("phishing_keyword_count").alias("keywords"),
    )


def url_pattern_flags(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``url_patterns``, the named suspicious patterns each URL shows."""
    return df.withColumn("url_patterns", F.array_compact(F.array(*[F.when(F.col(url).rlike(p), F.lit(n)) for n, p in URL_PATTERNS.items()])))
