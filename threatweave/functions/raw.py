"""Access to loosely shaped records.

A record is held as two maps over its top-level keys: ``texts``, the values as
text, and ``kinds``, their JSON types. Missing, null and empty values are in
neither; blanks and zero are in both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.functions.columns import staged

TEXTS, KINDS, KEYS = "texts", "kinds", "keys"


def with_fields(df: DataFrame, json: str = "raw") -> DataFrame:
    """Add the record maps, and ``keys`` with every key; all NULL for a text that is no object."""
    parsed = df.withColumn("_fields", F.try_variant_get(F.try_parse_json(F.col(json)), "$", "map<string, variant>"))
    as_text = F.transform_values("_fields", lambda _, v: F.try_variant_get(v, "$", "string"))
    as_kind = F.transform_values("_fields", lambda _, v: F.schema_of_variant(v))
    return parsed.select(
        "*",
        F.map_filter(as_text, lambda _, t: t != "").alias(TEXTS),
        as_kind.alias(KINDS),
        F.map_keys("_fields").alias(KEYS),
    ).drop("_fields")


def text_at(key: str) -> Column:
    """Value under a key as text; NULL when it is missing, null or empty."""
    return F.try_element_at(F.col(TEXTS), F.lit(key))


def kind_at(key: str) -> Column:
    return F.try_element_at(F.col(KINDS), F.lit(key))


def is_text(kind: Column) -> Column:
    return kind == "STRING"


def is_flag(kind: Column) -> Column:
    return kind == "BOOLEAN"


def is_list(kind: Column) -> Column:
    return F.startswith(kind, F.lit("ARRAY"))


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))


def first_text(names) -> Column:
    """Text under the first alias that is present."""
    return F.coalesce(*map(text_at, names))


def first_kind(names) -> Column:
    """JSON type of what :func:`first_text` picks."""
    return F.coalesce(*[F.when(text_at(n).isNotNull(), kind_at(n)) for n in names])


def truthy(key: str) -> Column:
    """Present and neither zero, false nor an empty list or object."""
    # Only a text that looks like one of these needs its type looked at.
    return F.coalesce(~text_at(key).isin("0", "0.0", "false", "[]", "{}") | is_text(kind_at(key)), F.lit(False))


def has_key(key: str) -> Column:
    return F.array_contains(KEYS, key)


def put(df: DataFrame, additions: list[tuple[str, Column, Column]]) -> DataFrame:
    """Set keys a record does not have, as (key, text, kind); a NULL text adds nothing."""
    # Joined lists of one or no entry: unlike a filter over all, generated code works them out.
    none = F.array().cast("array<struct<key: string, text: string, kind: string>>")
    entries = F.flatten(
        F.array(
            *[
                F.when(value.isNotNull() & ~has_key(key), F.array(F.struct(F.lit(key).alias("key"), value.alias("text"), kind.alias("kind"))))
                .otherwise(none)
                for key, value, kind in additions
            ]
        )
    )
    return staged(df, {"_new": entries}).withColumns(
        {
            TEXTS: F.map_concat(TEXTS, F.map_from_arrays("_new.key", "_new.text")),
            KINDS: F.map_concat(KINDS, F.map_from_arrays("_new.key", "_new.kind")),
            KEYS: F.concat(KEYS, "_new.key"),
        }
    ).drop("_new")


def all_present(keys) -> Column:
    return reduce(lambda a, b: a & b, map(has_key, keys))
