"""Small column helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's str.strip()/split() whitespace, spelled for Java and RE2 alike.
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def strip(c: str | Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: str | Column) -> Column:
    s = strip(c)
    return F.when(F.length(s) > 0, s)


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts))


def window_seconds(text: str | Column) -> Column:
    """Length in seconds of a window literal such as ``30m``; NULL when malformed."""
    c = col(text)
    n = F.regexp_extract(c, r"^([0-9]+)([smhd])$", 1)
    unit = F.regexp_extract(c, r"^([0-9]+)([smhd])$", 2)
    size = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    )
    return n.try_cast("bigint") * size


def parse_window(text: str | int) -> int:
    """Driver-side twin of :func:`window_seconds` for job parameters."""
    if isinstance(text, int):
        return text
    number, unit = text.strip()[:-1], text.strip()[-1:]
    sizes = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    if not number.isdigit() or unit not in sizes:
        raise ValueError(f"invalid window: {text!r}")
    return int(number) * sizes[unit]


def stable_hash(seed: int, key: str | Column) -> Column:
    """A 32-bit number that depends on ``(seed, key)`` alone.

    Unlike ``rand(seed)`` it survives task retries and any repartitioning.
    """
    text = F.concat(F.lit(f"{seed}:"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


HASH_SPACE = 1 << 32


def any_of(column: Column, pieces) -> Column:
    """True when ``column`` contains one of ``pieces``."""
    out = F.lit(False)
    for piece in pieces:
        out = out | F.contains(column, F.lit(piece))
    return out


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once.

    A filter on a plain column is pushed below its projection, expression and
    all, and a chain of such projections multiplies. ``inline_outer`` stops that:
    what reads the new columns reads their values. (Plain ``inline`` would add a
    non-empty filter that repeats the expressions once more.)
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    # The projection shares common subexpressions, the generator would not.
    return df.withColumn("_stage", row).select("*", F.inline_outer("_stage")).drop("_stage")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
