"""Clean flow labels and map them to canonical classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.functions.columns import SPACE, col, strip
from threatweave.functions.fixed import CANONICAL_CLASSES, CANONICAL_LABELS, PERMISSIVE_EXTRA

DASHES = "�–—"


def _dashed(c: Column) -> Column:
    """Odd dashes to hyphens, runs of blanks to one."""
    return strip(F.regexp_replace(F.translate(c, DASHES, "---"), f"[{SPACE}]+", " "))


def _spaced(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*-\s*", " - "))


def clean_label(label: str | Column, variant: str = "validator") -> Column:
    """Label text ready for the canonical map.

    ``validator`` spaces dashes of web attacks only; ``index`` spaces them in
    every label and names the web attack subtypes.
    """
    # A null label reads as the text None, as it does when labels become strings.
    raw = strip(F.coalesce(col(label).cast("string"), F.lit("None")))
    s = _dashed(raw)
    low = F.lower(s)
    web = F.contains(low, F.lit("web")) & F.contains(low, F.lit("attack"))
    if variant == "validator":
        spaced = _spaced(s)
        rest = F.regexp_replace(spaced, r"(?i)^web ?attack", "")
        named = F.when(F.lower(spaced).rlike(r"^web ?attack"), F.concat(F.lit("Web Attack"), rest)).otherwise(spaced)
        return F.when(low == "benign", "BENIGN").when(web, named).otherwise(s)
    if variant == "index":
        subtype = (
            F.when(F.contains(low, F.lit("xss")), "Web Attack - XSS")
            .when(F.contains(low, F.lit("sql")) & F.contains(low, F.lit("injection")), "Web Attack - Sql Injection")
            .when(F.contains(low, F.lit("brute")) & F.contains(low, F.lit("force")), "Web Attack - Brute Force")
            .otherwise("WebAttack")
        )
        return F.when(F.lower(raw) == "benign", "BENIGN").when(web, subtype).otherwise(_spaced(s))
    raise ValueError(f"unknown variant: {variant!r}")


def _mapped(label: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, label)


def canonical_strict(clean: Column) -> Column:
    """Class of a cleaned label; NULL when it is none of the known ones."""
    low = F.lower(clean)
    return F.coalesce(
        _mapped(clean, CANONICAL_LABELS),
        F.when(low == "benign", "BENIGN").when(F.contains(low, F.lit("web attack")), "WebAttack"),
    )


def canonical_permissive(clean: Column) -> Column:
    """Class of a cleaned label, or the label itself when it is unknown."""
    low = F.lower(clean)
    return F.coalesce(
        _mapped(clean, {**CANONICAL_LABELS, **PERMISSIVE_EXTRA}),
        F.when(low.startswith("dos "), "DoS").when(F.contains(low, F.lit("patator")), "BruteForce")
        .when(low == "bot", "Botnet").when(F.contains(low, F.lit("web")) & F.contains(low, F.lit("attack")), "WebAttack"),
        clean,
    )


def canonical_label(label: str | Column, variant: str = "permissive") -> Column:
    if variant == "strict":
        return canonical_strict(clean_label(label, "validator"))
    return canonical_permissive(clean_label(label, "index"))


def keep_canonical(df: DataFrame, label: str = "label", top: int = 20, require: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of a canonical class, most frequent unknown labels). With ``require``, no such row stops the job."""
    mapped = df.withColumn(label, canonical_label(label))
    known = F.col(label).isin(*CANONICAL_CLASSES)
    unknown = mapped.filter(~known).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(top)
    kept = mapped.filter(known)
    if require and kept.isEmpty():
        raise ValueError(f"no row has a canonical class in {label!r}")
    return kept, unknown
