"""Turn scores into labels and alert levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alert_level(label: Column, p_attack: Column, suspect: float = 0.35, confirmed: float = 0.65) -> Column:
    """Soft gate: the attack probability sets the level and never the label."""
    attack = label != "BENIGN"
    return (
        F.when(attack & (p_attack >= confirmed), "CONFIRMED")
        .when(attack & (p_attack >= suspect), "SUSPECT")
        .when(~attack & (p_attack >= confirmed), "SUSPECT")
        .otherwise("NONE")
    )


def with_alert_levels(df: DataFrame, label: str = "label", p_attack: str = "p_attack", suspect: float = 0.35, confirmed: float = 0.65) -> DataFrame:
    return df.withColumn("alert_level", alert_level(F.col(label), F.col(p_attack), suspect, confirmed))


def hard_gate(p_attack: Column, threshold: float, subtype: Column, top_score: Column | None = None) -> Column:
    """Two-stage label: benign below the gate, else the subtype.

    With ``top_score`` a subtype whose best score is negative is left unnamed.
    """
    named = subtype if top_score is None else F.when(top_score < 0, "ATTACK_UNKNOWN").otherwise(subtype)
    return F.when(p_attack >= threshold, named).otherwise("BENIGN")


def score_margin(scores: Column) -> Column:
    """Best score less the second best of an array."""
    ranked = F.sort_array(scores, asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def predict_with_thresholds(scores: Column, thresholds: list[float]) -> Column:
    """Index of the best class among those at or over their threshold, else of the best."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    marked = F.transform(
        scores,
        lambda s, i: F.struct((s >= F.get(limits, i)).alias("ok"), s.alias("score"), (-i).alias("minus_i")),
    )
    # Passing classes first, then score, then the lower index.
    return -F.array_max(marked)["minus_i"]
