"""Confusion counts and F1 figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatweave.session import local_table


def confusion(df: DataFrame, y: str = "label", yhat: str = "prediction", labels=None) -> DataFrame:
    """Every pair of labels with its count, zeros included."""
    counts = df.groupBy(F.col(y).alias("truth"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))
    if labels is None:
        # One row per label: as small as the label set.
        names = counts.select(F.col("truth").alias("label")).union(counts.select("predicted")).distinct()
    else:
        names = local_table(df.sparkSession, [(x,) for x in labels], "label string")
    cells = names.select(F.col("label").alias("truth")).crossJoin(names.select(F.col("label").alias("predicted")))
    return cells.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def normalized_confusion(cm: DataFrame) -> DataFrame:
    row = F.sum("n").over(Window.partitionBy("truth"))
    return cm.select("truth", "predicted", "n", (F.col("n") / F.greatest(row, F.lit(1))).alias("share"))


def class_metrics(df: DataFrame, y: str = "label", yhat: str = "prediction", labels=None) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where undefined."""
    counts = df.groupBy(F.col(y).alias("truth"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
    )
    per = counts.select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "called")])
    if labels is not None:
        names = local_table(df.sparkSession, [(x,) for x in labels], "label string")
        per = F.broadcast(names).join(per, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return per.select(
        "label",
        ratio(F.col("tp"), F.col("called")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
        "support",
    )


def f1_summary(metrics: DataFrame) -> DataFrame:
    """Macro and weighted F1 over the labels of :func:`class_metrics`."""
    return metrics.agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.greatest(F.sum("support"), F.lit(1))).alias("weighted_f1"),
        F.sum("support").alias("rows"),
    )


def eval_report(df: DataFrame, y: str = "label", yhat: str = "prediction", labels=None) -> dict[str, DataFrame]:
    metrics = class_metrics(df, y, yhat, labels)
    cm = confusion(df, y, yhat, labels)
    # Macro F1 of the report is over labels that occur.
    summary = f1_summary(class_metrics(df, y, yhat))
    return {"confusion": cm, "normalized": normalized_confusion(cm), "classes": metrics, "summary": summary}


def binary_report(df: DataFrame, y: str, yhat: str, negative: str = "BENIGN") -> DataFrame:
    """Class figures after folding every other label into ATTACK."""
    fold = lambda c: F.when(F.col(c) == negative, negative).otherwise("ATTACK")
    return class_metrics(df.select(fold(y).alias("label"), fold(yhat).alias("prediction")), labels=("ATTACK", negative))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes x rows of the class)."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return per.crossJoin(F.broadcast(whole)).select("label", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def search_thresholds(scored: DataFrame, grid: list[float], macro: bool = False) -> DataFrame:
    """Best F1 threshold per class; the lowest one wins a tie.

    ``scored``: class, score, hit (BOOLEAN). A row only matters by the highest
    grid step it reaches, so rows shrink to one count per class and step.
    """
    steps = F.array(*[F.lit(float(g)) for g in grid])
    reached = F.size(F.filter(steps, lambda g: F.col("score") >= g))
    counts = scored.groupBy("class", reached.alias("step")).agg(
        F.count("*").alias("n"), F.count_if(F.col("hit")).alias("hits")
    )
    cells = (
        counts.select("class").distinct()
        .crossJoin(F.broadcast(local_table(scored.sparkSession, list(enumerate([None, *grid])), "step int, threshold double")))
        .join(counts, ["class", "step"], "left").na.fill(0, ["n", "hits"])
    )
    above = Window.partitionBy("class").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("class")
    swept = cells.select(
        "class", "step", "threshold",
        F.sum("n").over(above).alias("called"), F.sum("hits").over(above).alias("tp"),
        F.sum("hits").over(whole).alias("pos"), F.sum("n").over(whole).alias("total"),
    ).filter("step > 0")
    f1 = lambda tp, called, pos: F.when(called + pos > 0, 2 * tp / (called + pos)).otherwise(0.0)
    score = f1(F.col("tp"), F.col("called"), F.col("pos"))
    if macro:
        tn = F.col("total") - F.col("called") - F.col("pos") + F.col("tp")
        score = (score + f1(tn, F.col("total") - F.col("called"), F.col("total") - F.col("pos"))) / 2
    best = Window.partitionBy("class").orderBy(F.col("f1").desc(), "step")
    return (
        swept.withColumn("f1", score).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
        .select("class", "threshold", "f1")
    )


def grid_of(start: float, stop: float, n: int) -> list[float]:
    return [round(start + (stop - start) * i / (n - 1), 10) for i in range(n)]


CLASS_GRID = grid_of(0.05, 0.95, 19)
GATE_GRID = grid_of(0.10, 0.95, 18)
