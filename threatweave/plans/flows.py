"""Flow dataset jobs: incident tables, profiles, splits, features and models."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatweave.operators import evaluate as V
from threatweave.operators import models as O
from threatweave.operators.boosting import train_boosted


def incident_table(incidents: DataFrame, *ids: str) -> DataFrame:
    """Incidents with lists and maps as text."""
    pairs = F.transform(
        F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return incidents.select(
        *ids, "key", "start_at", "end_at", "severity",
        F.array_join(F.transform("top_labels", lambda t: F.concat(t["label"], F.lit("="), t["n"].cast("string"))), ",").alias("top_labels"),
        F.array_join(pairs, ",").alias("counts"),
        "confirmed", "suspect", "unique_ports", F.round("confidence", 10).alias("confidence"), "recommendation",
    )


def top_label_rows(incidents: DataFrame) -> DataFrame:
    """How often each label leads an incident, by severity."""
    return (
        incidents.select("severity", F.explode("top_labels").alias("top"))
        .groupBy("severity", F.col("top.label").alias("label"))
        .agg(F.count("*").alias("incidents"), F.sum("top.n").alias("alerts"))
    )


def splits_of(df: DataFrame) -> list[DataFrame]:
    """Train, validation and test rows, dealt over all cores and kept for the many passes of training.

    A table in few files or row groups would leave most cores idle in every pass.
    """
    kept = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    return [kept.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


def model_report(predicted: DataFrame) -> DataFrame:
    metrics = V.class_metrics(predicted)
    return metrics.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def svm_report(df: DataFrame, **params) -> DataFrame:
    train, _, test = splits_of(df)
    return model_report(O.train_ovr(train, "svm", **params).predict(test))


def logreg_report(df: DataFrame, grid, **params) -> DataFrame:
    train, val, test = splits_of(df)
    return model_report(O.search_penalty(train, val, grid, **params)[0].predict(test))


def boosted_report(df: DataFrame, **params) -> DataFrame:
    train, val, test = splits_of(df)
    model = train_boosted(train, **params)
    return model_report(O.predict_thresholded(model, test, O.fit_thresholds(model, val)))


def two_stage_report(df: DataFrame, mode: str, **params) -> DataFrame:
    scored = O.two_stage(*splits_of(df), mode=mode, **params)
    if mode == "v3":
        return scored.groupBy("prediction", "alert_level").agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"))
    return model_report(scored)
