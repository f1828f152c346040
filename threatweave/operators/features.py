"""Numeric features fitted on training rows and applied to every split."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatweave.functions.fixed import LEAKAGE_COLUMNS

# Rows of one column that may be ordered in one task while its median is settled.
SMALL = 1_000_000


def feature_list(df: DataFrame, label: str, leakage=LEAKAGE_COLUMNS) -> list[str]:
    """Numeric columns less the label and those that give it away, sorted."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label and f.name not in leakage)


def finite(name: str) -> Column:
    """The column as a number; NULL for what is none, NaN and infinities."""
    c = F.col(f"`{name}`").try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def exact_medians(df: DataFrame, names: list[str], accuracy: int = 10_000) -> dict[str, float]:
    """Exact median of each column, without sorting or collecting one.

    An approximate quantile brackets the middle; a count of what lies below and
    one row per distinct value inside the bracket give the exact middle. A
    bracket that is still large is bracketed again.
    """
    values = df.select(*[finite(n).alias(f"v{i}") for i, n in enumerate(names)])
    counts = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    total = {i: counts[f"n{i}"] for i in range(len(names)) if counts[f"n{i}"]}
    lo, hi = {i: float("-inf") for i in total}, {i: float("inf") for i in total}
    open_ = set(total)
    rank_in = {i: (total[i] - 1) / 2 for i in total}  # middle rank inside the bracket
    size_in = dict(total)
    while any(size_in[i] > SMALL for i in open_):
        wide = sorted(i for i in open_ if size_in[i] > SMALL)
        margin = 2.0 / accuracy

        def inside(i):
            v = F.col(f"v{i}")
            return F.when(v.between(lo[i], hi[i]), v)

        marks = values.agg(
            *[
                F.percentile_approx(inside(i), [max(0.0, rank_in[i] / size_in[i] - margin), min(1.0, rank_in[i] / size_in[i] + margin)], accuracy).alias(f"q{i}")
                for i in wide
            ]
        ).first()
        before = dict(size_in)
        for i in wide:
            lo[i], hi[i] = marks[f"q{i}"]
        sizes = values.agg(
            *[F.count_if(F.col(f"v{i}") < lo[i]).alias(f"b{i}") for i in wide],
            *[F.count(inside(i)).alias(f"s{i}") for i in wide],
        ).first()
        for i in wide:
            rank_in[i], size_in[i] = (total[i] - 1) / 2 - sizes[f"b{i}"], sizes[f"s{i}"]
            if size_in[i] >= before[i]:
                open_.discard(i)  # repeats of few values: distinct ones are few as well
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(f"v{i}").between(lo[i], hi[i]), F.col(f"v{i}")).alias("v")) for i in total])
    distinct = values.select(F.inline(entries)).filter("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.lit(0.0)
    for i, r in rank_in.items():
        middle = F.when(F.col("i") == i, F.lit(float(r))).otherwise(middle)
    at = distinct.withColumns({"_to": upto, "_mid": middle}).filter(
        ((F.col("_to") - F.col("n") <= F.floor("_mid")) & (F.floor("_mid") < F.col("_to")))
        | ((F.col("_to") - F.col("n") <= F.ceil("_mid")) & (F.ceil("_mid") < F.col("_to")))
    )
    return {names[r["i"]]: r["m"] for r in at.groupBy("i").agg(((F.min("v") + F.max("v")) / 2).alias("m")).collect()}


def fit_features(train: DataFrame, label: str, leakage=LEAKAGE_COLUMNS) -> list[dict]:
    """Median, mean and population deviation per feature: one entry per column.

    Mean and deviation are those of the imputed column; a deviation of zero
    scales by one. A column without any value is imputed with zero.
    """
    names = feature_list(train, label, leakage)
    medians = exact_medians(train, names)
    filled = [F.coalesce(finite(n), F.lit(medians.get(n, 0.0))) for n in names]
    row = train.agg(
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)]
    ).first()
    return [
        {"feature": n, "median": medians.get(n, 0.0), "mean": row[f"a{i}"], "std": row[f"s{i}"] or 1.0}
        for i, n in enumerate(names)
    ]


def standardized(stat: dict) -> Column:
    filled = F.coalesce(finite(stat["feature"]), F.lit(stat["median"]))
    return ((filled - stat["mean"]) / stat["std"]).cast("float")


def apply_features(df: DataFrame, stats: list[dict], keep=()) -> DataFrame:
    """``features`` ARRAY<FLOAT> in the fitted order, next to the kept columns."""
    return df.select(*keep, F.array(*[standardized(s) for s in stats]).alias("features"))


def feature_table(df: DataFrame, label: str, split: str = "split", keep=()) -> tuple[DataFrame, list[dict]]:
    """Fit on the training split, apply to all; returns (table, stats)."""
    stats = fit_features(df.filter(F.col(split) == "train").drop(split), label)
    return apply_features(df, stats, [split, label, *keep]), stats


def manifest(table: DataFrame, label: str, stats: list[dict], split: str = "split") -> DataFrame:
    """Rows per split and label with the number of features."""
    return table.groupBy(split, F.col(label).cast("string").alias("label")).agg(F.count("*").alias("rows")).withColumn("features", F.lit(len(stats)))


class FeatureContract(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted features as a pipeline stage: adds ``features`` to any table with the columns.

    Order of the features, medians, means and deviations are its parameters, so saving
    and loading keep them to the last bit. A column that a table lacks is an error.
    """

    names = Param(Params._dummy(), "names", "feature columns in order", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "values for missing cells", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means of the imputed columns", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviations, 1 for constant columns", TypeConverters.toListFloat)
    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)

    def __init__(self, stats: list[dict] | None = None, label: str | None = None):
        super().__init__()
        if stats is not None:
            self._set(
                names=[s["feature"] for s in stats], medians=[s["median"] for s in stats],
                means=[s["mean"] for s in stats], deviations=[s["std"] for s in stats], label=label)

    @property
    def stats(self) -> list[dict]:
        lists = (self.getOrDefault(p) for p in (self.names, self.medians, self.means, self.deviations))
        return [{"feature": f, "median": m, "mean": a, "std": s} for f, m, a, s in zip(*lists)]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", F.array(*[standardized(s) for s in self.stats]).cast("array<float>"))


def write_features(df: DataFrame, label: str, folder: str, split: str = "split", keep=(), leakage=LEAKAGE_COLUMNS) -> DataFrame:
    """Fit on the training rows and write what training needs below ``folder``.

    ``contract`` is the saved stage, ``features`` the table by split, ``manifest`` rows
    per split and label, number of features and columns left out as leaking. Returns
    the manifest as written. A label or kept column called ``features`` is an error.
    """
    if "features" in (label, *keep):
        raise ValueError("a column 'features' would be overwritten")
    spark = df.sparkSession
    contract = FeatureContract(fit_features(df.filter(F.col(split) == "train").drop(split, *keep), label, leakage), label)
    contract.write().overwrite().save(f"{folder}/contract")
    table = contract.transform(df).select(*keep, F.col(label), "features", split)
    table.write.mode("overwrite").partitionBy(split).parquet(f"{folder}/features")
    rows = manifest(read_features(spark, folder, table.schema), label, contract.stats, split)
    left_out = sorted(c for c in df.columns if c in leakage and c != label)
    rows = rows.withColumn("dropped", F.array(*map(F.lit, left_out)).cast("array<string>"))
    rows.write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(rows.schema).json(f"{folder}/manifest")


def read_features(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """The feature table of a folder."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/features")
