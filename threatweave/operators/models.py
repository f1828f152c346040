"""Distributed training: one model per class, gates and two-stage labels.

Models see ``features`` (ARRAY<FLOAT> from :mod:`threatweave.operators.features`)
and ``label``. Training reads its rows once per class and iteration, so pass
persisted or written tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatweave.functions.fixed import URL_FEATURES
from threatweave.operators.boosting import BoostedTrees
from threatweave.operators.evaluate import GATE_GRID, CLASS_GRID, class_metrics, f1_summary, search_thresholds
from threatweave.operators.gates import alert_level, hard_gate, predict_with_thresholds, score_margin
from threatweave.operators.text import tokens, scrub_text
from threatweave.session import local_table

C_GRID = (0.05, 0.1, 0.5, 1.0, 2.0)
# Classes trained at the same time: their many short jobs fill each other's gaps.
PARALLEL = 9


def _vectors(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("_x", array_to_vector(features))


def _binary(df: DataFrame, hit: Column, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """0/1 target with the weight of each side."""
    marked = df.withColumn("_y", hit.cast("double"))
    return marked.withColumn("_w", F.when(F.col("_y") == 1, F.lit(up)).otherwise(F.lit(down)))


def _balanced(n: int, pos: int) -> tuple[float, float]:
    """Weights with which each side weighs half."""
    return n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1))


def side_weights(kind: str, n: int, pos: int, classes: int) -> tuple[float, float]:
    """Weights of a class and of the rest. The linear SVM weighs the class by
    n / (classes * its rows) and leaves the rest; trees are not weighted."""
    if kind == "svm":
        return n / (classes * max(pos, 1)), 1.0
    return (1.0, 1.0) if kind == "gbt" else _balanced(n, pos)


def learner(kind: str, n: int, c: float = 1.0, **params):
    """An untrained binary learner. ``c`` is the inverse penalty over ``n`` rows."""
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w"}
    if kind == "svm":
        return LinearSVC(**common, standardization=True, **{"regParam": 1e-5, "maxIter": 100, **params})
    if kind == "logreg":
        return LogisticRegression(**common, **{"regParam": 1.0 / (c * max(n, 1)), "maxIter": 100, **params})
    if kind == "gbt":
        return GBTClassifier(**common, **{"maxIter": 220, "maxDepth": 8, "stepSize": 0.08, "minInstancesPerNode": 30, "seed": 42, **params})
    raise ValueError(f"unknown kind: {kind!r}")


@dataclass
class PerClass:
    """One binary model per class; scores come in the order of ``labels``."""

    kind: str
    labels: list[str]
    models: list

    def score(self, df: DataFrame, out: str = "scores") -> DataFrame:
        kept = df.columns
        scored = _vectors(df)
        column = "rawPrediction" if self.kind == "svm" else "probability"
        names = []
        for i, model in enumerate(self.models):
            model = model.copy()
            model.setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
            if self.kind != "svm":
                model.setProbabilityCol(f"_q{i}")
            scored = model.transform(scored)
            names.append(f"_r{i}" if column == "rawPrediction" else f"_q{i}")
        arrays = [F.get(vector_to_array(n), F.lit(1)) for n in names]
        return scored.select(*kept, F.array(*arrays).alias(out))

    def name(self, index: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), index)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Label with the best score; ``scores`` stay for margins."""
        best = F.array_position("scores", F.array_max("scores")) - 1
        return self.score(df).withColumn(out, self.name(best))


def train_ovr(df: DataFrame, kind: str, label: str = "label", labels: list[str] | None = None, c: float = 1.0, **params) -> PerClass:
    """One model per class against the rest, weighted by :func:`side_weights`, several classes at a time."""
    # As many rows as there are classes.
    counts = {r["label"]: r["n"] for r in df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    labels = sorted(k for k in counts if k is not None) if labels is None else labels
    n = sum(counts.values())
    rows = _vectors(df)

    @inheritable_thread_target(df.sparkSession)
    def fit(name):
        return learner(kind, n, c, **params).fit(
            _binary(rows, F.col(label).eqNullSafe(name), *side_weights(kind, n, counts.get(name, 0), len(labels))))

    with ThreadPool(max(1, min(PARALLEL, len(labels)))) as pool:
        return PerClass(kind, labels, pool.map(fit, labels, chunksize=1))


def macro_f1(predicted: DataFrame, label: str = "label") -> float:
    return f1_summary(class_metrics(predicted, label, "prediction")).first()["macro_f1"]


def search_penalty(train: DataFrame, val: DataFrame, grid=C_GRID, label: str = "label", **params) -> tuple[PerClass, float, float]:
    """Logistic regression with the penalty that does best on validation, refit on both."""
    best_c, best = None, -1.0
    for c in grid:
        found = macro_f1(train_ovr(train, "logreg", label, c=c, **params).predict(val), label)
        if found > best:
            best_c, best = c, found
    return train_ovr(train.unionByName(val), "logreg", label, c=best_c, **params), best_c, best


def fit_thresholds(model: PerClass | BoostedTrees, val: DataFrame, label: str = "label", grid=CLASS_GRID) -> list[float]:
    """Best threshold of each class on validation rows, in the order of the model's labels."""
    marks = F.array(
        *[F.struct(F.lit(n).alias("class"), F.get("scores", F.lit(i)).alias("score"), (F.col(label) == n).alias("hit")) for i, n in enumerate(model.labels)]
    )
    found = search_thresholds(model.score(val).select(F.inline(marks)), list(grid)).collect()
    best = {r["class"]: r["threshold"] for r in found}
    return [best.get(n, 0.5) for n in model.labels]


def predict_thresholded(model: PerClass | BoostedTrees, df: DataFrame, thresholds: list[float]) -> DataFrame:
    return model.score(df).withColumn("prediction", model.name(predict_with_thresholds(F.col("scores"), thresholds)))


@dataclass
class Gate:
    """Attack or benign, with the threshold found on validation rows."""

    model: object
    threshold: float

    def score(self, df: DataFrame, out: str = "p_attack") -> DataFrame:
        kept = df.columns
        model = self.model.copy()
        model.setPredictionCol("_gp").setRawPredictionCol("_gr").setProbabilityCol("_gq")
        return model.transform(_vectors(df)).select(*kept, F.get(vector_to_array("_gq"), F.lit(1)).alias(out))


def train_gate(train: DataFrame, val: DataFrame, label: str = "label", benign: str = "BENIGN", **params) -> Gate:
    sides = train.agg(F.count("*").alias("n"), F.count_if(F.col(label) != benign).alias("pos")).first()
    weights = _balanced(sides["n"], sides["pos"])
    model = learner("logreg", sides["n"], **params).fit(_binary(_vectors(train), F.col(label) != benign, *weights))
    gate = Gate(model, 0.5)
    marked = gate.score(val, "score").select(F.lit("ATTACK").alias("class"), "score", (F.col(label) != benign).alias("hit"))
    best = search_thresholds(marked, list(GATE_GRID), macro=True).first()
    gate.threshold = best["threshold"] if best else 0.5
    return gate


def two_stage(train: DataFrame, val: DataFrame, test: DataFrame, mode: str, label: str = "label", benign: str = "BENIGN", **params) -> DataFrame:
    """Test rows with ``prediction`` and, in mode v3, margin and alert level.

    v1: gate, then a subtype model of attacks only, which may leave one unnamed.
    v2: gate, then a model of all classes. v3: the label of a model of all
    classes; the gate only sets the alert level.
    """
    gate = train_gate(train, val, label, benign, **params)
    base = train.filter(F.col(label) != benign) if mode == "v1" else train
    scored = gate.score(train_ovr(base, "svm", label, **params).predict(test, "subtype"))
    p, top = F.col("p_attack"), F.array_max("scores")
    if mode == "v1":
        return scored.withColumn("prediction", hard_gate(p, gate.threshold, F.col("subtype"), top))
    if mode == "v2":
        return scored.withColumn("prediction", hard_gate(p, gate.threshold, F.col("subtype")))
    if mode == "v3":
        return scored.withColumns(
            {"prediction": F.col("subtype"), "margin": score_margin(F.col("scores")), "alert_level": alert_level(F.col("subtype"), p)}
        )
    raise ValueError(f"unknown mode: {mode!r}")


def top_coefficients(model: PerClass, names: list[str], spark, k: int = 15) -> DataFrame:
    """The ``k`` highest and lowest coefficients per class of a linear model."""
    # Classes times features: the size of the model, not of the data.
    rows = [(c, n, float(w)) for c, m in zip(model.labels, model.models) for n, w in zip(names, m.coefficients.toArray())]
    table = local_table(spark, rows, "class string, feature string, weight double")
    up = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "feature"))
    down = F.row_number().over(Window.partitionBy("class").orderBy("weight", "feature"))
    return table.withColumns({"from_top": up, "from_bottom": down}).filter((F.col("from_top") <= k) | (F.col("from_bottom") <= k))


def train_text(df: DataFrame, text: str = "text", label: str = "label", width: int = 1 << 20, words: str | None = None) -> PipelineModel:
    """TF-IDF and naive Bayes over prepared text; ``label`` is 0 or 1.

    Terms are hashed to ``width`` places: none is dropped and no vocabulary is collected.
    ``words`` names a column of tokens made before; the text is not read then.
    """
    words = df.select(_words(text, words).alias("words"), F.col(label).cast("double").alias("label"))
    stages = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=width),
        IDF(inputCol="tf", outputCol="tfidf"),
        NaiveBayes(featuresCol="tfidf", labelCol="label"),
    ]
    return Pipeline(stages=stages).fit(words)


def _words(text: str, words: str | None) -> Column:
    return tokens(scrub_text(text)) if words is None else F.col(words)


def score_text(model: PipelineModel, df: DataFrame, text: str = "text", out: str = "p", words: str | None = None) -> DataFrame:
    kept = df.columns
    scored = model.transform(df.withColumn("words", _words(text, words)))
    return scored.select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias(out))


def train_urls(features: DataFrame, label: str = "label", trees: int = 100, depth: int = 8) -> PipelineModel:
    """Random forest over the URL feature list; ``label`` is 0 or 1."""
    stages = [
        VectorAssembler(inputCols=list(URL_FEATURES), outputCol="x"),
        RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, seed=42),
    ]
    return Pipeline(stages=stages).fit(features)


def score_urls(model: PipelineModel, features: DataFrame, out: str = "p") -> DataFrame:
    kept = features.columns
    return model.transform(features).select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias(out))
