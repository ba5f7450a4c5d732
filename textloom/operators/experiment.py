"""Experiments: folds, metrics, parameter grids, and models of pyspark.ml on features."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered, seeded_order


AVERAGES = tuple("micro macro weighted binary".split())


def folds(df: DataFrame, row_id: str, k: int, seed: int | None = None) -> DataFrame:
    """row_id, fold: blocks of equal size in the rows' (or a seeded) order; the first n % k have one row more."""
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError(f"{k} folds of {n} rows")
    order = [row_id] if seed is None else [seeded_order(row_id, seed), F.col(row_id)]
    pos = numbered(df.select(row_id), *order, name="p")
    size, more = divmod(n, k)
    edge = more * (size + 1)
    fold = F.when(F.col("p") < edge, F.floor(F.col("p") / (size + 1))).otherwise(more + F.floor((F.col("p") - edge) / size))
    return pos.select(row_id, fold.cast("int").alias("fold"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("long").alias("label"), F.col(prediction).cast("long").alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str, average: str = AVERAGES[0], beta: float = 1) -> DataFrame:
    """One row: accuracy, precision, recall, fscore. average: micro, macro, weighted, or binary (class 1). 0 where undefined."""
    if average not in AVERAGES:
        raise ValueError(f"average is one of {AVERAGES}")
    c = confusion(df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()), label, prediction)
    b2 = beta * beta
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    accuracy = total.select(F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)).alias("accuracy"))
    by = (
        c.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x"))
        .groupBy("x.c")
        .agg(F.sum("x.real").alias("real"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    )
    p = lambda hit, said: F.when(said > 0, hit / said).otherwise(0.0)
    f = lambda p, r: F.when((F.lit(b2) * p + r) > 0, (1 + b2) * p * r / (F.lit(b2) * p + r)).otherwise(0.0)
    if average == "micro":
        s = by.agg(F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
        scores = s.select(p(F.col("hit"), F.col("said")).alias("precision"), p(F.col("hit"), F.col("real")).alias("recall"))
        scores = scores.withColumn("fscore", f(F.col("precision"), F.col("recall")))
    else:
        own = by.filter("c = 1") if average == "binary" else by
        each = own.select(p(F.col("hit"), F.col("said")).alias("p"), p(F.col("hit"), F.col("real")).alias("r"), F.col("real").alias("w")).withColumn("f", f(F.col("p"), F.col("r")))
        mean = (lambda x: F.sum(F.col(x) * F.col("w")) / F.sum("w")) if average == "weighted" else F.avg
        scores = each.agg(*(F.coalesce(mean(x), F.lit(0.0)).alias(name) for x, name in (("p", "precision"), ("r", "recall"), ("f", "fscore"))))
    return accuracy.crossJoin(scores).select(*(F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "fscore")))


def grid(options: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations, in the order given."""
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


@dataclass(frozen=True)
class Experiment:
    """Transformers and a model: fit on rows with features and a label, predict for others."""

    estimator: Estimator
    transformers: tuple[Estimator | Transformer, ...] = ()
    features: str = "features"
    label: str = "label"
    fitted: tuple[Transformer, ...] = ()

    def with_params(self, params: Mapping[str, Any]) -> Experiment:
        own = self.estimator.copy()
        for name, value in params.items():
            own.set(own.getParam(name), value)
        return replace(self, estimator=own, fitted=())

    def fit(self, df: DataFrame) -> Experiment:
        fitted: list[Transformer] = []
        for t in self.transformers:
            done = t.fit(df) if isinstance(t, Estimator) else t
            df = done.transform(df)
            fitted.append(done)
        return replace(self, fitted=(*fitted, self.estimator.fit(df)))

    def partial_fit(self, df: DataFrame) -> Experiment:
        """Go on from the fitted model's weights with more rows; transformers stay as they were fitted."""
        if not self.fitted:
            return self.fit(df)
        if not self.estimator.hasParam("initialWeights"):
            raise TypeError(f"{type(self.estimator).__name__} can't go on from earlier weights")
        for t in self.fitted[:-1]:
            df = t.transform(df)
        own = self.estimator.copy()
        own.set(own.getParam("initialWeights"), self.model.weights)
        return replace(self, fitted=(*self.fitted[:-1], own.fit(df)))

    @property
    def model(self) -> Model:
        if not self.fitted:
            raise RuntimeError("fit first")
        return self.fitted[-1]

    def predict(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit first")
        for t in self.fitted:
            df = t.transform(df)
        return df


@dataclass(frozen=True)
class RawPipeline:
    """An experiment on raw rows: prepare makes features and label of them."""

    prepare: Callable[[DataFrame], DataFrame]
    experiment: Experiment

    def fit(self, raw: DataFrame) -> RawPipeline:
        return replace(self, experiment=self.experiment.fit(self.prepare(raw)))

    def partial_fit(self, raw: DataFrame) -> RawPipeline:
        return replace(self, experiment=self.experiment.partial_fit(self.prepare(raw)))

    def predict(self, raw: DataFrame) -> DataFrame:
        return self.experiment.predict(self.prepare(raw))


def kfold_scores(experiment: Experiment, df: DataFrame, row_id: str, k: int, score: Callable[[DataFrame], float], seed: int | None = None) -> list[float]:
    """The score of each fold, by a model fitted on the others."""
    tagged = df.join(folds(df, row_id, k, seed), row_id)
    return [score(experiment.fit(tagged.filter(F.col("fold") != i)).predict(tagged.filter(F.col("fold") == i))) for i in range(k)]


def k_fold_validation(experiment: Experiment, df: DataFrame, row_id: str, k: int, score: Callable[[DataFrame], float], seed: int | None = None) -> float:
    scores = kfold_scores(experiment, df, row_id, k, score, seed)
    return sum(scores) / len(scores)


def k_fold_classification_metrics(experiment: Experiment, df: DataFrame, row_id: str, k: int, average: str = AVERAGES[0], beta: float = 1, seed: int | None = None) -> dict[str, float]:
    """Means over folds of accuracy, precision, recall and F."""
    found: list[dict[str, float]] = []
    kfold_scores(experiment, df, row_id, k, lambda p: found.append(classification_metrics(p, experiment.label, "prediction", average, beta).first().asDict()) or 0.0, seed)
    return {name: sum(f[name] for f in found) / k for name in found[0]}


def grid_search(experiment: Experiment, df: DataFrame, row_id: str, options: Mapping[str, Sequence[Any]] | Iterable[Mapping[str, Any]], k: int, score: Callable[[DataFrame], float], maximize: bool = True, seed: int | None = None) -> tuple[float, dict[str, Any]]:
    """The best mean score and its parameters; the first of equals."""
    best: tuple[float, dict[str, Any]] | None = None
    for params in grid(options) if isinstance(options, Mapping) else options:
        s = k_fold_validation(experiment.with_params(params), df, row_id, k, score, seed)
        if best is None or (s > best[0] if maximize else s < best[0]):
            best = (s, dict(params))
    if best is None:
        raise ValueError("the grid is empty")
    return best


def linear_svc(label: str = "label", features: str = "features", **params: Any) -> Estimator:
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(labelCol=label, featuresCol=features, **params)


def perceptron(layers: Sequence[int], label: str = "label", features: str = "features", **params: Any) -> Estimator:
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=list(layers), labelCol=label, featuresCol=features, **params)


@dataclass(frozen=True)
class MultilabelSVM:
    """One linear SVM for each label of a multi-hot column; labels with fewer than cutoff rows are predicted 0."""

    labels: str = "labels"
    features: str = "features"
    cutoff: int = 1
    params: Mapping[str, Any] | None = None
    options: Mapping[str, Sequence[Any]] | None = None
    k: int = 3
    models: tuple[Model | None, ...] = ()

    def fit(self, df: DataFrame, row_id: str = "row_id") -> MultilabelSVM:
        first = df.select(F.size(self.labels)).first()
        if first is None:
            raise ValueError("there are no rows")
        sums = df.agg(F.count("*").alias("n"), *(F.sum(F.element_at(self.labels, i + 1)).alias(f"s{i}") for i in range(first[0]))).first()
        models: list[Model | None] = []
        for i in range(first[0]):
            if sums[f"s{i}"] < max(1, self.cutoff) or sums[f"s{i}"] == sums["n"]:
                models.append(None)
                continue
            own = df.withColumn("__y", F.element_at(self.labels, i + 1).cast("double"))
            svc = linear_svc("__y", self.features, **(self.params or {}))
            e = Experiment(svc, label="__y", features=self.features)
            if self.options:
                f1 = lambda p: classification_metrics(p, "__y", "prediction", "binary").first()["fscore"]
                e = e.with_params(grid_search(e, own, row_id, self.options, self.k, f1)[1])
            models.append(e.fit(own).model)
        return replace(self, models=tuple(models))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `prediction`, a multi-hot array."""
        if not self.models:
            raise RuntimeError("fit first")
        for i, m in enumerate(self.models):
            if m is None:
                df = df.withColumn(f"__p{i}", F.lit(0))
            else:
                df = m.copy({m.predictionCol: f"__d{i}", m.rawPredictionCol: f"__r{i}"}).transform(df).withColumn(f"__p{i}", F.col(f"__d{i}").cast("int")).drop(f"__d{i}", f"__r{i}")
        return df.withColumn("prediction", F.array(*(f"__p{i}" for i in range(len(self.models))))).drop(*(f"__p{i}" for i in range(len(self.models))))


def train_multilabel(svm: MultilabelSVM, df: DataFrame, row_id: str, k: int = 3, seed: int | None = None) -> dict[str, float]:
    """Means over outer folds of multilabel_metrics; each fold's parameters are found within its own training rows."""
    tagged = df.join(folds(df, row_id, k, seed), row_id)
    found = [multilabel_metrics(svm.fit(tagged.filter(F.col("fold") != i).drop("fold"), row_id).predict(tagged.filter(F.col("fold") == i)), svm.labels).first().asDict() for i in range(k)]
    return {name: sum(f[name] for f in found) / k for name in found[0]}


def multilabel_metrics(df: DataFrame, labels: str = "labels", prediction: str = "prediction") -> DataFrame:
    """One row: precision, recall and F over all labels (micro), and the means over labels (macro)."""
    x = df.select(F.posexplode(F.arrays_zip(F.col(labels).alias("y"), F.col(prediction).alias("p"))).alias("c", "x")).select("c", F.col("x.y").alias("y"), F.col("x.p").alias("p"))
    by = x.groupBy("c").agg(F.sum("y").alias("real"), F.sum("p").alias("said"), F.sum(F.col("y") * F.col("p")).alias("hit"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    each = by.select("*", div(F.col("hit"), F.col("said")).alias("p"), div(F.col("hit"), F.col("real")).alias("r")).withColumn("f", f(F.col("p"), F.col("r")))
    s = each.agg(F.sum("hit").alias("h"), F.sum("said").alias("s"), F.sum("real").alias("y"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f"))
    s = s.withColumn("micro_precision", div(F.col("h"), F.col("s"))).withColumn("micro_recall", div(F.col("h"), F.col("y"))).withColumn("micro_f", f(F.col("micro_precision"), F.col("micro_recall")))
    return s.select(*(F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "micro_f", "macro_precision", "macro_recall", "macro_f")))
