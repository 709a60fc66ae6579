"""Probe and combiner: standardise, reduce, fit, and fold all into one dot product."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import linear_logit
from ..sources.scratch import discard, materialize
from .grid import fit_grid, held_out_scores
from .metrics import roc_auc, youden_threshold
from .relational import stratified_folds


def fit_standardiser(df: DataFrame, vector: str) -> DataFrame:
    """dim, mean, std of each component; a spread below 1e-6 counts as 1."""
    e = df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    return e.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def _standardised(df: DataFrame, vector: str, mean: list[float], std: list[float]) -> DataFrame:
    pairs = F.zip_with(F.zip_with(vector, F.array(*[F.lit(m) for m in mean]), lambda a, b: a.cast("double") - b), F.array(*[F.lit(s) for s in std]), lambda a, b: a / b)
    return df.withColumn("z", array_to_vector(pairs))


def fit_probe(df: DataFrame, vector: str, label: str, components: int, c: float) -> dict:
    """The head: mean, std, weights, bias of one dot product that stands for standardising, PCA and the logistic fit. Only coefficients reach the driver."""
    s = sorted(fit_standardiser(df, vector).collect())
    mean, std = [r.mean for r in s], [r.std for r in s]
    z = _standardised(df, vector, mean, std)
    n = z.count()
    pca = PCA(k=components, inputCol="z", outputCol="features").fit(z)
    model = LogisticRegression(labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100).fit(pca.transform(z))
    weights = pca.pc.toArray() @ model.coefficients.toArray()
    return {"mean": mean, "std": std, "weights": [float(w) for w in weights], "bias": float(model.intercept), "pca": pca, "model": model}


def choose_probe(df: DataFrame, vector: str, label: str, key: str, k: int = 5, seed: int = 0) -> tuple[int, float, float]:
    """(components, C, mean AUC of the held-out folds) of the best pair of the grid.

    All folds and pairs are fitted in the same passes (operators/grid.py), and all their models score the held-out rows at once. Of equal pairs the one with fewer components,
    then the smaller C is taken. Rows without a vector or a label take no part.
    """
    df = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    s = sorted(fit_standardiser(df, vector).collect())
    if not s:
        raise ValueError("no fold has both classes")
    folded = stratified_folds(_standardised(df, vector, [r.mean for r in s], [r.std for r in s]), label, key, k, seed)
    z = materialize(folded.select(vector_to_array("z").alias("z"), F.col(label).cast("int").alias(label), F.col("fold").cast("int").alias("fold")), "probe-rows")
    try:
        models = fit_grid(z, label, len(s), k, probe_grid(len(s)))
        scored = roc_auc(held_out_scores(z, label, len(s), models), label, "p", ["model"]).where("auc is not null").collect() if models else []
    finally:
        discard(z)
    of: dict[tuple[int, float], list[float]] = {}
    for r in scored:
        of.setdefault(models[r.model][1:3], []).append(r.auc)
    if not of:
        raise ValueError("no fold has both classes")
    mean = {pair: sum(x) / len(x) for pair, x in of.items()}
    best = max(mean, key=lambda pair: (round(mean[pair], 12), -pair[0], -pair[1]))
    return *best, mean[best]


def operating_threshold(val: DataFrame, label: str, score: str) -> float:
    return float(youden_threshold(val, label, score).first()["threshold"])


def head_parity(df: DataFrame, vector: str, head: dict, most: float = 1e-6) -> DataFrame:
    """One row: the largest difference between the chain of models and the one dot product; the job fails if it is above the bound."""
    chain = head["model"].transform(head["pca"].transform(_standardised(df, vector, head["mean"], head["std"]))).withColumn("chain", vector_to_array("rawPrediction")[1])
    drift = chain.agg(F.max(F.abs(F.col("chain") - linear_logit(F.col(vector), head["weights"], head["bias"], head["mean"], head["std"]))).alias("drift"))
    return drift.select(F.when(F.col("drift") > most, F.raise_error(F.concat(F.lit("the head disagrees with the chain of models: "), F.col("drift").cast("string"))).cast("double")).otherwise(F.col("drift")).alias("drift"))


def probe_grid(dims: int) -> list[tuple[int, float]]:
    """Components and the logarithmic grid of C."""
    return [(n, 10 ** (-3 + 5 * i / 9)) for n in (8, 16, 32, 64, 128) if n <= dims for i in range(10)]


def fit_combiner(wide: DataFrame, features: list[str], label: str, c: float = 1.0, split: str = "val") -> dict:
    """Logistic weights and threshold from the complete rows of one split only."""
    rows = wide.where(F.col("split") == split).dropna(subset=features).withColumn("features", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))
    n = rows.count()
    model = LogisticRegression(labelCol=label, regParam=1 / (c * max(n, 1)), standardization=False, maxIter=100).fit(rows)
    threshold = operating_threshold(model.transform(rows).withColumn("p", vector_to_array("probability")[1]), label, "p")
    return {"features": tuple(features), "weights": tuple(map(float, model.coefficients)), "intercept": float(model.intercept), "threshold": threshold, "n": n}


def save_record(spark: SparkSession, record: dict, path: str) -> None:
    """Write a fitted model's numbers as one JSON line in a folder of any file system that Spark reaches."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def head_record(head: dict, backbone: str, components: int, threshold: float, n_train: int, metrics: dict | None = None) -> dict:
    """What serving needs of a probe: p = sigmoid(weights . (x - mean) / std + bias), and where it came from."""
    return {
        "backbone_model_id": backbone, "feature_dim": len(head["mean"]), **{k: head[k] for k in ("mean", "std", "weights", "bias")}, "pca_n_components": components,
        "operating_threshold": threshold, "trained_on": {"n_train": n_train}, "metrics": metrics or {},
    }


def calibration_record(fit: dict, split: str = "val", metrics: dict | None = None) -> dict:
    return {"features": list(fit["features"]), "weights": list(fit["weights"]), "intercept": fit["intercept"], "operating_threshold": fit["threshold"], "fitted_on": {"split": split, "n": fit["n"]}, "metrics": metrics or {}}


def as_calibration(record: dict) -> dict:
    """A saved calibration as learned_fusion() and fuse() take it; every feature needs its weight."""
    if len(record["features"]) != len(record["weights"]):
        raise ValueError("a calibration needs one weight for each feature")
    return {"features": tuple(record["features"]), "weights": tuple(record["weights"]), "intercept": record["intercept"], "threshold": record["operating_threshold"]}
