"""Shortcut tests of a dataset: how well a class is told by properties that should not tell it."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import roc_auc
from .relational import hashed_rank, shuffle_key, stratified_folds


def by_scope(df: DataFrame, domain: str, everything: str = "ALL") -> DataFrame:
    """Every row under its domain and under the whole, so that one grouping gives all scopes."""
    return df.withColumn("scope", F.explode(F.array(F.lit(everything), F.col(domain))))


def audit_verdict(auc: Column, tier: str) -> Column:
    """Bands of the verdict on what container properties, or content statistics, tell of the class."""
    if tier == "container":
        return F.when(auc >= 0.9, "BROKEN").when(auc >= 0.75, "SEVERE").when(auc >= 0.6, "MODERATE").otherwise("OK")
    return F.when(auc >= 0.85, "HIGH").when(auc >= 0.65, "MODERATE").otherwise("LOW")


#: Features of a tier: numbers, and columns of which each value is a feature of its own.
Tier = tuple[list[str], list[str]]


def _one_hot(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(df with a 0/1 column for every value, name of the feature by column); the values of such a property are few."""
    names = {}
    for c in columns:
        for i, v in enumerate(sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())):
            names[f"_{c}_{i}"] = f"{c}={v}"
            df = df.withColumn(f"_{c}_{i}", F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)))
    return df, names


def _fit(train: DataFrame, features: list[str], label: str, seed: int):
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return assembler, GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=seed).fit(assembler.transform(train))


_TIERS = "tier string, n long, folds int, auc_mean double, auc_std double, error string"


def separability(df: DataFrame, tiers: dict[str, Tier], label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """tier, n, folds, mean and deviation of the folds' AUC of boosted trees on the tier's features, each fold scored by trees fitted on the others."""
    sizes = dict(df.where(F.col(label).isNotNull()).groupBy(label).count().collect())
    n, k = sum(sizes.values()), min(k, min(sizes.values(), default=0))
    error = "only one class present" if len(sizes) < 2 else "too few samples in minority class for CV" if k < 2 else None
    if error:
        return df.sparkSession.createDataFrame([(tier, n, None, None, None, error) for tier in tiers], _TIERS)
    hot, _names = _one_hot(df, sorted({c for _, columns in tiers.values() for c in columns}))
    folded = stratified_folds(hot.where(F.col(label).isNotNull()), label, key, k, seed).withColumn(label, F.col(label).cast("double")).cache()
    out = []
    for tier, (numbers, columns) in tiers.items():
        features = numbers + [f for f, name in _names.items() if name.split("=")[0] in columns]
        scored = None
        for fold in range(k):
            _, model = _fit(folded.where(F.col("fold") != fold), features, label, seed)
            held = folded.where(F.col("fold") == fold).dropna(subset=features).select("fold", label, array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("features"))
            part = model.transform(held).select("fold", F.col(label), vector_to_array("probability")[1].alias("p"))
            scored = part if scored is None else scored.unionByName(part)
        r = roc_auc(scored, label, "p", ["fold"]).agg(F.count("auc").cast("int"), F.avg("auc"), F.stddev_pop("auc")).first()
        out.append((tier, n, *r, None))
    folded.unpersist()
    return df.sparkSession.createDataFrame(out, _TIERS)


def permutation_importance(df: DataFrame, tier: Tier, label: str, key: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, drop: mean loss of AUC where one feature's values are dealt anew among the rows, by rank of a hash; each value of a one-hot column is a feature."""
    hot, names = _one_hot(df, tier[1])
    features = tier[0] + list(names)
    d = hot.select(key, F.col(label).cast("double").alias(label), *features).dropna(subset=features).cache()
    _, model = _fit(d, features, label, seed)
    predicted = lambda x, *by: model.transform(x.withColumn("features", array_to_vector("_x"))).select(*by, label, vector_to_array("probability")[1].alias("p"))
    # Values as one array: a column for each would make plans of very many constraints.
    own = d.select(key, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    own = hashed_rank(own, [], shuffle_key(seed - 1, key), key, "_i").cache()  # numbers in any order serve
    base = roc_auc(predicted(own), label, "p").first()["auc"]
    at = own.select(key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"), F.col("_x").alias("_o"))
    seeded = F.md5(F.concat((F.col("_r") + seed).cast("string"), F.lit("|"), F.col(key).cast("string")))  # shuffle_key of each repeat
    other = hashed_rank(at, ["_r"], seeded, key, "_i").select("_r", "_o", "_i")
    dealt = own.join(other, "_i").withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    dealt = dealt.select(label, "_r", "_f", F.transform("_x", lambda v, i: F.when(i == F.col("_f"), F.get("_o", i)).otherwise(v)).alias("_x"))
    auc = roc_auc(predicted(dealt, "_r", "_f"), label, "p", ["_r", "_f"])
    called = F.array(*[F.lit(names.get(f, f)) for f in features])
    return auc.groupBy(F.get(called, F.col("_f")).alias("feature")).agg(F.avg(F.lit(base) - F.col("auc")).alias("drop"))
