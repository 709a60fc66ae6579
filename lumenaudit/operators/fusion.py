"""Fusion of partial signals into one explained verdict per media item. Signals come long: media, signal, score (null: not applicable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Weight of each pool of signals and its members; a pool's weight is shared by all its members, applicable or not.
POOLS = {
    "ai": (0.15, ("deep_learning",)),
    "trained": (0.60, ("trained_probe",)),
    "forensic": (0.15, ("frequency_analysis", "compression_analysis", "lighting_analysis", "landmark_instability", "optical_flow_analysis", "temporal_consistency")),
    "provenance": (0.35, ("provenance_ai_metadata", "provenance_c2pa", "provenance_camera_metadata")),
    "sports": (0.10, ("jersey_color_consistency", "scene_consistency", "broadcast_overlay_analysis", "crowd_texture_analysis")),
}
#: The fitted combiner and its operating threshold.
CALIBRATION = {
    "features": ("trained_probe", "deep_learning", "frequency_analysis", "compression_analysis", "lighting_analysis", "broadcast_overlay_analysis", "crowd_texture_analysis"),
    "weights": (2.9079513934253307, -0.5403208450335905, -0.02891059284245576, -0.11086691055945022, -0.8751275854358868, -0.4454352706350485, 0.02994223855821864),
    "intercept": -0.6094598786378679,
    "threshold": 0.4454,
}
#: Shift of the logit by decisive provenance.
SHIFTS = {"provenance_ai_metadata": 2.2, "provenance_c2pa": 2.2, "provenance_camera_metadata": 0.5}
PLAIN_THRESHOLD = 0.5


def pool_weights(spark: SparkSession, pools=POOLS) -> DataFrame:
    """signal, weight, pos: one row for each known signal."""
    rows = [(s, w / len(members)) for w, members in pools.values() for s in members]
    return spark.createDataFrame([(s, w, i) for i, (s, w) in enumerate(rows)], "signal string, weight double, pos int")


def nominal_weights(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """signals with the weight of each, applicable or not; unknown ones weigh nothing."""
    return signals.join(weights.select("signal", "weight"), "signal", "left").fillna(0.0, subset=["weight"])


def weighted_mean(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """media, fused, weight_sum over applicable signals; unknown ones weigh nothing. Without weight the sum counts as 1."""
    s = signals.where("score is not null").join(weights, "signal", "left").fillna(0.0, subset=["weight"])
    total = F.sum("weight")
    return s.groupBy("media").agg((F.sum(F.col("score") * F.col("weight")) / F.when(total > 0, total).otherwise(1.0)).alias("fused"), total.alias("weight_sum"))


def share_of_weight(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Applicable signals with their renormalised weight and their position."""
    s = signals.where("score is not null").join(weights, "signal", "left").fillna(0.0, subset=["weight"])
    total = F.sum("weight").over(Window.partitionBy("media"))
    return s.withColumn("weight", F.col("weight") / F.when(total > 0, total).otherwise(1.0))


def _sum_where(signal: Column, score: Column, factors: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, w in factors.items():
        out = F.when(signal == name, score * F.lit(w)).otherwise(out)
    return F.coalesce(F.sum(out), F.lit(0.0))


def learned_fusion(signals: DataFrame, calibration=CALIBRATION) -> DataFrame:
    """media, logit (of the fitted model), shift, p, contributions (feature -> weight times score), applied (provenance signal -> its part of the shift) for media
    that have every feature: one aggregate, no pivot. The maps hold fixed names, so that nothing is collected; a feature that occurs twice counts with its sum."""
    signal, score = F.col("signal"), F.col("score")
    features = dict(zip(calibration["features"], calibration["weights"], strict=True))
    shift = F.lit(0.0)
    for name, m in SHIFTS.items():
        shift = F.when((signal == name) & (score >= C.BAND_HIGH), m).when((signal == name) & (score <= C.BAND_LOW), -m).otherwise(shift)
    parts = F.create_map(*[x for name, w in features.items() for x in (F.lit(name), F.sum(F.when(signal == name, score * F.lit(w))))])
    shifts = F.create_map(*[x for name in SHIFTS for x in (F.lit(name), F.sum(F.when(signal == name, shift)))])
    out = signals.where("score is not null").groupBy("media").agg(
        F.countDistinct(F.when(signal.isin(*features), signal)).alias("found"), (F.lit(calibration["intercept"]) + _sum_where(signal, score, features)).alias("logit"), F.sum(shift).alias("shift"),
        parts.alias("contributions"), F.map_filter(shifts, lambda _, v: v != 0).alias("applied"),
    )
    return out.where(F.col("found") == len(features)).select("media", "logit", "shift", C.sigmoid(F.col("logit") + F.col("shift")).alias("p"), "contributions", "applied")


def fuse(signals: DataFrame, weights: DataFrame, calibration=CALIBRATION) -> DataFrame:
    """One row per media: score, method, verdict, confidence, risk; status failed where no signal applies."""
    learned = learned_fusion(signals, calibration).select("media", "p")
    every = signals.groupBy("media").agg(F.count("score").alias("applicable"))
    x = every.join(weighted_mean(signals, weights), "media", "left").join(learned, "media", "left")
    s = F.coalesce("p", "fused")
    threshold = F.when(F.col("p").isNotNull(), calibration["threshold"]).otherwise(PLAIN_THRESHOLD)
    verdict = F.when(s >= threshold, "suspicious").when(s.isNotNull(), "authentic")
    return x.select(
        "media", s.alias("score"), F.when(F.col("p").isNotNull(), "learned").when(s.isNotNull(), "weighted").alias("method"), verdict.alias("verdict"),
        F.when(verdict == "suspicious", 100 * s).otherwise(100 * (1 - s)).alias("confidence"), F.when(s.isNotNull(), C.risk(s)).alias("risk"),
        F.when(F.col("applicable") > 0, "completed").otherwise("failed").alias("status"),
    )


def stamp_versions(df: DataFrame, signals: DataFrame, backbone: str, pipeline: str) -> DataFrame:
    probe = signals.where("signal = 'trained_probe' and score is not null").select("media", F.lit(f"probe/{backbone}").alias("model_version")).distinct()
    return df.join(probe, "media", "left").withColumn("pipeline_version", F.lit(pipeline))
