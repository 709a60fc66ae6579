"""Forensic and consistency signals over frame, pixel, landmark and tile tables: one row media, score per item; score is null where it does not apply."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import relational as R


def second_difference(df: DataFrame, media: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(media).orderBy(order)
    return df.withColumn("d2", F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)).where("d2 is not null")


def frequency_signal(cells: DataFrame, media: str, radius: str, value: str, bins: int = 50) -> DataFrame:
    """From log magnitudes by radius: roughness of the radial profile, and the share of its upper half."""
    profile = R.radial_profile(cells, media, radius, value, bins)
    q = max(bins // 4, 1)
    rough = second_difference(profile, media, "bin", "mean").groupBy(media).agg(F.stddev_pop("d2").alias("sd"))
    level = profile.groupBy(media).agg(F.avg(F.abs("mean")).alias("level"), (F.sum(F.when(F.col("bin") >= 2 * q, F.col("mean"))) / F.sum("mean")).alias("high_freq_ratio"))
    b = F.col("sd") / (F.col("level") + 1e-8)
    return rough.join(level, media).select(media, (b / (b + 1)).alias("score"), "high_freq_ratio")


def compression_signal(pixels: DataFrame, media: list[str], block: list[Column], original: Column, recompressed: Column) -> DataFrame:
    cv = R.block_cv(pixels, media, block, F.abs(original - recompressed))
    return cv.select(*media, "blocks", (F.col("cv") / (F.col("cv") + 1)).alias("score"))


def lighting_signal(df: DataFrame, media: str, inside: Column, light: str, channels: list[str], quadrant: Column) -> DataFrame:
    """With a masked region: its light and channel shares against the rest. Without: the range of the quadrants' light."""
    c_in, c_out = ([F.avg(F.when(m, F.col(c))) for c in channels] for m in (inside, ~inside))
    share = lambda cs: [x / sum(cs[1:], cs[0]) for x in cs]
    delta = sum((F.abs(a - b) for a, b in zip(share(c_in), share(c_out), strict=True)), F.lit(0.0))
    gap = F.abs(F.avg(F.when(inside, F.col(light))) - F.avg(F.when(~inside, F.col(light))))
    masked = df.groupBy(media).agg((0.5 * gap / 40 + 0.5 * delta / 0.3).alias("masked"))
    plain = df.groupBy(media, quadrant.alias("q")).agg(F.avg(light).alias("m")).groupBy(media).agg(((F.max("m") - F.min("m")) / 60).alias("plain"))
    return masked.join(plain, media).select(media, C.squash(F.coalesce("masked", "plain"), "share").alias("score"))


def landmark_signal(points: DataFrame, media: str, frame: str, point: str, left_eye: int = 33, right_eye: int = 263) -> DataFrame:
    """Mean shift of points between neighbouring frames over the distance of the eyes (with fewer points: the diagonal of their box)."""
    frames = points.select(media, frame).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(media).orderBy(frame)))
    p = points.join(frames, [media, frame])
    at = lambda k, c: F.max(F.when(F.col(point) == k, F.col(c)))
    eyes = F.sqrt(F.pow(at(left_eye, "x") - at(right_eye, "x"), F.lit(2)) + F.pow(at(left_eye, "y") - at(right_eye, "y"), F.lit(2)))
    box = F.sqrt(F.pow(F.max("x") - F.min("x"), F.lit(2)) + F.pow(F.max("y") - F.min("y"), F.lit(2)))
    scale = p.groupBy(media, "rank").agg(F.count(F.lit(1)).alias("points"), F.when(F.count(F.lit(1)) > right_eye, eyes).otherwise(box).alias("scale"))
    nxt = p.select(media, (F.col("rank") - 1).alias("rank"), point, F.col("x").alias("nx"), F.col("y").alias("ny"))
    moved = p.join(nxt, [media, "rank", point]).groupBy(media, "rank").agg(F.count(F.lit(1)).alias("common"), F.avg(F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2)))).alias("shift"))
    sizes = scale.select(media, (F.col("rank") - 1).alias("rank"), F.col("points").alias("next_points"))
    pairs = moved.join(scale, [media, "rank"]).join(sizes, [media, "rank"]).where("points = next_points and common = points")
    jitter = pairs.groupBy(media).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("shift") / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)).alias("jitter"))
    every = points.select(media).distinct()
    return every.join(jitter, media, "left").select(media, "pairs", "jitter", C.squash(F.col("jitter"), "ratio", 0.05).alias("score"))


def flow_signal(cells: DataFrame, media: str, frame: str, value: str) -> DataFrame:
    """Variance of the four-neighbour Laplacian of each frame's magnitudes, mirrored at the border, averaged and clipped."""
    grid = [media, frame]

    def around(axis: str, other: str) -> Column:
        w = Window.partitionBy(*grid, other).orderBy(axis)
        lag, lead = F.lag(value).over(w), F.lead(value).over(w)
        return F.coalesce(lag, lead) + F.coalesce(lead, lag)

    lap = cells.withColumn("lap", around("y", "x") + around("x", "y") - 4 * F.col(value))
    return lap.groupBy(*grid).agg(F.var_pop("lap").alias("v")).groupBy(media).agg(F.count(F.lit(1)).alias("frames"), C.squash(F.avg("v"), "share").alias("score"))


def temporal_signal(frames: DataFrame, media: str, prob: str) -> DataFrame:
    """Spread of the classifier's probability over sampled frames; needs two."""
    g = frames.groupBy(media).agg(F.count(F.lit(1)).alias("frames"), F.avg(prob).alias("mean_fake"), F.stddev_pop(prob).alias("std"))
    return g.select(media, "frames", "mean_fake", F.when(F.col("frames") >= 2, C.squash(F.col("std"), "share", 0.25)).alias("score"), F.when(F.col("mean_fake") >= 0.5, "fake").otherwise("real").alias("label"))


def jersey_signal(frames: DataFrame, media: str, hue: str, sat: str, val: str) -> DataFrame:
    v = F.stddev_pop(hue) + 0.3 * F.stddev_pop(sat) + 0.2 * F.stddev_pop(val)
    return frames.groupBy(media).agg(F.count(F.lit(1)).alias("frames"), C.squash(v, "share", 40).alias("s")).select(media, "frames", F.when(F.col("frames") >= 2, F.col("s")).alias("score"))


def torso_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """(left, top, right, bottom) of the torso under a face box, inside the image."""
    side, drop = F.floor(0.3 * w), F.floor(1.5 * h)
    return F.greatest(F.lit(0), x - side), F.least(height, y + h), F.least(width, x + w + side), F.least(height, y + h + drop)


def scene_signal(counts: DataFrame, media: str, frame: str, bin_col: str, n: str, frames: DataFrame | None = None) -> DataFrame:
    """Largest Bhattacharyya distance between the histograms of neighbouring frames, over 0.5. frames: all frames, where one may have no count."""
    ranked = (counts if frames is None else frames).select(media, frame).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(media).orderBy(frame)))
    c = counts.join(ranked, [media, frame]).select(media, "rank", F.col(bin_col).alias("b"), F.col(n).cast("double").alias("v"))
    c = c.withColumn("total", F.sum("v").over(Window.partitionBy(media, "rank")))
    nxt = c.select(media, (F.col("rank") - 1).alias("rank"), "b", F.col("v").alias("v2"), F.col("total").alias("total2"))
    shared = c.join(nxt, [media, "rank", "b"]).groupBy(media, "rank").agg(F.sum(F.sqrt(F.col("v") * F.col("v2") / (F.col("total") * F.col("total2")))).alias("bc"))
    pairs = ranked.select(media, "rank").join(ranked.select(media, (F.col("rank") - 1).alias("rank")), [media, "rank"]).join(shared, [media, "rank"], "left")
    d = F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("bc", F.lit(0.0))))
    return pairs.groupBy(media).agg(F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("mean_distance"), C.squash(F.max(d), "share", 0.5).alias("score"))


def overlay_signal(df: DataFrame, media: list[str], border: Column, error: str) -> DataFrame:
    m = R.region_means(df, media, border, [error])
    r = F.abs(F.col(f"{error}_inside") - F.col(f"{error}_outside")) / (F.col(f"{error}_outside") + 1e-6)
    return m.select(*media, C.squash(r, "share", 2).alias("score"))


def crowd_signal(tiles: DataFrame, media: str, positions: list[str], vector: str, apart: float, least: int = 4) -> DataFrame:
    """Largest cosine of mean-centred tiles that are far apart; too few tiles: not applicable."""
    n = F.size(vector)
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)
    centred = tiles.withColumn("_m", total / n).withColumn("_c", F.transform(vector, lambda x: x - F.col("_m")))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, x: s + x * x))
    unit = centred.withColumn("_n", F.when(norm > 0, norm).otherwise(1e-6)).select(media, *positions, F.transform("_c", lambda x: x / F.col("_n")).alias("u"))
    best = R.tile_pairs(unit, media, positions, "u", apart)
    counts = tiles.groupBy(media).agg(F.count(F.lit(1)).alias("tiles"))
    s = F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))
    return counts.join(best, media, "left").select(media, "tiles", F.when(F.col("tiles") >= least, C.squash(s, "above")).alias("score"), F.when(F.col("tiles") >= least, s).alias("similarity"))


def as_signals(*named: tuple[str, DataFrame, str]) -> DataFrame:
    """Long signals from (name, rows, media column): what a failed or inapplicable detector gives is a null score."""
    out = None
    for name, df, media in named:
        part = df.select(F.col(media).cast("string").alias("media"), F.lit(name).alias("signal"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def isolated(detect, schema: str = "applicable boolean, score double, error string"):
    """A detector over one Arrow batch whose failure on a row becomes that row's error, never the job's."""
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                score = detect(v)
                rows.append((score is not None, score, None))
            except Exception as e:  # noqa: BLE001  the contract of a detector
                rows.append((False, None, type(e).__name__))
        return pd.DataFrame(rows, columns=["applicable", "score", "error"])

    return F.pandas_udf(run, schema)


def classifier_signal(media: DataFrame, probs: DataFrame, key: str, prob: str) -> DataFrame:
    return media.select(key).distinct().join(probs.select(key, F.col(prob).alias("score")), key, "left")


def probe_signal(embeddings: DataFrame, key: str, vector: str, head: dict) -> DataFrame:
    logit = C.linear_logit(F.col(vector), head["weights"], head["bias"], head["mean"], head["std"])
    return embeddings.select(key, F.when(F.size(vector) == len(head["weights"]), C.sigmoid(logit)).alias("score"))
