"""From pixels to signals: colour as column expressions, boxes and borders as predicates, tiles and blocks as groups, one Fourier transform per image.

A pixel table has a row for each pixel: the item's key columns, y, x and 8-bit channels r, g, b. A box table has the same keys and x, y, w, h; an item may have no box or several.
An item's size is one more than its largest y and x. An item without pixels is none; null channels count as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import signals as G

#: Luma weights in 14 bits; linear light of an 8-bit channel and its share of luminance; bins of hue and saturation; widths, shares and distances of the signals.
LUMA = {"r": 4899, "g": 9617, "b": 1868}
LUMINANCE = {"r": 0.212671, "g": 0.715160, "b": 0.072169}
HUES, SATURATIONS = 30, 32
UPPER, WIDEST, TILE, APART = 0.4, 240, 24, 40
BORDER, BLOCK = 0.15, 16


def _channel(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))


def gray(r: Column | None = None, g: Column | None = None, b: Column | None = None) -> Column:
    """8-bit luma."""
    at = {"r": _channel("r") if r is None else r, "g": _channel("g") if g is None else g, "b": _channel("b") if b is None else b}
    return F.shiftright(sum((at[c] * w for c, w in LUMA.items()), F.lit(1 << 13)).cast("long"), 14)


def hsv() -> tuple[Column, Column, Column]:
    """Hue (0-179), saturation and value (0-255), in 12-bit fixed point with rounded reciprocals."""
    r, g, b = _channel("r"), _channel("g"), _channel("b")
    top = F.greatest(r, g, b)
    span = top - F.least(r, g, b)
    inverse = lambda whole, of: F.floor(F.lit(float(whole << 12)) / F.nullif(of, F.lit(0)) + 0.5).cast("long")
    sector = F.when(top == r, g - b).when(top == g, b - r + 2 * span).otherwise(r - g + 4 * span)
    hue = F.coalesce(F.shiftright(sector * inverse(30, span) + 2048, 12), F.lit(0).cast("long"))
    saturation = F.coalesce(F.shiftright(span * inverse(255, top) + 2048, 12), F.lit(0).cast("long"))
    return F.when(hue < 0, hue + 180).otherwise(hue), saturation, top


def lightness() -> Column:
    """L of CIE Lab, 0-255, rounded."""
    linear = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    light = sum((linear(_channel(c) / 255.0) * w for c, w in LUMINANCE.items()), F.lit(0.0))
    return F.floor(F.when(light > 0.008856, 116 * F.cbrt(light) - 16).otherwise(903.3 * light) * 2.55 + 0.5)


def sizes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width."""
    return pixels.groupBy(*keys).agg((F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"))


def _in_box(pixels: DataFrame, boxes: DataFrame, keys: list[str], left="x", top="y", right=None, bottom=None) -> Column:
    right, bottom = (boxes[left] + boxes["w"], boxes[top] + boxes["h"]) if right is None else (boxes[right], boxes[bottom])
    same = [pixels[k].eqNullSafe(boxes[k]) for k in keys]
    within = (pixels["x"] >= boxes[left]) & (pixels["x"] < right) & (pixels["y"] >= boxes[top]) & (pixels["y"] < bottom)
    for s in same:
        within = within & s
    return within


# Frequency


def spectrum(pixels: DataFrame, media: str) -> DataFrame:
    """media, y, x, radius, magnitude: log(1 + |F|) of an item's luma, zero frequency in the middle.

    One sort brings the pixels of an item together; an item is transformed when its last row has come, so a task holds one item and a batch.
    """
    kind = pixels.schema[media].dataType.simpleString()
    rows = pixels.select(media, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), gray().alias("v"))

    def transformed(key: pa.Scalar, parts: list[pa.RecordBatch]):
        y, x, v = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("y", "x", "v"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        image[y, x] = v
        m = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(image))))
        rows, cols = np.indices(m.shape).reshape(2, -1)
        radius = np.sqrt((cols - m.shape[1] / 2) ** 2 + (rows - m.shape[0] / 2) ** 2)
        for k in range(0, m.size, 1 << 16):
            s = slice(k, k + (1 << 16))
            n = len(rows[s])
            yield pa.RecordBatch.from_arrays([pa.repeat(key, n), pa.array(rows[s]), pa.array(cols[s]), pa.array(radius[s]), pa.array(m.ravel()[s])], [media, "y", "x", "radius", "magnitude"])

    def run(it):
        key, parts = None, []
        for batch in it:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.column(0)[a]
                if parts and not (own.is_valid == key.is_valid and own.as_py() == key.as_py()):
                    yield from transformed(key, parts)
                    parts = []
                key = own
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from transformed(key, parts)

    return rows.repartition(media).sortWithinPartitions(media).mapInArrow(run, f"`{media}` {kind}, y long, x long, radius double, magnitude double")


def frequency(pixels: DataFrame, media: str, bins: int = 50) -> DataFrame:
    """media, score, high_freq_ratio."""
    return G.frequency_signal(spectrum(pixels, media), media, "radius", "magnitude", bins)


# Error levels


def error_levels(pixels: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, error: mean absolute difference of the channels of an item and of its recompressed copy."""
    other = again.select(*keys, "y", "x", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    error = sum((F.abs(_channel(c) - _channel(f"{c}2")) for c in "rgb"), F.lit(0)) / 3
    return pixels.join(other, [*keys, "y", "x"]).select(*keys, "y", "x", error.alias("error"))


def whole_blocks(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Rows of whole blocks, with block_y and block_x; an item smaller than a block is one block."""
    sized = df.join(sizes(df, keys), keys)
    tall, wide = F.floor(F.col("height") / block), F.floor(F.col("width") / block)
    small = (tall == 0) | (wide == 0)
    kept = sized.where(small | ((F.col("y") < tall * block) & (F.col("x") < wide * block)))
    at = lambda c: F.when(small, 0).otherwise(F.floor(F.col(c) / block))
    return kept.withColumn("block_y", at("y")).withColumn("block_x", at("x")).drop("height", "width")


def compression(pixels: DataFrame, again: DataFrame, media: str, block: int = BLOCK) -> DataFrame:
    """media, blocks, score from the spread of error levels over whole blocks."""
    e = whole_blocks(error_levels(pixels, again, [media]), [media], block)
    return G.compression_signal(e, [media], [F.col("block_y"), F.col("block_x")], F.col("error"), F.lit(0.0))


def overlay(pixels: DataFrame, again: DataFrame, media: str, border: float = BORDER) -> DataFrame:
    """media, score from the error levels of the border (so much of each side) against the rest."""
    e = error_levels(pixels, again, [media])
    sized = e.join(sizes(e, [media]), media)
    inner = lambda c, size: (F.col(c) >= F.floor(F.col(size) * border)) & (F.col(c) < F.col(size) - F.floor(F.col(size) * border))
    return G.overlay_signal(sized, [media], ~(inner("y", "height") & inner("x", "width")), "error")


# Light


def lighting(pixels: DataFrame, boxes: DataFrame, media: str) -> DataFrame:
    """media, mode, score: with a box, its lightness and channel shares against the rest; without, the range of the quadrants' luma. One aggregation holds both."""
    marked = pixels.join(boxes.select(media).distinct().withColumn("boxed", F.lit(True)), media, "left").join(sizes(pixels, [media]), media)
    inside = pixels.join(boxes, _in_box(pixels, boxes, [media]), "left_semi").select(media, "y", "x").withColumn("inside", F.lit(True))
    p = marked.join(inside, [media, "y", "x"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))).withColumn("l", lightness()).withColumn("luma", gray())
    low, left = F.col("y") >= F.floor(F.col("height") / 2), F.col("x") >= F.floor(F.col("width") / 2)
    mean = lambda of, where: F.avg(F.when(where, of))
    aggs = [mean(F.col("luma"), a & b).alias(f"q{k}") for k, (a, b) in enumerate([(~low, ~left), (~low, left), (low, ~left), (low, left)])]
    for name, where in (("in", F.col("inside")), ("out", ~F.col("inside"))):
        aggs += [F.coalesce(mean(of, where), F.lit(0.0)).alias(f"{c}_{name}") for c, of in (("l", F.col("l")), *((c, _channel(c)) for c in "rgb"))]
    g = p.groupBy(media).agg(F.max("boxed").alias("boxed"), *aggs)
    share = lambda c, side: F.col(f"{c}_{side}") / (sum((F.col(f"{x}_{side}") for x in "rgb"), F.lit(1e-6)))
    delta = sum((F.abs(share(c, "in") - share(c, "out")) for c in "rgb"), F.lit(0.0))
    masked = 0.5 * F.abs(F.col("l_in") - F.col("l_out")) / 40 + 0.5 * delta / 0.3
    quadrants = [f"q{k}" for k in range(4)]
    plain = (F.greatest(*quadrants) - F.least(*quadrants)) / 60
    score = C.squash(F.when(F.col("boxed"), masked).otherwise(plain), "share")
    return g.select(media, F.when(F.col("boxed"), "face_vs_background").otherwise("quadrant_fallback").alias("mode"), score.alias("score"))


# Frames of a clip


def jersey(pixels: DataFrame, boxes: DataFrame, media: str, frame: str) -> DataFrame:
    """media, frames, score: spread of the mean colour below the face box over the frames that show it; every media item has a row."""
    keys = [media, frame]
    b = boxes.join(sizes(pixels, keys), keys)
    left, top, right, bottom = G.torso_box(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    torso = b.select(*keys, left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    within = pixels.join(torso, _in_box(pixels, torso, keys, "left", "top", "right", "bottom"), "left_semi")
    means = within.groupBy(*keys).agg(*[F.avg(c).alias(n) for c, n in zip(hsv(), ("hue", "sat", "val"), strict=True)])
    scored = G.jersey_signal(means, media, "hue", "sat", "val")
    return pixels.select(media).distinct().join(scored, media, "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))


def background_histograms(pixels: DataFrame, boxes: DataFrame, media: str, frame: str) -> DataFrame:
    """media, frame, bin, n: pixels outside the boxes by hue and saturation."""
    outside = pixels.join(boxes, _in_box(pixels, boxes, [media, frame]), "left_anti")
    hue, saturation, _ = hsv()
    cell = F.floor(hue * HUES / 180) * SATURATIONS + F.floor(saturation * SATURATIONS / 256)
    return outside.groupBy(media, frame, cell.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scene(pixels: DataFrame, boxes: DataFrame, media: str, frame: str) -> DataFrame:
    """media, pairs, mean_distance, score of the backgrounds of neighbouring frames; a frame that its box covers whole is at distance 1 from any; every media item has a row."""
    frames = pixels.select(media, frame).distinct()
    s = G.scene_signal(background_histograms(pixels, boxes, media, frame), media, frame, "bin", "n", frames)
    return frames.select(media).distinct().join(s, media, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))


# Tiles


def upper_region(pixels: DataFrame, media: str, upper: float = UPPER, widest: int = WIDEST) -> DataFrame:
    """media, height, width, y, x, v: luma of the upper part, averaged over areas down to at most so many columns.

    A pixel gives each target pixel the share of its area that lies there, so at most four rows; channels are averaged and rounded, then turned to luma.
    """
    sized = pixels.join(sizes(pixels, [media]), media).withColumn("cut", F.floor(F.col("height") * upper)).where(F.col("y") < F.col("cut"))
    fits = F.col("width") <= widest
    sized = sized.withColumn("to_width", F.when(fits, F.col("width")).otherwise(F.lit(widest).cast("long")))
    sized = sized.withColumn("to_height", F.when(fits, F.col("cut")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.col("cut") * (widest / F.col("width"))))))

    def parts(at: str, of: str, to: str) -> Column:
        """(target, overlap) of a pixel on one axis; a step of the target is at least one pixel."""
        step = F.col(of) / F.col(to)
        first = F.least(F.floor(F.col(at) / step + 1e-9), F.col(to) - 1)
        edge = (first + 1) * step
        here = F.struct(first.alias("to"), (F.least(F.col(at) + 1, edge) - F.col(at)).alias("share"))
        there = F.struct((first + 1).alias("to"), (F.col(at) + 1 - edge).alias("share"))
        return F.when((edge < F.col(at) + 1 - 1e-9) & (first + 1 < F.col(to)), F.array(here, there)).otherwise(F.array(here))

    spread = sized.withColumn("py", F.explode(parts("y", "cut", "to_height"))).withColumn("px", F.explode(parts("x", "width", "to_width")))
    share = F.col("py.share") * F.col("px.share")
    mean = lambda c: F.floor(F.sum(_channel(c) * share) / F.sum(share) + 0.5 + 1e-6).cast("long").alias(c)
    small = spread.groupBy(media, F.col("to_height").alias("height"), F.col("to_width").alias("width"), F.col("py.to").alias("y"), F.col("px.to").alias("x")).agg(*[mean(c) for c in "rgb"])
    return small.select(media, "height", "width", "y", "x", gray().alias("v"))


def crowd(pixels: DataFrame, media: str, tile: int = TILE, apart: float = APART, upper: float = UPPER, widest: int = WIDEST) -> DataFrame:
    """media, tiles, score, similarity of the tiles of the upper region; every media item has a row.

    Tiles begin at multiples of tile below size - tile, so one that ends at the region's edge is left out.
    """
    region = upper_region(pixels, media, upper, widest)
    at = {c: F.floor(F.col(c) / tile) * tile for c in "yx"}
    whole = region.where((at["y"] < F.col("height") - tile) & (at["x"] < F.col("width") - tile))
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    tiles = whole.groupBy(media, at["y"].alias("top"), at["x"].alias("left")).agg(F.transform(cells, lambda c: c["v"].cast("double")).alias("vector"))
    scored = G.crowd_signal(tiles, media, ["top", "left"], "vector", apart)
    return pixels.select(media).distinct().join(scored, media, "left").withColumn("tiles", F.coalesce("tiles", F.lit(0).cast("long")))
