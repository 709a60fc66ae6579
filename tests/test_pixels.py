"""Signals from pixels: known images, and numpy on whole images."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenaudit.operators import pixels as P

BOX = "media string, frame int, x int, y int, w int, h int"


def pixel_rows(spark, images):
    """images: {(media, frame): height x width (x 3) array}."""
    rows = []
    for (media, frame), a in images.items():
        a = np.repeat(a[:, :, None], 3, 2) if a.ndim == 2 else a
        rows += [(media, frame, y, x, *map(int, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "media string, frame int, y int, x int, r int, g int, b int")


def stills(spark, images):
    return pixel_rows(spark, {(m, 0): a for m, a in images.items()}).drop("frame")


def by_media(df):
    return {r.media: r for r in df.collect()}


def luma(a):
    return (a[..., 0] * 4899 + a[..., 1] * 9617 + a[..., 2] * 1868 + (1 << 13)) >> 14


def test_spectrum_is_that_of_numpy(spark):
    rng = np.random.default_rng(1)
    images = {"odd": rng.integers(0, 256, (9, 13, 3)), "even": rng.integers(0, 256, (16, 8, 3)), "dot": rng.integers(0, 256, (1, 1, 3))}
    got = P.spectrum(stills(spark, images).repartition(3), "media").collect()
    for name, a in images.items():
        want = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(luma(a)))))
        own = {(r.y, r.x): (r.magnitude, r.radius) for r in got if r.media == name}
        assert len(own) == want.size
        for (y, x), (m, radius) in own.items():
            assert m == pytest.approx(want[y, x], abs=1e-9)
            assert radius == pytest.approx(np.hypot(y - want.shape[0] / 2, x - want.shape[1] / 2))


def test_noise_is_smooth_and_a_grating_is_not(spark):
    rng = np.random.default_rng(0)
    y, x = np.indices((64, 64))
    images = {"noise": rng.integers(0, 256, (64, 64)), "grating": np.where((x // 4 + y // 4) % 2, 255, 0), "flat": np.full((64, 64), 128)}
    got = by_media(P.frequency(stills(spark, images), "media"))
    assert got["noise"].score < 0.2 < got["grating"].score
    assert all(0 <= r.score <= 1 and 0 <= r.high_freq_ratio <= 1 for r in got.values())


def test_colours_of_every_kind(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.integers(0, 256, (60, 5, 3)), np.array([[[0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]])])
    hue, sat, val = P.hsv()
    got = stills(spark, {"m": a}).select("r", "g", "b", hue.alias("h"), sat.alias("s"), val.alias("v"), P.lightness().alias("l"), P.gray().alias("y")).collect()
    for r in got:
        h, s, v = colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255)
        assert r.v == round(v * 255) and abs(r.s - s * 255) <= 0.51 and min(abs(r.h - h * 180), 180 - abs(r.h - h * 180)) <= 0.6 and 0 <= r.h < 180
        assert abs(r.y - (0.299 * r.r + 0.587 * r.g + 0.114 * r.b)) <= 0.51
    at = {(r.r, r.g, r.b): r.l for r in got}
    assert (at[0, 0, 0], at[255, 255, 255], at[255, 0, 0], at[0, 255, 0], at[0, 0, 255]) == (0, 255, 136, 224, 82)


def test_whole_blocks(spark):
    rng = np.random.default_rng(3)
    images = {"wide": rng.integers(0, 256, (20, 40, 3)), "small": rng.integers(0, 256, (9, 40, 3)), "exact": rng.integers(0, 256, (32, 32, 3))}
    p = stills(spark, images)
    again = p.select("media", "y", "x", *[(F.col(c) - F.col(c) % 10).alias(c) for c in "rgb"])
    got = by_media(P.compression(p, again, "media"))
    assert {m: r.blocks for m, r in got.items()} == {"wide": 2, "small": 1, "exact": 4}
    e = (images["exact"] % 10).mean(2).reshape(2, 16, 2, 16).mean((1, 3))
    cv = e.std() / (e.mean() + 1e-6)
    assert got["exact"].score == pytest.approx(cv / (cv + 1)) and got["small"].score == 0
    border = by_media(P.overlay(p, again, "media"))
    for m, a in images.items():
        e, (h, w) = (a % 10).mean(2), a.shape[:2]
        c = np.zeros((h, w), bool)
        c[int(h * 0.15) : h - int(h * 0.15), int(w * 0.15) : w - int(w * 0.15)] = True
        outer = e[~c].mean() if (~c).any() else 0
        assert border[m].score == pytest.approx(min(1, abs(outer - e[c].mean()) / (e[c].mean() + 1e-6) / 2))


def test_lighting_with_and_without_a_box(spark):
    bright = np.full((40, 40, 3), 60)
    bright[10:20, 10:20] = 230
    halves = np.full((40, 40, 3), 20)
    halves[:, 20:] = 220
    images = {"pasted": bright, "even": np.full((40, 40, 3), 90), "halves": halves, "flat": np.full((40, 40, 3), 90), "whole": np.full((4, 4, 3), 90)}
    boxes = spark.createDataFrame([("pasted", 0, 10, 10, 10, 10), ("even", 0, 10, 10, 10, 10), ("whole", 0, 0, 0, 9, 9), ("absent", 0, 1, 1, 1, 1)], BOX).drop("frame")
    got = by_media(P.lighting(stills(spark, images), boxes, "media"))
    assert {m: r.mode == "face_vs_background" for m, r in got.items()} == {"pasted": True, "even": True, "halves": False, "flat": False, "whole": True}
    assert got["pasted"].score == 1 and got["even"].score == pytest.approx(0, abs=1e-6) and got["halves"].score == 1 and got["flat"].score == 0 and got["whole"].score == 1


def frames_of(colours, size=(24, 24)):
    return [np.broadcast_to(np.array(c), (*size, 3)).copy() for c in colours]


def test_jersey_follows_the_torso_only(spark):
    steady = frames_of([(200, 30, 30)] * 4)
    for k, a in enumerate(steady):  # what changes lies outside the torso
        a[:6] = 60 * k
    changing = frames_of([(200, 30, 30), (30, 200, 30), (30, 30, 200), (200, 200, 30)])
    images = {(m, k): a for m, clip in (("steady", steady), ("changing", changing), ("single", steady[:1]), ("low", steady)) for k, a in enumerate(clip)}
    boxes = spark.createDataFrame([(m, k, 8, 24 if m == "low" else 2, 6, 4) for m, k in images], BOX)
    got = by_media(P.jersey(pixel_rows(spark, images), boxes, "media", "frame"))
    assert got["steady"].score == 0 and got["steady"].frames == 4
    assert got["changing"].score == 1
    assert got["single"].score is None and got["single"].frames == 1 and got["low"].score is None and got["low"].frames == 0


def test_scene_change_shows_outside_the_box(spark):
    stable, cut, covered = frames_of([(40, 90, 160)] * 3), frames_of([(40, 90, 160), (40, 90, 160), (200, 120, 30)]), frames_of([(40, 90, 160)] * 2)
    for k, a in enumerate(stable):
        a[2:10, 2:10] = (k * 90, 255 - k * 90, 7)
    images = {(m, k): a for m, clip in (("stable", stable), ("cut", cut), ("covered", covered), ("single", cut[:1])) for k, a in enumerate(clip)}
    boxes = spark.createDataFrame([("stable", k, 2, 2, 8, 8) for k in range(3)] + [("covered", 1, 0, 0, 24, 24)], BOX)
    got = by_media(P.scene(pixel_rows(spark, images), boxes, "media", "frame"))
    assert got["stable"].score == pytest.approx(0, abs=1e-6) and got["stable"].pairs == 2
    assert got["cut"].score == 1 and got["cut"].mean_distance == pytest.approx(0.5)
    assert got["covered"].score == 1 and got["single"].score is None and got["single"].pairs == 0


def area_mean(a, height, width):
    out = np.zeros((height, width, 3))
    for i in range(height):
        for j in range(width):
            sy, sx = a.shape[0] / height, a.shape[1] / width
            wy = np.clip(np.minimum(np.arange(a.shape[0]) + 1, (i + 1) * sy) - np.maximum(np.arange(a.shape[0]), i * sy), 0, None)
            wx = np.clip(np.minimum(np.arange(a.shape[1]) + 1, (j + 1) * sx) - np.maximum(np.arange(a.shape[1]), j * sx), 0, None)
            w = wy[:, None] * wx[None]
            out[i, j] = np.floor((a * w[..., None]).sum((0, 1)) / w.sum() + 0.5 + 1e-6)
    return luma(out.astype(np.int64))


def test_a_patch_that_occurs_twice(spark):
    rng = np.random.default_rng(5)
    plain = rng.integers(0, 256, (130, 120))
    twice = plain.copy()
    twice[0:24, 72:96] = twice[0:24, 0:24]
    near = plain.copy()
    near[0:24, 24:48] = near[0:24, 0:24]  # a neighbour is no other place
    got = by_media(P.crowd(stills(spark, {"plain": plain, "twice": twice, "near": near, "tiny": plain[:40, :40]}), "media"))
    assert got["twice"].score == pytest.approx(1, abs=1e-6) and got["plain"].score == 0 and got["near"].score == 0
    assert got["tiny"].score is None and got["tiny"].tiles == 0 and got["plain"].tiles == 8


@pytest.mark.parametrize(("height", "width", "widest"), [(25, 37, 16), (30, 32, 16), (10, 12, 16), (3, 40, 16)])
def test_the_upper_region_is_averaged_by_area(spark, height, width, widest):
    a = np.random.default_rng(height).integers(0, 256, (height, width, 3))
    got = P.upper_region(stills(spark, {"m": a}), "media", 0.4, widest).collect()
    cut = int(height * 0.4)
    size = (cut, width) if width <= widest else (max(1, int(cut * (widest / width))), widest)
    want = area_mean(a[:cut], *size)
    assert {(r.y, r.x): r.v for r in got} == {(y, x): want[y, x] for y in range(size[0]) for x in range(size[1])}
    assert {(r.height, r.width) for r in got} == {size}


def test_no_pixels(spark):
    none, boxes = pixel_rows(spark, {("m", 0): np.zeros((2, 2))}).limit(0), spark.createDataFrame([], BOX)
    assert P.frequency(none, "media").count() == 0
    assert P.lighting(none, boxes.drop("frame"), "media").count() == 0
    assert P.jersey(none, boxes, "media", "frame").count() == 0
    assert P.scene(none, boxes, "media", "frame").count() == 0
    assert P.crowd(none, "media").count() == 0
    assert P.compression(none, none, "media").count() == 0
