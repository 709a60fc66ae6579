"""Signals from pixels: embeddings stand for images, each label's vectors as the rows of one image or each vector as a frame of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pixels as P
from ..sources import tables as S
from .manifests import r6
from .registry import query


def _channels(at) -> dict:
    """8-bit channels from the components of a vector that begin at place at, 7 at + 3 and 13 at + 5."""
    level = lambda i: (F.floor(F.abs(F.element_at("embedding", (i + 1).cast("int")).cast("double")) * 1500) % 256).alias
    return [level(at)("r"), level((at * 7 + 3) % 64)("g"), level((at * 13 + 5) % 64)("b")]


def images(spark, sf: str) -> DataFrame:
    """media (label), y (rank of a vector), x (0-63), r, g, b."""
    e = S.table(spark, sf, "embeddings").withColumn("y", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    e = e.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return e.select(F.col("label").alias("media"), "y", "x", *_channels(F.col("x")))


def frames(spark, sf: str) -> DataFrame:
    """media (label), frame (vec_id), y, x (0-7), r, g, b."""
    e = S.table(spark, sf, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return e.select(F.col("label").alias("media"), F.col("vec_id").alias("frame"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), *_channels(F.col("i")))


def image_boxes(spark, sf: str) -> DataFrame:
    """A box for two of three images."""
    labels = S.table(spark, sf, "embeddings").where("label % 3 <> 0").select(F.col("label").cast("long").alias("x")).distinct()
    return labels.select(F.col("x").cast("int").alias("media"), (F.col("x") + 5).alias("x"), F.lit(2).cast("long").alias("y"), F.lit(20).cast("long").alias("w"), (F.col("x") + 12).alias("h"))


def frame_boxes(spark, sf: str) -> DataFrame:
    """A box for most frames; that of one in ten covers its frame."""
    k = F.col("vec_id")
    box = lambda whole, part, name: F.when(k % 10 == 1, whole).otherwise(part).cast("long").alias(name)
    e = S.table(spark, sf, "embeddings").where("vec_id % 4 <> 0")
    return e.select(F.col("label").alias("media"), k.alias("frame"), box(0, k % 3, "x"), box(0, k % 2, "y"), box(8, F.lit(3), "w"), box(8, 2 + k % 2, "h"))


def coarser(df: DataFrame) -> DataFrame:
    """The recompressed copy: channels rounded down to steps of 8, 16 and 4."""
    return df.select(*[(F.col(c) - F.col(c) % s).alias(c) if (s := {"r": 8, "g": 16, "b": 4}.get(c)) else c for c in df.columns])


_LEVELS = ", ".join(f"CAST(floor(abs(CAST(embedding[({at}) % 64 + 1] AS DOUBLE)) * 1500) AS BIGINT) % 256 AS {c}" for c, at in (("r", "i"), ("g", "i * 7 + 3"), ("b", "i * 13 + 5")))
_IMAGES = f"(SELECT label AS media, y, i AS x, {_LEVELS} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings), range(0, 64) q(i))"
_FRAMES = f"(SELECT label AS media, vec_id AS frame, i // 8 AS y, i % 8 AS x, {_LEVELS} FROM embeddings, range(0, 64) q(i))"
_IMAGE_BOXES = "(SELECT DISTINCT label AS media, label + 5 AS x, 2 AS y, 20 AS w, label + 12 AS h FROM embeddings WHERE label % 3 <> 0)"
_FRAME_BOXES = "(SELECT label AS media, vec_id AS frame, CASE WHEN c THEN 0 ELSE vec_id % 3 END AS x, CASE WHEN c THEN 0 ELSE vec_id % 2 END AS y, CASE WHEN c THEN 8 ELSE 3 END AS w, CASE WHEN c THEN 8 ELSE 2 + vec_id % 2 END AS h FROM (SELECT *, vec_id % 10 = 1 AS c FROM embeddings WHERE vec_id % 4 <> 0))"
_LUMA = "((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14)"
_IN = "p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h"
_ERRORS = f"(SELECT media, y, x, (r % 8 + g % 16 + b % 4) / 3::DOUBLE AS error, max(y) OVER (PARTITION BY media) + 1 AS height, 64 AS width FROM {_IMAGES})"
_HSV = """(SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS hue FROM (SELECT *,
    CASE WHEN span = 0 THEN 0 ELSE (CASE WHEN val = r THEN g - b WHEN val = g THEN b - r + 2 * span ELSE r - g + 4 * span END * CAST(floor(122880.0::DOUBLE / span + 0.5) AS BIGINT) + 2048) // 4096
      - CASE WHEN (CASE WHEN val = r THEN g - b WHEN val = g THEN b - r + 2 * span ELSE r - g + 4 * span END * CAST(floor(122880.0::DOUBLE / span + 0.5) AS BIGINT) + 2048) % 4096 < 0 THEN 1 ELSE 0 END END AS h0,
    CASE WHEN val = 0 THEN 0 ELSE (span * CAST(floor(1044480.0::DOUBLE / val + 0.5) AS BIGINT) + 2048) >> 12 END AS sat
  FROM (SELECT *, greatest(r, g, b) AS val, greatest(r, g, b) - least(r, g, b) AS span FROM {0})))"""


@query("g1_spectrum", f"""WITH v AS (SELECT frame, y, x, {_LUMA} AS v FROM {_FRAMES}),
  c AS (SELECT frame, (u + 4) % 8 AS y, (w + 4) % 8 AS x, ln(1 + sqrt(pow(sum(v * cos(2 * pi() * (u * y + w * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (u * y + w * x) / 8)), 2))) AS m FROM v, range(0, 8) a(u), range(0, 8) b(w) GROUP BY frame, u, w),
  g AS (SELECT *, sqrt(pow(y - 4, 2) + pow(x - 4, 2)) AS radius FROM c),
  p AS (SELECT frame, bin, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT frame, CAST(b AS INTEGER) AS bin FROM v, range(0, 8) q(b)) LEFT JOIN (SELECT frame, CAST(least(floor(radius / (sqrt(32) / 8)), 7) AS INTEGER) AS bin, avg(m) AS mean FROM g GROUP BY 1, 2) USING (frame, bin)),
  d AS (SELECT frame, stddev_pop(d2) AS sd FROM (SELECT frame, lead(mean) OVER w - 2 * mean + lag(mean) OVER w AS d2 FROM p WINDOW w AS (PARTITION BY frame ORDER BY bin)) GROUP BY frame),
  l AS (SELECT frame, avg(abs(mean)) AS lev, sum(mean) FILTER (bin >= 4) / sum(mean) AS h FROM p GROUP BY frame)
  SELECT frame, round((sd / (lev + 1e-8)) / (sd / (lev + 1e-8) + 1), 6) AS score, round(h, 6) AS high_freq_ratio FROM d JOIN l USING (frame)""")
def _(spark, sf):
    return P.frequency(frames(spark, sf), "frame", 8).select("frame", r6("score").alias("score"), r6("high_freq_ratio").alias("high_freq_ratio"))


@query("g2_error_blocks", f"""SELECT media, count(*) AS blocks, round((stddev_pop(m) / (avg(m) + 1e-6)) / (stddev_pop(m) / (avg(m) + 1e-6) + 1), 6) AS score FROM (
  SELECT media, y // 16 AS v, x // 16 AS h, avg(error) AS m FROM {_ERRORS} WHERE y < height // 16 * 16 GROUP BY 1, 2, 3) GROUP BY media""")
def _(spark, sf):
    p = images(spark, sf)
    return P.compression(p, coarser(p), "media").withColumn("score", r6("score"))


_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_LIGHT = " + ".join(f"{w} * {_LINEAR.format(c)}" for c, w in P.LUMINANCE.items())
_SHARE = lambda c, s: f"{c}_{s} / (1e-6 + r_{s} + g_{s} + b_{s})"


@query("g3_pixel_lighting", f"""WITH p AS (SELECT p.*, {_LUMA.replace('(r', '(p.r').replace('+ g', '+ p.g').replace('+ b', '+ p.b')} AS luma, max(p.y) OVER (PARTITION BY p.media) + 1 AS height, EXISTS (SELECT 1 FROM {_IMAGE_BOXES} b WHERE b.media = p.media AND {_IN}) AS inside FROM {_IMAGES} p),
  q AS (SELECT *, floor(CASE WHEN light > 0.008856 THEN 116 * cbrt(light) - 16 ELSE 903.3 * light END * 2.55 + 0.5) AS l FROM (SELECT *, {_LIGHT} AS light FROM p)),
  g AS (SELECT media, {', '.join(f"coalesce(avg({c}) FILTER ({w}), 0) AS {c}_{s}" for c in 'lrgb' for s, w in (('in', 'inside'), ('out', 'NOT inside')))}, {', '.join(f"avg(luma) FILTER (y {a} height // 2 AND x {b} 32) AS q{k}" for k, (a, b) in enumerate([('<', '<'), ('<', '>='), ('>=', '<'), ('>=', '>=')]))} FROM q GROUP BY media)
  SELECT g.media, CASE WHEN b.media IS NOT NULL THEN 'face_vs_background' ELSE 'quadrant_fallback' END AS mode,
    round(least(1, greatest(0, CASE WHEN b.media IS NOT NULL THEN 0.5 * abs(l_in - l_out) / 40 + 0.5 * ({' + '.join(f'abs({_SHARE(c, "in")} - {_SHARE(c, "out")})' for c in 'rgb')}) / 0.3 ELSE (greatest(q0, q1, q2, q3) - least(q0, q1, q2, q3)) / 60 END)), 6) AS score
  FROM g LEFT JOIN {_IMAGE_BOXES} b USING (media)""")
def _(spark, sf):
    return P.lighting(images(spark, sf), image_boxes(spark, sf), "media").withColumn("score", r6("score"))


@query("g7_torso", f"""WITH t AS (SELECT media, frame, greatest(0, x - CAST(floor(0.3::DOUBLE * w) AS BIGINT)) AS x0, least(8, x + w + CAST(floor(0.3::DOUBLE * w) AS BIGINT)) AS x1, y + h AS y0, least(8, y + h + CAST(floor(1.5::DOUBLE * h) AS BIGINT)) AS y1 FROM {_FRAME_BOXES}),
  m AS (SELECT p.media, p.frame, avg(hue) AS h, avg(sat) AS s, avg(val) AS v FROM {_HSV.format(_FRAMES)} p JOIN t ON t.media = p.media AND t.frame = p.frame AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2)
  SELECT l.media, coalesce(n, 0) AS frames, CASE WHEN n >= 2 THEN round(s, 6) END AS score FROM (SELECT DISTINCT label AS media FROM embeddings) l LEFT JOIN (SELECT media, count(*) AS n, least(1, (stddev_pop(h) + 0.3 * stddev_pop(s) + 0.2 * stddev_pop(v)) / 40) AS s FROM m GROUP BY media) USING (media)""")
def _(spark, sf):
    return P.jersey(frames(spark, sf), frame_boxes(spark, sf), "media", "frame").withColumn("score", r6("score"))


@query("g8_background", f"""WITH o AS (SELECT p.* FROM {_HSV.format(_FRAMES)} p WHERE NOT EXISTS (SELECT 1 FROM {_FRAME_BOXES} b WHERE b.media = p.media AND b.frame = p.frame AND {_IN})),
  c AS (SELECT media, frame, (hue * 30 // 180) * 32 + sat * 32 // 256 AS bin, count(*)::DOUBLE AS v FROM o GROUP BY 1, 2, 3),
  t AS (SELECT *, sum(v) OVER (PARTITION BY media, frame) AS total FROM c),
  f AS (SELECT media, frame, lead(frame) OVER (PARTITION BY media ORDER BY frame) AS after FROM (SELECT DISTINCT label AS media, vec_id AS frame FROM embeddings)),
  s AS (SELECT a.media, a.frame, sum(sqrt(a.v * b.v / (a.total * b.total))) AS bc FROM f JOIN t a USING (media, frame) JOIN t b ON b.media = f.media AND b.frame = f.after AND a.bin = b.bin GROUP BY 1, 2),
  d AS (SELECT media, sqrt(greatest(0, 1 - coalesce(bc, 0))) AS d FROM f LEFT JOIN s USING (media, frame) WHERE after IS NOT NULL)
  SELECT media, count(*) AS pairs, round(avg(d), 5) AS mean_distance, round(least(1, max(d) / 0.5), 5) AS score FROM d GROUP BY media""")
def _(spark, sf):
    return P.scene(frames(spark, sf), frame_boxes(spark, sf), "media", "frame").select("media", "pairs", F.round("mean_distance", 5).alias("mean_distance"), F.round("score", 5).alias("score"))


@query("g9_border", f"""SELECT media, round(least(1, abs(i - o) / (o + 1e-6) / 2), 6) AS score FROM (SELECT media, coalesce(avg(error) FILTER (NOT c), 0) AS i, coalesce(avg(error) FILTER (c), 0) AS o FROM (
  SELECT *, y >= floor(height * 0.15::DOUBLE) AND y < height - floor(height * 0.15::DOUBLE) AND x >= 9 AND x < 55 AS c FROM {_ERRORS}) GROUP BY media)""")
def _(spark, sf):
    p = images(spark, sf)
    return P.overlay(p, coarser(p), "media").withColumn("score", r6("score"))


@query("g10_pixel_tiles", f"""WITH p AS (SELECT *, CAST(floor((max(y) OVER (PARTITION BY media) + 1) * 0.4::DOUBLE) AS BIGINT) AS cut FROM {_IMAGES}),
  u AS (SELECT *, greatest(1, CAST(floor(cut * (48 / 64::DOUBLE)) AS BIGINT)) AS height, cut / greatest(1, floor(cut * (48 / 64::DOUBLE)))::DOUBLE AS sy, 64 / 48::DOUBLE AS sx FROM p WHERE y < cut),
  a AS (SELECT u.media, height, ty, tx, r, g, b, (least(y + 1, (ty + 1) * sy) - greatest(y, ty * sy)) * (least(x + 1, (tx + 1) * sx) - greatest(x, tx * sx)) AS w
        FROM u JOIN range(0, 48) h(tx) ON least(x + 1, (tx + 1) * sx) - greatest(x, tx * sx) > 1e-9 JOIN range(0, 1000) v(ty) ON ty < height AND least(y + 1, (ty + 1) * sy) - greatest(y, ty * sy) > 1e-9),
  m AS (SELECT media, height, ty AS y, tx AS x, {', '.join(f"CAST(floor(sum({c} * w) / sum(w) + 0.5 + 1e-6) AS BIGINT) AS {c}" for c in 'rgb')} FROM a GROUP BY 1, 2, 3, 4),
  t AS (SELECT media, y // 8 AS i, x // 8 AS j, list({_LUMA}::DOUBLE ORDER BY y, x) AS v FROM m WHERE y // 8 * 8 < height - 8 AND x // 8 * 8 < 40 GROUP BY 1, 2, 3),
  c AS (SELECT media, i, j, list_transform(v, lambda z: z - list_avg(v)) AS c FROM t),
  n AS (SELECT media, i, j, list_transform(c, lambda z: z / CASE WHEN list_dot_product(c, c) > 0 THEN sqrt(list_dot_product(c, c)) ELSE 1e-6 END) AS n FROM c),
  s AS (SELECT a.media, max(list_dot_product(a.n, b.n)) AS best FROM n a JOIN n b ON a.media = b.media AND (a.i, a.j) < (b.i, b.j) AND (abs(a.i - b.i) >= 2 OR abs(a.j - b.j) >= 2) GROUP BY 1),
  k AS (SELECT media, count(*) AS tiles FROM t GROUP BY 1)
  SELECT l.media, coalesce(tiles, 0) AS tiles, CASE WHEN tiles >= 4 THEN round(least(1, greatest(0, (greatest(0, coalesce(best, 0)) - 0.9) / 0.1)), 6) END AS score, CASE WHEN tiles >= 4 THEN round(greatest(0, coalesce(best, 0)), 6) END AS similarity
  FROM (SELECT DISTINCT label AS media FROM embeddings) l LEFT JOIN k USING (media) LEFT JOIN s USING (media)""")
def _(spark, sf):
    s = P.crowd(images(spark, sf), "media", tile=8, apart=16, widest=48)
    return s.select("media", "tiles", r6("score").alias("score"), r6("similarity").alias("similarity"))
