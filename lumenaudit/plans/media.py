"""Signals, provenance, fusion, explanation and history over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import content as N
from ..operators import explain as X
from ..operators import fusion as U
from ..operators import history as H
from ..operators import provenance as P
from ..operators import signals as G
from ..sources import tables as S
from ..streaming import admission, lifecycle
from .manifests import _FRAMES_SQL, _GRID_SQL, _WEEKS_SQL, TYPES, frames, grid, r6, weekly
from .registry import query

t = S.table
#: Which signal each event type stands for in the tests.
AS_SIGNAL = {"click": "frequency_analysis", "error": "trained_probe", "purchase": "deep_learning", "signup": "lighting_analysis", "view": "compression_analysis"}
WEIGHT = {"frequency_analysis": 0.025, "trained_probe": 0.6, "deep_learning": 0.15, "lighting_analysis": 0.025, "compression_analysis": 0.025}
POS = {"deep_learning": 0, "trained_probe": 1, "frequency_analysis": 2, "compression_analysis": 3, "lighting_analysis": 4}
#: A combiner over the five signals of the tests.
FIVE = {"features": tuple(sorted(WEIGHT)), "weights": (0.4, -0.3, 0.2, -0.5, 1.5), "intercept": -0.6, "threshold": 0.4454}


def long_signals(spark, sf: str) -> DataFrame:
    """media (user and week), signal, score; a type that a week lacks is a signal that does not apply."""
    wide = weekly(spark, sf).groupBy("media").pivot("event_type", TYPES).agg(F.avg("s"))
    return wide.unpivot(["media"], TYPES, "event_type", "score").select("media", C.harmonise_label(F.col("event_type"), AS_SIGNAL).alias("signal"), "score")


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AS_SIGNAL.items()) + " END"
_LONG = f"(SELECT media, {_CASE} AS signal, score FROM (SELECT DISTINCT media FROM {_WEEKS_SQL}) CROSS JOIN (VALUES {', '.join(f'({x!r})' for x in TYPES)}) e(event_type) LEFT JOIN (SELECT media, event_type, avg(s) AS score FROM {_WEEKS_SQL} GROUP BY 1, 2) USING (media, event_type))"
_W = "(VALUES " + ", ".join(f"('{s}', {w}, {POS[s]})" for s, w in WEIGHT.items()) + ") w(signal, weight, pos)"
_FUSED = f"(SELECT media, sum(score * weight) / sum(weight) AS fused, sum(weight) AS weight_sum FROM {_LONG} JOIN {_W} USING (signal) WHERE score IS NOT NULL GROUP BY media)"
_LOGIT = f"(SELECT media, -0.6 + sum(score * CASE signal {' '.join(f'WHEN {s!r} THEN {w}' for s, w in zip(FIVE['features'], FIVE['weights'], strict=True))} END) AS logit FROM {_LONG} WHERE score IS NOT NULL GROUP BY media HAVING count(*) = 5)"
_VERDICTS = f"""(SELECT *, CASE WHEN verdict = 'suspicious' THEN 100 * score ELSE 100 * (1 - score) END AS confidence, CASE WHEN score < .3 THEN 'low' WHEN score < .6 THEN 'medium' ELSE 'high' END AS risk, 'completed' AS status FROM (
  SELECT media, coalesce(1 / (1 + exp(-logit)), fused) AS score, CASE WHEN logit IS NOT NULL THEN 'learned' ELSE 'weighted' END AS method,
    CASE WHEN coalesce(1 / (1 + exp(-logit)), fused) >= CASE WHEN logit IS NOT NULL THEN 0.4454 ELSE 0.5 END THEN 'suspicious' ELSE 'authentic' END AS verdict FROM {_FUSED} LEFT JOIN {_LOGIT} USING (media)))"""


@query("f1_pool_weights", f"SELECT media, signal, round(coalesce(weight, 0), 6) AS weight FROM {_LONG} LEFT JOIN (VALUES " + ", ".join(f"('{s}', {w}::DOUBLE / {len(m)})" for w, m in U.POOLS.values() for s in m) + ") p(signal, weight) USING (signal)")
def _(spark, sf):
    return U.nominal_weights(long_signals(spark, sf), U.pool_weights(spark)).select("media", "signal", r6("weight").alias("weight"))


@query("f2_weighted_mean", f"SELECT media, round(fused, 6) AS fused, round(weight_sum, 6) AS weight_sum FROM {_FUSED}")
def _(spark, sf):
    return U.weighted_mean(long_signals(spark, sf), U.pool_weights(spark)).select("media", r6("fused").alias("fused"), r6("weight_sum").alias("weight_sum"))


@query("f3_learned_fusion", f"SELECT media, round(logit, 6) AS logit, 0.0 AS shift, round(1 / (1 + exp(-logit)), 6) AS p FROM {_LOGIT}")
def _(spark, sf):
    return U.learned_fusion(long_signals(spark, sf), FIVE).select("media", r6("logit").alias("logit"), "shift", r6("p").alias("p"))


_SHIFTED = "(SELECT media, sum(CASE WHEN score >= .65 THEN m WHEN score <= .35 THEN -m ELSE 0 END) AS shift FROM {} LEFT JOIN (VALUES ('trained_probe', 2.2), ('deep_learning', 0.5)) s(signal, m) USING (signal) WHERE score IS NOT NULL GROUP BY media)".format(_LONG)


def _with_provenance(signals: DataFrame) -> DataFrame:
    """Two of the signals stand for decisive provenance as well."""
    names = {"trained_probe": "provenance_ai_metadata", "deep_learning": "provenance_camera_metadata"}
    return signals.unionAll(signals.where(F.col("signal").isin(*names)).withColumn("signal", C.harmonise_label(F.col("signal"), names)))


@query("f3_contributions", f"SELECT media, signal, round(score * CASE signal {' '.join(f'WHEN {s!r} THEN {w}' for s, w in zip(FIVE['features'], FIVE['weights'], strict=True))} END, 6) AS contribution, round(logit, 6) AS logit, round(logit + shift, 6) AS shifted_logit FROM {_LONG} JOIN {_LOGIT} USING (media) JOIN {_SHIFTED} USING (media)")
def _(spark, sf):
    x = U.learned_fusion(_with_provenance(long_signals(spark, sf)), FIVE)
    x = x.select("media", F.explode("contributions").alias("signal", "contribution"), r6("logit").alias("logit"), r6(F.col("logit") + F.col("shift")).alias("shifted_logit"))
    return x.withColumn("contribution", r6("contribution"))


@query("f4_evidence_shift", f"SELECT media, round(sum(CASE WHEN score >= .65 THEN m WHEN score <= .35 THEN -m ELSE 0 END), 6) AS shift FROM {_LONG} LEFT JOIN (VALUES ('trained_probe', 2.2), ('deep_learning', 0.5)) s(signal, m) USING (signal) WHERE score IS NOT NULL GROUP BY media HAVING count(*) = 5")
def _(spark, sf):
    return U.learned_fusion(_with_provenance(long_signals(spark, sf)), FIVE).select("media", r6("shift").alias("shift"))


@query("f5_verdicts", f"SELECT media, round(score, 6) AS score, method, verdict, round(confidence, 4) AS confidence, risk, status FROM {_VERDICTS}")
def _(spark, sf):
    v = U.fuse(long_signals(spark, sf), U.pool_weights(spark), FIVE)
    return v.select("media", r6("score").alias("score"), "method", "verdict", F.round("confidence", 4).alias("confidence"), "risk", "status")


@query("f6_stamp_versions", f"SELECT media, CASE WHEN probe THEN 'probe/vit' END AS model_version, '1.0' AS pipeline_version FROM (SELECT media, bool_or(signal = 'trained_probe' AND score IS NOT NULL) AS probe FROM {_LONG} GROUP BY media)")
def _(spark, sf):
    s = long_signals(spark, sf)
    return U.stamp_versions(s.select("media").distinct(), s, "vit", "1.0")


def _explained(spark, sf):
    s, w = long_signals(spark, sf), U.pool_weights(spark)
    return X.explain(U.fuse(s, w, FIVE), s, w)


_TEMPLATES = "(VALUES " + ", ".join("('{}', '{}', '{}')".format(s, b, text.replace("'", "''")) for s, p in X.REASONS.items() for b, text in zip(("high", "low"), p, strict=True)) + ") q(signal, band, template)"
_NOTES = "(VALUES " + ", ".join("('{}', '{}')".format(s, n.replace("'", "''")) for s, n in X.NOTES.items()) + ") q(signal, note)"
_REASONS_SQL = f"""(SELECT media, string_agg(replace(replace(template, '{{fake}}', CAST(round(score * 100, 0) AS INTEGER)::VARCHAR), '{{real}}', CAST(round((1 - score) * 100, 0) AS INTEGER)::VARCHAR), chr(10) ORDER BY -round(abs(score - 0.5) * weight / total, 9), pos) AS reasons FROM (
  SELECT media, signal, score, weight, pos, sum(weight) OVER (PARTITION BY media) AS total, CASE WHEN score >= .65 THEN 'high' WHEN score <= .35 THEN 'low' ELSE 'medium' END AS band FROM {_LONG} JOIN {_W} USING (signal) WHERE score IS NOT NULL) JOIN {_TEMPLATES} USING (signal, band) GROUP BY media)"""
_NOTES_SQL = f"(SELECT media, string_agg(note, chr(10) ORDER BY signal) AS notes FROM {_LONG} JOIN {_NOTES} USING (signal) WHERE score IS NULL GROUP BY media)"


@query("w7_ranked_reasons", f"SELECT media, reasons FROM {_REASONS_SQL}")
def _(spark, sf):
    return X.rank_reasons(long_signals(spark, sf), U.pool_weights(spark)).select("media", F.array_join("reasons", "\n").alias("reasons"))


_HEADLINE = "CASE WHEN verdict = 'suspicious' AND risk = 'high' THEN 'Verdict: LIKELY AI GENERATED / MANIPULATED' WHEN verdict = 'suspicious' THEN 'Verdict: SUSPICIOUS — possible manipulation detected' WHEN risk = 'low' THEN 'Verdict: AUTHENTIC — no significant signs of manipulation detected' ELSE 'Verdict: LIKELY AUTHENTIC — minor inconsistencies detected, likely not manipulation' END"
_EXPLAINED = f"(SELECT media, verdict, risk, score, {_HEADLINE} AS headline, coalesce(reasons, '{X.NOTHING}') AS reasons, notes FROM {_VERDICTS} LEFT JOIN {_REASONS_SQL} USING (media) LEFT JOIN {_NOTES_SQL} USING (media))"


@query("x1_reasons", f"SELECT media, reasons FROM {_EXPLAINED}")
def _(spark, sf):
    return _explained(spark, sf).select("media", F.array_join("reasons", "\n").alias("reasons"))


@query("x2_notes", f"SELECT media, notes FROM {_NOTES_SQL}")
def _(spark, sf):
    return X.notes(long_signals(spark, sf)).select("media", F.array_join("notes", "\n").alias("notes"))


@query("x3_rendered", f"SELECT media, headline || chr(10) || chr(10) || 'Reasons:' || chr(10) || '- ' || replace(reasons, chr(10), chr(10) || '- ') || coalesce(chr(10) || chr(10) || 'Notes:' || chr(10) || '- ' || replace(notes, chr(10), chr(10) || '- '), '') AS rendered FROM {_EXPLAINED}")
def _(spark, sf):
    return _explained(spark, sf).select("media", "rendered")


_SUMMARY_SQL = f"""SELECT media, 'Verdict: ' || upper(verdict) || ' (fused suspicion score ' || printf('%.2f', round_even(v.score, 2)) || ' on a 0-1 scale).' || chr(10) || 'Contributing signals:' || chr(10) || lines || coalesce(chr(10) || 'Signals not available for this analysis:' || chr(10) || missing, '') AS summary FROM {_VERDICTS} v JOIN (
  SELECT media, string_agg('  - ' || signal || ': score=' || printf('%.2f', round_even(score, 2)) || ', weight=' || CAST(round_even(weight / total * 100, 0) AS INTEGER) || '%', chr(10) ORDER BY -round(weight / total, 9), pos) AS lines FROM (
    SELECT *, sum(weight) OVER (PARTITION BY media) AS total FROM {_LONG} JOIN {_W} USING (signal) WHERE score IS NOT NULL) GROUP BY media) USING (media)
  LEFT JOIN (SELECT media, string_agg('  - ' || signal || ': ' || note, chr(10) ORDER BY signal) AS missing FROM {_LONG} JOIN {_NOTES} USING (signal) WHERE score IS NULL GROUP BY media) USING (media)"""


@query("x3_summary", _SUMMARY_SQL)
def _(spark, sf):
    s, w = long_signals(spark, sf), U.pool_weights(spark)
    return X.technical_summary(U.fuse(s, w, FIVE), s, w)


_SHARES_SQL = f"(SELECT media, count(*) AS signals, round(sum(round(score, 4)), 4) AS score_sum, round(sum(round(weight / total, 4)), 3) AS weight_sum FROM (SELECT *, sum(weight) OVER (PARTITION BY media) AS total FROM {_LONG} JOIN {_W} USING (signal) WHERE score IS NOT NULL) GROUP BY media)"


@query("x4_report_json", f"SELECT e.media, e.verdict, e.risk, len(string_split(reasons, chr(10))) AS findings, CASE WHEN notes IS NULL THEN 0 ELSE len(string_split(notes, chr(10))) END AS unavailable, round(v.confidence, 4) AS confidence, v.method, s.signals, s.score_sum, s.weight_sum, {len(X.LIMITATIONS)} AS limitations, '{X.PERFORMANCE['accuracy']}' AS accuracy FROM {_EXPLAINED} e JOIN {_VERDICTS} v USING (media) JOIN {_SHARES_SQL} s USING (media)")
def _(spark, sf):
    s, w = long_signals(spark, sf), U.pool_weights(spark)
    r = X.report_json(X.explain(U.fuse(s, w, FIVE), s, w), s, w)
    shape = "struct<verdict:string,risk_level:string,confidence_score:double,findings:array<string>,unavailable_signals:array<string>,signals:map<string,struct<score:double,weight:double>>,provenance:struct<fusion_method:string>,limitations:array<string>,system_performance:struct<accuracy:string>>"
    p = F.from_json("report", shape)
    total = lambda c: F.round(F.aggregate(F.map_values(p["signals"]), F.lit(0.0), lambda acc, x: acc + x[c]), 4)
    return r.select(
        "media", p["verdict"].alias("verdict"), p["risk_level"].alias("risk"), F.size(p["findings"]).alias("findings"), F.size(p["unavailable_signals"]).alias("unavailable"), F.round(p["confidence_score"], 4).alias("confidence"),
        p["provenance"]["fusion_method"].alias("method"), F.size(p["signals"]).alias("signals"), total("score").alias("score_sum"), F.round(total("weight"), 3).alias("weight_sum"), F.size(p["limitations"]).alias("limitations"), p["system_performance"]["accuracy"].alias("accuracy"),
    )


@query("x5_exportable", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return X.exportable(t(spark, sf, "orders"), "o_orderstatus", "F").select("o_orderkey")


@query("flagship_verdicts", f"SELECT media, round(score, 6) AS score, verdict, risk, headline, reasons FROM {_EXPLAINED}")
def _(spark, sf):
    return _explained(spark, sf).select("media", r6("score").alias("score"), "verdict", "risk", "headline", F.array_join("reasons", "\n").alias("reasons"))


@query("w1_frame_deltas", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events WHERE event_type <> 'error'")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").where("event_type <> 'error'").select("event_id", r6(F.col("value") - F.lag("value").over(w)).alias("delta"))


@query("w2_second_difference", "SELECT user_id, frame_idx, round(lead(value) OVER w - 2 * value + lag(value) OVER w, 6) AS d2 FROM " + _FRAMES_SQL + " WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx) QUALIFY d2 IS NOT NULL")
def _(spark, sf):
    return G.second_difference(frames(spark, sf), "user_id", "frame_idx", "value").select("user_id", "frame_idx", r6("d2").alias("d2"))


@query("g1_frequency", f"""WITH p AS (SELECT vec_id, bin, coalesce(mean, 0) AS mean FROM (SELECT DISTINCT vec_id, CAST(b AS INTEGER) AS bin FROM embeddings, range(0, 20) q(b)) LEFT JOIN (SELECT vec_id, CAST(least(floor(radius / (top / 20)), 19) AS INTEGER) AS bin, avg(v) AS mean FROM (SELECT *, max(radius) OVER (PARTITION BY vec_id) AS top FROM {_GRID_SQL}) GROUP BY 1, 2) USING (vec_id, bin)),
  d AS (SELECT vec_id, stddev_pop(d2) AS sd FROM (SELECT vec_id, lead(mean) OVER w - 2 * mean + lag(mean) OVER w AS d2 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY bin)) GROUP BY vec_id),
  l AS (SELECT vec_id, avg(abs(mean)) AS lev, sum(mean) FILTER (bin >= 10) / sum(mean) AS h FROM p GROUP BY vec_id)
  SELECT vec_id, round((sd / (lev + 1e-8)) / (sd / (lev + 1e-8) + 1), 6) AS score, round(h, 6) AS high_freq_ratio FROM d JOIN l USING (vec_id)""")
def _(spark, sf):
    return G.frequency_signal(grid(spark, sf), "vec_id", "radius", "v", 20).select("vec_id", r6("score").alias("score"), r6("high_freq_ratio").alias("high_freq_ratio"))


@query("g2_compression", "SELECT l_suppkey, count(*) AS blocks, round((stddev_pop(m) / (avg(m) + 1e-6)) / (stddev_pop(m) / (avg(m) + 1e-6) + 1), 6) AS score FROM (SELECT l_suppkey, l_orderkey // 16 AS b, avg(abs(l_extendedprice - l_extendedprice * (1 - l_discount))) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    s = G.compression_signal(t(spark, sf, "lineitem"), ["l_suppkey"], [F.floor(F.col("l_orderkey") / 16)], F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return s.withColumn("score", r6("score"))


@query("g3_lighting", """WITH m AS (SELECT l_suppkey, 0.5 * abs(avg(l_quantity) FILTER (r) - avg(l_quantity) FILTER (NOT r)) / 40 + 0.5 * (
    abs(avg(l_discount) FILTER (r) / (avg(l_discount) FILTER (r) + avg(l_tax) FILTER (r)) - avg(l_discount) FILTER (NOT r) / (avg(l_discount) FILTER (NOT r) + avg(l_tax) FILTER (NOT r)))
    + abs(avg(l_tax) FILTER (r) / (avg(l_discount) FILTER (r) + avg(l_tax) FILTER (r)) - avg(l_tax) FILTER (NOT r) / (avg(l_discount) FILTER (NOT r) + avg(l_tax) FILTER (NOT r)))) / 0.3 AS masked
    FROM (SELECT *, l_returnflag = 'R' AS r FROM lineitem) GROUP BY 1),
  p AS (SELECT l_suppkey, (max(m) - min(m)) / 60 AS plain FROM (SELECT l_suppkey, l_orderkey % 4 AS q, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1)
  SELECT l_suppkey, round(least(1, greatest(0, coalesce(masked, plain))), 6) AS score FROM m JOIN p USING (l_suppkey)""")
def _(spark, sf):
    s = G.lighting_signal(t(spark, sf, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", "l_quantity", ["l_discount", "l_tax"], F.col("l_orderkey") % 4)
    return s.withColumn("score", r6("score"))


@query("g4_landmarks", """WITH p AS (SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS k, i AS point, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(0, 32) r(i)),
  s AS (SELECT label, k, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS scale FROM p GROUP BY 1, 2),
  m AS (SELECT a.label, a.k, avg(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) AS shift FROM p a JOIN p b ON a.label = b.label AND b.k = a.k + 1 AND a.point = b.point GROUP BY 1, 2)
  SELECT label, count(*) AS pairs, round(avg(shift / scale), 6) AS jitter, round(avg(shift / scale) / (avg(shift / scale) + 0.05), 6) AS score FROM m JOIN s USING (label, k) GROUP BY label""")
def _(spark, sf):
    e = t(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.element_at("embedding", 2 * i + 1).cast("double").alias("x"), F.element_at("embedding", 2 * i + 2).cast("double").alias("y")))).alias("point", "p"))
    s = G.landmark_signal(e.select("label", "vec_id", "point", "p.*"), "label", "vec_id", "point")
    return s.select("label", "pairs", r6("jitter").alias("jitter"), r6("score").alias("score"))


@query("g5_flow", f"""SELECT label, count(*) AS frames, round(least(1, avg(v)), 6) AS score FROM (SELECT label, vec_id, var_pop(lap) AS v FROM (SELECT label, vec_id,
    coalesce(lag(v) OVER wy, lead(v) OVER wy) + coalesce(lead(v) OVER wy, lag(v) OVER wy) + coalesce(lag(v) OVER wx, lead(v) OVER wx) + coalesce(lead(v) OVER wx, lag(v) OVER wx) - 4 * v AS lap
    FROM {_GRID_SQL} WINDOW wy AS (PARTITION BY label, vec_id, x ORDER BY y), wx AS (PARTITION BY label, vec_id, y ORDER BY x)) GROUP BY 1, 2) GROUP BY label""")
def _(spark, sf):
    return G.flow_signal(grid(spark, sf), "label", "vec_id", "v").withColumn("score", r6("score"))


@query("g6_temporal", f"SELECT user_id, count(*) AS frames, round(avg(score), 8) AS mean_fake, CASE WHEN count(*) >= 2 THEN round(least(1, stddev_pop(score) / 0.25), 6) END AS score, CASE WHEN avg(score) >= 0.5 THEN 'fake' ELSE 'real' END AS label FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM {_FRAMES_SQL}) f WHERE CASE WHEN 8 >= total THEN true ELSE list_contains(list_transform(range(0, 8), lambda i: CAST(floor(i * (total / 8.0::DOUBLE)) AS BIGINT)), frame_idx) END GROUP BY user_id")
def _(spark, sf):
    s = G.temporal_signal(N.sample_frames(frames(spark, sf), "user_id", "frame_idx", 8), "user_id", "score")
    return s.select("user_id", "frames", F.round("mean_fake", 8).alias("mean_fake"), r6("score").alias("score"), "label")


@query("g7_jersey", "SELECT l_suppkey, count(*) AS frames, round(least(1, (stddev_pop(l_quantity) + 0.3 * stddev_pop(l_discount) + 0.2 * stddev_pop(l_tax)) / 40), 6) AS score FROM lineitem GROUP BY 1")
def _(spark, sf):
    return G.jersey_signal(t(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_discount", "l_tax").withColumn("score", r6("score"))


@query("g8_scene", """WITH c AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY d) AS k, b, v, sum(v) OVER (PARTITION BY user_id, d) AS total FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_type AS b, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2, 3)),
  f AS (SELECT DISTINCT user_id, k FROM c), s AS (SELECT a.user_id, a.k, sum(sqrt(a.v * b.v / (a.total * b.total))) AS bc FROM c a JOIN c b ON a.user_id = b.user_id AND b.k = a.k + 1 AND a.b = b.b GROUP BY 1, 2),
  p AS (SELECT f.user_id, sqrt(greatest(0, 1 - coalesce(bc, 0))) AS d FROM f JOIN f g ON f.user_id = g.user_id AND g.k = f.k + 1 LEFT JOIN s ON s.user_id = f.user_id AND s.k = f.k)
  SELECT user_id, count(*) AS pairs, round(avg(d), 5) AS mean_distance, round(least(1, max(d) / 0.5), 5) AS score FROM p GROUP BY user_id""")
def _(spark, sf):
    c = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d"), "event_type").count()
    return G.scene_signal(c, "user_id", "d", "event_type", "count").select("user_id", "pairs", F.round("mean_distance", 5).alias("mean_distance"), F.round("score", 5).alias("score"))


@query("g9_overlay", "SELECT l_suppkey, round(least(1, abs(i - o) / (o + 1e-6) / 2), 6) AS score FROM (SELECT l_suppkey, coalesce(avg(l_extendedprice) FILTER (l_linenumber IN (1, 7)), 0) AS i, coalesce(avg(l_extendedprice) FILTER (l_linenumber NOT IN (1, 7)), 0) AS o FROM lineitem GROUP BY 1)")
def _(spark, sf):
    return G.overlay_signal(t(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_linenumber").isin(1, 7), "l_extendedprice").withColumn("score", r6("score"))


@query("g10_crowd", """WITH e AS (SELECT label, vec_id, list_transform(v, lambda x: x - list_avg(v)) AS c FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), u AS (SELECT label, vec_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM e),
  b AS (SELECT x.label, max(list_dot_product(x.u, y.u)) AS best FROM u x JOIN u y ON x.label = y.label AND y.vec_id - x.vec_id >= 40 GROUP BY 1)
  SELECT label, tiles, round(least(1, greatest(0, (greatest(0, best) - 0.9) / 0.1)), 6) AS score, round(greatest(0, best), 6) AS similarity FROM b JOIN (SELECT label, count(*) AS tiles FROM embeddings GROUP BY 1) USING (label)""")
def _(spark, sf):
    e = t(spark, sf, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    s = G.crowd_signal(e, "label", ["vec_id"], "v", 40)
    return s.select("label", "tiles", r6("score").alias("score"), r6("similarity").alias("similarity"))


@query("g11_probe", "SELECT vec_id, round(1 / (1 + exp(-(0.2 + list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - 0.01) / 0.5 * (i - 32) / 32.0))))), 6) AS score FROM embeddings")
def _(spark, sf):
    head = {"weights": [(i - 32) / 32.0 for i in range(1, 65)], "bias": 0.2, "mean": [0.01] * 64, "std": [0.5] * 64}
    return G.probe_signal(t(spark, sf, "embeddings"), "vec_id", "embedding", head).select("vec_id", r6("score").alias("score"))


@query("g12_run_signals", "SELECT media, signal, round(score, 6) AS score FROM (SELECT user_id::VARCHAR AS media, 'temporal' AS signal, CASE WHEN count(*) >= 2 THEN least(1, stddev_pop(value / 500) / 0.25) END AS score FROM events GROUP BY user_id UNION ALL SELECT user_id::VARCHAR, 'spread', least(1, (stddev_pop(value) + 0.3 * stddev_pop(value) + 0.2 * stddev_pop(value)) / 40) FROM events GROUP BY user_id)")
def _(spark, sf):
    f = frames(spark, sf)
    s = G.as_signals(("temporal", G.temporal_signal(f, "user_id", "score"), "user_id"), ("spread", G.jersey_signal(f, "user_id", "value", "value", "value"), "user_id"))
    return s.withColumn("score", r6("score"))


@query("g13_classifier", "SELECT user_id, round(avg(value / 500) FILTER (event_type = 'error' AND value > 400), 6) AS score FROM events GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events")
    probs = e.where("event_type = 'error' and value > 400").groupBy("user_id").agg(F.avg(F.col("value") / 500).alias("p"))
    return G.classifier_signal(e, probs, "user_id", "p").select("user_id", r6("score").alias("score"))


@query("u1_isolated_detector", "SELECT event_id, value < 250 AS applicable, CASE WHEN value < 250 THEN round(value / 250, 6) END AS score, CASE WHEN value >= 250 THEN 'ValueError' END AS error FROM events")
def _(spark, sf):
    def detect(v):
        if v >= 250:
            raise ValueError(v)
        return v / 250

    d = G.isolated(detect)(F.col("value"))
    return t(spark, sf, "events").select("event_id", d.alias("d")).select("event_id", "d.applicable", r6("d.score").alias("score"), "d.error")


@query("u3_expand_frames", "SELECT user_id, unnest(range(0, n)) AS frame_idx FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_idx"))


_SOFTWARE_SQL = """SELECT user_id, lower(string_agg(field, ' ' ORDER BY kind, pos, key, field)) AS fields FROM (
  SELECT user_id, 0 AS kind, 0 AS pos, key, value AS field FROM k WHERE key IN ('Software', 'Artist') UNION ALL
  SELECT user_id, 1, 0, key, key || ' ' || value FROM k WHERE key = 'Prompt' UNION ALL
  SELECT user_id, 2, 0, key, unnest(regexp_extract_all(value, 'xmp:creatortool="([^"]*)"', 1)) FROM k WHERE key = 'xmp' UNION ALL
  SELECT user_id, 2, 1, key, unnest(regexp_extract_all(value, '<tiff:software>(.*?)</tiff:software>', 1)) FROM k WHERE key = 'xmp') GROUP BY user_id"""


@query("p1_software_fields", """WITH k AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'Software' WHEN 'view' THEN 'Artist' WHEN 'signup' THEN 'Prompt' WHEN 'error' THEN 'xmp' ELSE 'Make' END AS key,
  CASE event_type WHEN 'error' THEN '<x xmp:creatortool="' || event_id || '" aux:imagenumber="1"><tiff:software>T' || event_id || '</tiff:software></x>' ELSE props END AS value FROM events) """ + _SOFTWARE_SQL)
def _(spark, sf):
    names = {"click": "Software", "view": "Artist", "signup": "Prompt", "error": "xmp", "purchase": "Make"}
    xmp = F.concat(F.lit('<x xmp:creatortool="'), "event_id", F.lit('" aux:imagenumber="1"><tiff:software>T'), "event_id", F.lit("</tiff:software></x>"))
    tags = t(spark, sf, "events").select("user_id", C.harmonise_label(F.col("event_type"), names).alias("key"), F.when(F.col("event_type") == "error", xmp).otherwise(F.col("props")).alias("value"))
    return P.software_fields(tags, "user_id", "key", "value")


@query("p1_xmp_property", "SELECT page_id, array_to_string(list_concat(regexp_extract_all(html, '(?is)lang=\"([^\"]*)\"', 1), regexp_extract_all(html, '(?is)<lang>(.*?)</lang>', 1)), ',') AS lang, md5(array_to_string(list_concat(regexp_extract_all(html, '(?is)h1=\"([^\"]*)\"', 1), regexp_extract_all(html, '(?is)<h1>(.*?)</h1>', 1)), ',')) AS h1 FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.array_join(P.xmp_property(F.col("html"), "lang"), ",").alias("lang"), F.md5(F.array_join(P.xmp_property(F.col("html"), "h1"), ",")).alias("h1"))


_MARKERS = ("idiot", "with", "de la", "für", "that")
_MARKER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){m}([^a-z0-9]|$)') THEN '{m}'" for m in _MARKERS) + " END"


@query("p2_match_marker", f"SELECT doc_id, {_MARKER_SQL} AS marker FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", P.match_marker(F.lower("text"), _MARKERS).alias("marker"))


@query("p3_synthetic_declaration", "SELECT doc_id, CASE WHEN contains(s, 'ofthe') THEN 'ofthe' WHEN contains(s, 'dela') THEN 'dela' END AS declared FROM (SELECT doc_id, regexp_replace(lower(text), '[\\s_-]', '', 'g') AS s FROM documents)")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", P.synthetic_declaration(F.col("text"), ("ofthe", "dela")).alias("declared"))


@query("p4_ai_metadata", f"SELECT doc_id, CASE WHEN contains(s, 'ofthe') THEN 1.0 WHEN {_MARKER_SQL} IS NOT NULL THEN 0.95 END AS score, coalesce(CASE WHEN contains(s, 'ofthe') THEN 'ofthe' END, {_MARKER_SQL}) AS evidence FROM (SELECT doc_id, text, regexp_replace(lower(text), '[\\s_-]', '', 'g') AS s FROM documents)")
def _(spark, sf):
    return P.ai_metadata_signal(t(spark, sf, "documents"), "doc_id", F.col("text"), _MARKERS, ("ofthe",))


@query("p5_camera", f"SELECT media, CASE WHEN NOT bool_or(event_type IN ('signup')) THEN NULL WHEN count(DISTINCT event_type) FILTER (event_type <> 'signup') >= 3 THEN 0.35 ELSE 0.45 END AS score FROM {_WEEKS_SQL} GROUP BY media")
def _(spark, sf):
    return P.camera_signal(weekly(spark, sf), "media", "event_type", ("signup",), ("click", "error", "purchase", "view"))


@query("p6_signed_manifest", """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 0.95 WHEN value > 250 THEN 1.0 ELSE 0.15 END AS score, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS generator, CASE WHEN event_type = 'error' THEN 'a.mismatch' END AS codes FROM events""")
def _(spark, sf):
    status = F.when(F.col("event_type") == "error", F.array(F.struct(F.lit("a.mismatch").alias("code")))).otherwise(F.array().cast("array<struct<code:string>>"))
    m = F.create_map(F.lit("m1"), F.struct(F.col("event_type").alias("claim_generator"), (F.col("value") > 250).alias("synthetic")))
    j = F.when(F.col("event_type") == "view", F.lit("{broken")).otherwise(F.to_json(F.struct(status.alias("validation_status"), F.lit("m1").alias("active_manifest"), m.alias("manifests"))))
    return P.manifest_signal(t(spark, sf, "events").select("event_id", j.alias("j")), "event_id", "j")


@query("r1_incremental_batch", "SELECT doc_id, CASE WHEN n_chars > 100 THEN 'ok' ELSE 'error' END AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    from ..streaming.incremental import score_pending

    return score_pending(t(spark, sf, "documents"), t(spark, sf, "labels"), "doc_id", F.when(F.col("n_chars") > 100, "ok").otherwise("error"))


@query(
    "r2_admission",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, true AS admitted, ts AS a1, CAST(NULL AS TIMESTAMP) AS a2 FROM e WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, ok, CASE WHEN ok THEN ts ELSE a1 END, CASE WHEN ok THEN a1 ELSE a2 END FROM (
        SELECT e.*, r.a1, r.a2, r.a2 IS NULL OR r.a2 <= e.ts - INTERVAL 36 HOUR AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
    SELECT user_id, event_id, admitted FROM r""",
)
def _(spark, sf):
    return admission.admit_batch(t(spark, sf, "events"), "user_id", "ts", "event_id", 2, 36 * 3600)


@query("r3_recover_stale", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01' THEN 'failed' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01' AS recovered FROM orders")
def _(spark, sf):
    return H.recover_stale(t(spark, sf, "orders"), "o_orderstatus", ["P"], "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "status", "recovered")


@query("r4_lifecycle", "SELECT user_id, arg_max(event_type, ts) AS status, date_diff('millisecond', min(ts), max(ts)) AS duration_ms FROM events GROUP BY user_id")
def _(spark, sf):
    return H.lifecycle(t(spark, sf, "events"), "user_id", "event_type", "ts")


#: What the event types stand for as statuses; a record is open for 30 days in the tests.
AS_STATUS = {"signup": "pending", "view": "processing", "click": "processing", "purchase": "completed", "error": "failed"}
_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"


def status_events(spark, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("user_id", C.harmonise_label(F.col("event_type"), AS_STATUS).alias("status"), "ts", "event_id")


@query("r4_records", f"""WITH e AS (SELECT user_id, {_STATUS} AS status, ts, event_id FROM events), n AS (SELECT max(ts) AS now FROM e),
  g AS (SELECT user_id, coalesce(max(ts) FILTER (status = 'pending'), min(ts)) AS start, max(ts) AS last, arg_max(status, (ts, event_id)) AS status FROM e GROUP BY user_id),
  r AS (SELECT *, status NOT IN ('completed', 'failed') AND start + INTERVAL 720 HOUR <= now AS recovered FROM g, n),
  d AS (SELECT *, CASE WHEN status IN ('completed', 'failed') THEN last WHEN recovered THEN start + INTERVAL 720 HOUR END AS done FROM r)
  SELECT user_id, CASE WHEN recovered THEN 'failed' ELSE status END AS status, CAST(floor((epoch_us(done) - epoch_us(start)) / 1000) AS BIGINT) AS duration_ms, epoch_us(done) AS completed_us, recovered FROM d""")
def _(spark, sf):
    e = status_events(spark, sf)
    now = e.agg(F.max("ts")).first()[0]
    r = lifecycle.records(e, "user_id", "status", "ts", "event_id", F.lit(now), 720 * 3600)
    return r.select("user_id", "status", "duration_ms", F.unix_micros("completed_at").alias("completed_us"), "recovered")


@query("r5_delete_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return H.delete_ids(o, o.where("o_orderstatus = 'P'"), "o_orderkey")[0].select("o_orderkey")


@query("r6_evolve", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'v2' END AS model_version FROM orders")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.evolve(o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus = 'O'").withColumn("model_version", F.lit("v2"))).select("o_orderkey", "model_version")
