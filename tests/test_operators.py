"""Values and edge cases of the library's operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import columns as C
from lumenaudit.operators import audit, content, explain, fusion, metrics, provenance, relational, signals, training
from lumenaudit.sources import tables
from lumenaudit.streaming import admission, incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _signals(spark, scores):
    return spark.createDataFrame([("m", s, v) for s, v in scores.items()], "media string, signal string, score double")


ALL = dict.fromkeys(fusion.CALIBRATION["features"], 0.5)


@pytest.mark.parametrize(
    "extra, p",
    [({}, 0.464847), ({"provenance_ai_metadata": 0.95}, 0.886870), ({"provenance_c2pa": 0.15}, 0.087796), ({"provenance_c2pa": 0.5}, 0.464847)],
)
def test_learned_fusion_values(spark, extra, p):
    assert round(fusion.learned_fusion(_signals(spark, {**ALL, **extra})).first().p, 6) == p


def test_weighted_mean_renormalises_and_verdict(spark):
    s = _signals(spark, {"deep_learning": 0.2, "trained_probe": 0.9, "frequency_analysis": 0.4, "scene_consistency": 0.6, "jersey_color_consistency": None})
    w = fusion.pool_weights(spark)
    r = fusion.weighted_mean(s, w).first()
    assert round(r.weight_sum, 6) == 0.8 and round(r.fused, 6) == 0.74375
    v = fusion.fuse(s, w).first()
    assert (v.verdict, v.risk, v.method, v.status) == ("suspicious", "high", "weighted", "completed")
    failed = fusion.fuse(_signals(spark, {"trained_probe": None}), w).first()
    assert failed.status == "failed" and failed.verdict is None


def test_every_calibrated_feature_is_a_known_signal():
    known = {s for _, members in fusion.POOLS.values() for s in members}
    assert set(fusion.CALIBRATION["features"]) <= known and set(fusion.SHIFTS) <= known and set(explain.REASONS) <= known


def test_split_and_sampling_values(spark):
    for key, bucket, split in (("src0", 0.471520, "train"), ("src1", 0.546370, "train"), ("Category:Sprinters", 0.712268, "val")):
        assert round(one(spark, C.split_bucket(F.lit(key))), 6) == bucket and one(spark, C.assign_split(F.lit(key))) == split
    assert one(spark, C.even_indices(F.lit(30), 8)) == [0, 3, 7, 11, 15, 18, 22, 26]
    assert one(spark, C.even_indices(F.lit(0), 8)) == [] and one(spark, C.even_indices(F.lit(3), 8)) == [0, 1, 2]
    assert round(one(spark, C.squash(F.lit(0.95), "above")), 6) == 0.5 and one(spark, C.squash(F.lit(1.0), "ratio")) == 0.5


def test_markers_are_bounded_by_tokens(spark):
    assert one(spark, provenance.match_marker(F.lit("imagenumber 5"))) is None
    assert one(spark, provenance.match_marker(F.lit("made with imagen, 2024"))) == "imagen"
    assert one(spark, provenance.match_marker(F.lit("flux midjourney"))) == "midjourney"
    assert one(spark, provenance.synthetic_declaration(F.lit("Trained-Algorithmic Media"))) == "trainedalgorithmicmedia"


def test_paths_names_and_probability_pairs(spark):
    assert one(spark, C.within_root(F.lit("/up/a/../b"), "/up")) and not one(spark, C.within_root(F.lit("/up/../etc"), "/up"))
    assert one(spark, C.safe_filename(F.lit("../a b?.PNG"))) == "a_b_.PNG" and one(spark, C.media_type(F.lit("x.MKV"))) == "video" and one(spark, C.media_type(F.lit("x.exe"))) is None
    with pytest.raises(Exception, match="no real label"):
        one(spark, C.fake_real_pair(F.create_map(F.lit("fake"), F.lit(0.5))))


def test_near_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(2)
    hashes = [rnd.getrandbits(64) for _ in range(60)]
    for h in hashes[:30]:
        for n in (1, 3, 4, 5):
            x = h
            for b in rnd.sample(range(64), n):
                x ^= 1 << b
            hashes.append(x)
    signed = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    got = {(r.h1, r.h2) for r in relational.near_pairs(spark.createDataFrame([(i, h) for i, h in enumerate(signed)], "id long, h long"), "h").collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4} and len(got) > 60


def test_auc_ties_and_one_class(spark):
    d = spark.createDataFrame([(0, 0.1, "a"), (1, 0.1, "a"), (1, 0.9, "a"), (1, 0.2, "b")], "y int, s double, g string")
    assert {r.g: r.auc for r in metrics.roc_auc(d, "y", "s", ["g"]).collect()} == {"a": 0.75, "b": None}
    assert metrics.youden_threshold(d.where("g = 'a'"), "y", "s").first().threshold == 0.9


def test_signals_order_as_they_should(spark):
    flat = spark.createDataFrame([("m", f, 0.5) for f in range(8)], "m string, f int, p double")
    wild = spark.createDataFrame([("m", f, float(f % 2)) for f in range(8)], "m string, f int, p double")
    assert signals.temporal_signal(flat, "m", "p").first().score == 0 < signals.temporal_signal(wild, "m", "p").first().score
    assert signals.temporal_signal(flat.limit(1), "m", "p").first().score is None
    still = spark.createDataFrame([("m", f, k, float(k), 1.0) for f in range(3) for k in range(5)], "m string, f int, k int, x double, y double")
    r = signals.landmark_signal(still, "m", "f", "k").first()
    assert r.pairs == 2 and r.jitter == 0 and r.score == 0


def test_missing_manifest_is_empty_unless_required(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("path", StringType())])
    assert tables.read_manifest(spark, str(tmp_path / "none.csv"), schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_manifest(spark, str(tmp_path / "none.csv"), schema, required=True)
    tables.write_report(spark.createDataFrame([("é",)], schema), str(tmp_path / "m.csv"))
    assert tables.read_manifest(spark, str(tmp_path / "m.csv"), schema, required=True).first().path == "é"


def test_image_properties(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    pixels = b"".join(b"\x00" + bytes([200, 100, 0]) * 4 for _ in range(3))
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b""))
    r = tables.container_properties(spark.read.format("image").load(str(tmp_path))).first()
    assert (r.width, r.height, r.channel_spread, r.brightness, r.is_grayscale) == (4, 3, 200.0, 100.0, False)


def test_admission_does_not_count_rejected(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0 + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 10, 20, 61, 62, 75))]
    d = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    assert [r.admitted for r in sorted(admission.admit_batch(d, "k", "ts", "i", 2, 60).collect(), key=lambda r: r.i)] == [True, True, False, True, False, True]


def test_streams(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i,) for i in range(5)], "doc_id long").write.parquet(src)
    run = lambda: incremental.score_incremental(spark.readStream.schema("doc_id long").parquet(src), lambda b: b.withColumn("status", F.lit("ok")), "doc_id", str(tmp_path / "cp"), sink).awaitTermination()
    run()
    spark.createDataFrame([(9,)], "doc_id long").write.mode("append").parquet(src)
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4, 9]
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 10, 20, 61))], "k string, ts timestamp, i int").write.parquet(str(tmp_path / "req"))
    stream = spark.readStream.schema("k string, ts timestamp, i int").parquet(str(tmp_path / "req")).withWatermark("ts", "1 minute")
    q = admission.admit_stream(stream, "k", "ts", "i", 2, 60).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.i, r.admitted) for r in spark.table("admitted").collect()) == [(0, True), (1, True), (2, False), (3, True)]


def test_probe_is_chosen_by_folds_and_combiner_fits_on_val(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) + (2 * (i % 2) if d == 5 else 0) for d in range(8)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    components, c, auc = training.choose_probe(df, "v", "y", "id")
    assert (components, c) in training.probe_grid(8) and 0.8 < auc < 1
    head = training.fit_probe(df, "v", "y", components, c)
    assert training.head_parity(df, "v", head).first()["drift"] < 1e-6
    with pytest.raises(Exception, match="disagrees"):
        training.head_parity(df, "v", head | {"bias": head["bias"] + 1}).collect()
    # Rows of other splits say the opposite of those of val.
    signals = [(i, rnd.random() + (y if split == "val" else -y), split, y) for i in range(90) for split in ("val", "train", "test") for y in (i % 2,)]
    fit = training.fit_combiner(spark.createDataFrame(signals, "media long, a double, split string, y int"), ["a"], "y")
    assert fit["n"] == 90 and fit["weights"][0] > 0 and fit["threshold"] != 0.5


def test_class_told_by_a_category_is_detected(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, ("png", "jpg")[i % 2], rnd.random(), i % 2) for i in range(60)], "id long, format string, size double, y int")
    got = {r.tier: r for r in audit.separability(df, {"container": (["size"], ["format"]), "content": (["size"], [])}, "y", "id").collect()}
    assert got["container"].auc_mean == 1 and got["container"].folds == 5 and got["content"].auc_mean < 0.8 and got["content"].auc_std > 0
    drop = {r.feature: r["drop"] for r in audit.permutation_importance(df, (["size"], ["format"]), "y", "id").collect()}
    assert set(drop) == {"size", "format=jpg", "format=png"} and max(drop["format=jpg"], drop["format=png"]) > 0.2
    assert audit.separability(df.where("y = 1"), {"all": (["size"], [])}, "y", "id").first()["error"] == "only one class present"


def test_every_signal_has_texts_and_reports_state_the_limits(spark):
    known = [s for _, members in fusion.POOLS.values() for s in members]
    assert set(explain.REASONS) == set(explain.NOTES) == set(known) and len(known) == 15
    w = fusion.pool_weights(spark)
    for score, side in ((0.9, 0), (0.1, 1)):
        r = explain.rank_reasons(_signals(spark, dict.fromkeys(known, score)), w).first().reasons
        assert len(r) == 15 and {x.split("(")[0] for x in r} == {explain.REASONS[s][side].split("(")[0] for s in known}
    none = explain.notes(_signals(spark, dict.fromkeys([*known, "other"], None))).first().notes
    assert len(none) == 16 and "other was unavailable for this run." in none
    s = _signals(spark, {"trained_probe": 0.9, "deep_learning": 0.2, "scene_consistency": None})
    import json

    x = explain.explain(fusion.fuse(s, w), s, w).withColumn("model_version", F.lit("probe/vit"))
    r = json.loads(explain.report_json(x, s, w).first().report)
    assert r["limitations"] == list(explain.LIMITATIONS) and r["system_performance"]["test_set_size"] == 275 and r["filename"] is None
    assert r["signals"] == {"trained_probe": {"score": 0.9, "weight": 0.8}, "deep_learning": {"score": 0.2, "weight": 0.2}} and r["provenance"] == {"model_version": "probe/vit", "pipeline_version": None, "fusion_method": "weighted"}
    assert r["unavailable_signals"] == [explain.NOTES["scene_consistency"]] and r["verdict"] == "suspicious" and r["confidence_score"] == 76.0


def test_software_fields_take_only_what_names_a_tool(spark):
    xmp = '<x aux:imagenumber="177034" xmp:CreatorTool = "Nikon\nTool"><dc:creator id="a">Ann</dc:creator><crs:prompt>no</crs:prompt></x>'
    rows = [("m", "Software", "Firefly 2"), ("m", "Make", "imagen"), ("m", "Prompt", "a cat"), ("m", "XML:com.adobe.xmp", xmp), ("n", "Make", "x")]
    got = {r.m: r.fields for r in provenance.software_fields(spark.createDataFrame(rows, "m string, k string, v string"), "m", "k", "v").collect()}
    assert got == {"m": "firefly 2 prompt a cat nikon\ntool ann"}


def test_tile_pairs_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(relational, "BLOCK", 40)  # many blocks, several parts
    rows = [(m, x, y, [rnd.gauss(0, 1) for _ in range(5)]) for m, n in (("a", 700), ("b", 30), ("c", 1)) for x, y in [(rnd.randrange(300), rnd.randrange(300)) for _ in range(n)]]
    got = {r.m: r.best for r in relational.tile_pairs(spark.createDataFrame(rows, "m string, x int, y int, v array<double>"), "m", ["x", "y"], "v", 40).collect()}
    want = {}
    for i, (m, x, y, v) in enumerate(rows):
        for n, p, q, w in rows[i + 1 :]:
            if m == n and (abs(x - p) >= 40 or abs(y - q) >= 40):
                want[m] = max(want.get(m, -1e9), sum(a * b for a, b in zip(v, w)))
    assert got.keys() == want.keys() == {"a", "b"} and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_prefix_sums_over_ranges_equal_plain_curves(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(2), rnd.choice([rnd.random(), 0.5, -1e9]), rnd.choice(["a", "b", None])) for _ in range(900)] + [(1, None, "a"), (None, 0.5, "a"), (1, 3.0, "one class")]
    d = spark.createDataFrame(rows, "y int, s double, g string")
    got = {r.g: r for r in metrics.headline(d.where("y is not null and s is not null"), "y", "s", 0.5, ["g"]).where("g is not null").collect()}
    for g in ("a", "b"):
        own = [(s, y) for y, s, h in rows if h == g and s is not None and y is not None]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        ap, seen = 0.0, 0
        for t in sorted({s for s, _ in own}, reverse=True):
            tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
            ap, seen = ap + (tp - seen) / len(pos) * tp / (tp + fp), tp
        assert abs(got[g].auc - auc) < 1e-12 and abs(got[g].average_precision - ap) < 1e-12
    assert got["one class"].auc is None
    plan = metrics.roc_auc(d, "y", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_at" in line for line in plan.splitlines() if "windowspecdefinition(s#" in line or "Window" in line and "[]" in line)


def test_folds_and_ranks_are_exact(spark):
    d = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(500)], "id long, c int")
    got = relational.hashed_rank(d, ["c"], relational.shuffle_key(1, "id"), "id", "rank").collect()
    import hashlib

    by = {}
    for r in got:
        by.setdefault(r.c, []).append((r["rank"], hashlib.md5(f"1|{r.id}".encode()).hexdigest()))
    for rows in by.values():
        assert [h for _, h in sorted(rows)] == sorted(h for _, h in rows) and sorted(i for i, _ in rows) == list(range(len(rows)))
    few = spark.createDataFrame([(i, int(i < 3)) for i in range(50)], "id long, c int")
    folds = [(r.c, r.fold) for r in relational.stratified_folds(few, "c", "id", 5, 1).collect()]
    assert {f for _, f in folds} == {0, 1, 2} and sorted(f for c, f in folds if c == 1) == [0, 1, 2]  # as many folds as the smallest class has rows


def logistic_by_newton(x, y, ridge):
    """Weights and intercept that minimise the mean log loss plus ridge / 2 times the squared weights."""
    import numpy as np

    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + penalty, z.T @ (y - p) / len(x) - penalty @ w)
    return w[:-1], w[-1]


def test_probe_and_combiner_have_the_coefficients_of_a_plain_fit(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(150, 6)), rng.integers(0, 2, 150)
    x[:, 2] += 1.5 * y
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    head = training.fit_probe(df, "v", "y", 3, 0.5)
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    w, b = logistic_by_newton(z @ vt[:3].T, y, 1 / (0.5 * len(x)))
    assert np.allclose(np.array(head["weights"]), vt[:3].T @ w, atol=2e-3) and abs(head["bias"] - b) < 2e-3
    a = rng.random((90, 2))
    t = (a[:, 0] + 0.3 * rng.normal(size=90) > 0.5).astype(int)
    wide = spark.createDataFrame([(*map(float, r), int(v), "val") for r, v in zip(a, t)], "p double, q double, y int, split string")
    fit = training.fit_combiner(wide, ["p", "q"], "y")
    w, b = logistic_by_newton(a, t, 1 / 90)
    assert np.allclose(fit["weights"], w, atol=2e-3) and abs(fit["intercept"] - b) < 2e-3
    # The threshold is a score of the split at which tpr - fpr is largest.
    p = 1 / (1 + np.exp(-(a @ np.array(fit["weights"]) + fit["intercept"])))
    gain = lambda c: (p[t == 1] >= c).mean() - (p[t == 0] >= c).mean()
    assert abs(gain(fit["threshold"] - 1e-9) - max(gain(c) for c in p)) < 1e-9


def scrambled(h):
    for shift, factor in ((16, 0x7FEB352D), (15, 0x31848BAB), (16, 1)):
        h = (h ^ (h >> shift)) * factor % 2**32
    return h


@pytest.mark.parametrize(("n", "levels"), [(60, 6), (400, 3), (50, 1000)])
def test_bootstrap_equals_plain_draws(spark, n, levels):
    """Scores with ties, with more rows than resamples, and all distinct."""
    import numpy as np

    rnd = random.Random(9)
    rows = [(10 * i + (i << 34), rnd.randrange(2), rnd.randrange(levels) / 5) for i in range(n)]
    got = metrics.bootstrap_auc(spark.createDataFrame([*rows, (1, None, 0.5), (2, 1, None)], "k long, y int, s double").repartition(3), "y", "s", "k", 20, 7).first()
    aucs = []
    for rep in range(20):
        drawn = []
        for k, y, s in rows:
            x = scrambled((scrambled((k ^ (k >> 32)) & 0xFFFFFFFF) + rep * metrics.STEP + 7) % 2**32)
            drawn += [(y, s)] * sum(x >= int(c) for c in metrics.POISSON)
        pos, neg = ([s for y, s in drawn if y == v] for v in (1, 0))
        aucs.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    assert got.replicates == 20 and np.allclose([got.low, got.high], np.percentile(aucs, [2.5, 97.5]))


def test_bootstrap_is_near_that_of_draws_with_replacement(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.normal(0, 1, 500) + 0.7 * y, 2)
    auc = lambda a, b: (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()
    draws = [rng.integers(0, 500, 500) for _ in range(2000)]
    low, high = np.percentile([auc(s[d][y[d] == 1], s[d][y[d] == 0]) for d in draws], [2.5, 97.5])
    got = metrics.bootstrap_auc(spark.createDataFrame(list(zip(range(500), y.tolist(), s.tolist())), "k long, y int, s double"), "y", "s", "k").first()
    assert abs(got.low - low) < 0.02 and abs(got.high - high) < 0.02


def plain_draws(n, rep, stage, part, count, seed=7):
    own = [scrambled((scrambled(part) + scrambled(4 * rep + 2 * stage + seed + k)) % 2**32) for k in (0, 1)]
    for j in range(count):
        high, low = (scrambled((scrambled(j) + x) % 2**32) for x in own)
        yield ((high << 32) + low) % n


@pytest.mark.parametrize(("n", "levels"), [(60, 6), (2500, 3), (2500, 10**6), (1025, 1)])
def test_drawn_bootstrap_equals_plain_draws(spark, n, levels):
    """n draws a resample; scores with ties over several blocks, all distinct, and all equal."""
    from collections import Counter

    import numpy as np

    rnd = random.Random(9)
    rows = sorted((rnd.randrange(levels) / 5, rnd.randrange(2)) for _ in range(n))
    s, y = (np.array(x) for x in zip(*rows))
    got = metrics.bootstrap_auc_drawn(spark.createDataFrame([(b, a) for a, b in rows] + [(None, 0.5), (1, None)], "y int, s double").repartition(3), "y", "s", 12).first()
    aucs, size = [], metrics.BLOCK
    for rep in range(12):
        blocks = Counter(u // size for u in plain_draws(n, rep, 0, 0, n))
        at = np.array([b * size + u for b, c in blocks.items() for u in plain_draws(min(size, n - b * size), rep, 1, b, c)])
        assert len(at) == n
        pos, neg = (s[at][y[at] == v] for v in (1, 0))
        aucs.append((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    assert got.replicates == 12 and np.allclose([got.low, got.high], np.percentile(aucs, [2.5, 97.5]), rtol=0, atol=1e-12)


def test_drawn_bootstrap_without_rows(spark):
    d = spark.createDataFrame([(None, 0.5), (1, None)], "y int, s double")
    assert tuple(metrics.bootstrap_auc_drawn(d, "y", "s", 5).first()) == (0, None, None)
    assert tuple(metrics.bootstrap_auc_drawn(d.fillna(1), "y", "s", 5).first()) == (0, None, None)


def test_bootstrap_query_draws_as_many_as_there_are_rows(spark, tmp_path):
    """Of two rows of two classes, two draws have both classes in one of two resamples; independent multiplicities would in 40 of 100."""
    from lumenaudit.plans import registry

    spark.createDataFrame([(1, 100), (2, 900)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["e2_bootstrap_auc"](spark, str(tmp_path)).first()
    assert abs(got.replicates - 1000) < 100 and (got.low, got.high) == (1, 1)


def test_entropy_and_hash_of_texts(spark):
    import math
    from collections import Counter

    texts = ["", None, "a", "ab", "aaaa", "日本語 and more 🙂🙂", "the quick brown fox " * 30]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.entropy for r in content.text_entropy(d, ["id"], "text").collect()}
    hashes = {r.id: r.dhash for r in content.text_dhash(d, ["id"], "text").collect()}
    for i, t in enumerate(texts):
        n = Counter(t or "")
        want = -sum(c / len(t) * math.log2(c / len(t)) for c in n.values()) if t else None
        assert got[i] is want is None or abs(got[i] - want) < 1e-12
        cells = Counter((961 * ord(a) + 31 * ord(b) + ord(c)) % 65 for a, b, c in zip(t or "", (t or "")[1:], (t or "")[2:]))
        assert hashes[i] % 2**64 == sum((cells[k + 1] > cells[k]) << (63 - k) for k in range(64))
    counts = spark.createDataFrame([("m", "x", 3), ("m", "y", 1)], "m string, s string, n long")
    assert abs(content.symbol_entropy(counts, "m", "n").first().entropy - 0.8112781) < 1e-6


def test_accepted_licences(spark):
    rows = [(" CC-BY ", True), ("cc0", True), ("Public Domain", True), ("cc-by-nc", False), ("", None), (None, None)]
    d = spark.createDataFrame(rows, "licence string, ok boolean").select("ok", C.normal_license(F.col("licence")).isin(*C.ACCEPTED_LICENSES).alias("got"))
    assert all(r.got == r.ok for r in d.collect())


def test_contributions_and_shifts_of_the_learned_fusion(spark):
    s = _signals(spark, {**ALL, "trained_probe": 0.9, "provenance_c2pa": 0.1, "provenance_camera_metadata": 0.5})
    r = fusion.learned_fusion(s).first()
    weights = dict(zip(fusion.CALIBRATION["features"], fusion.CALIBRATION["weights"], strict=True))
    assert r.contributions == pytest.approx({f: w * (0.9 if f == "trained_probe" else 0.5) for f, w in weights.items()})
    assert r.logit == pytest.approx(fusion.CALIBRATION["intercept"] + sum(r.contributions.values()))
    assert r.applied == {"provenance_c2pa": -2.2} and r["shift"] == -2.2
    assert fusion.learned_fusion(_signals(spark, {k: v for k, v in list(ALL.items())[1:]})).count() == 0


def test_technical_summary_is_by_weight_and_names_what_is_missing(spark):
    w = fusion.pool_weights(spark)
    s = _signals(spark, {"deep_learning": 0.2, "trained_probe": 0.9, "unheard_of": 0.4, "scene_consistency": None, "other": None})
    got = explain.technical_summary(fusion.fuse(s, w), s, w).first().summary.split("\n")
    assert got == [
        "Verdict: SUSPICIOUS (fused suspicion score 0.76 on a 0-1 scale).", "Contributing signals:", "  - trained_probe: score=0.90, weight=80%", "  - deep_learning: score=0.20, weight=20%",
        "  - unheard_of: score=0.40, weight=0%", "Signals not available for this analysis:", "  - other: other was unavailable for this run.", f"  - scene_consistency: {explain.NOTES['scene_consistency']}",
    ]
    none = _signals(spark, {"deep_learning": None})
    assert explain.technical_summary(fusion.fuse(none, w), none, w).count() == 0


def test_leakage_examples_are_the_first_groups(spark):
    rows = [(i, f"h{i // 3:02}", i, ("train", "test")[i % 2], "real") for i in range(60)] + [(60 + i, "big", 100, "train", ("real", "fake")[i % 2]) for i in range(200)] + [(300, None, None, "val", "real")]
    df = spark.createDataFrame(rows, "id long, h string, d long, split string, cls string")
    near = spark.createDataFrame([(58, 59, 1), (100, 1, 2)], "h1 long, h2 long, distance int")
    got = sorted(tuple(r) for r in relational.leakage_examples(df, "id", "h", "split", "cls", near, "d").collect())
    split = [("cross_split", k + 1, f"{3 * k},{3 * k + 1},{3 * k + 2}") for k in range(5)]
    assert got == sorted(split + [("cross_class", 1, "60,61,62,63,64"), ("near_cross_split", 1, "1,60"), ("near_cross_split", 2, "58,59")])
    assert relational.leakage_examples(df.limit(0), "id", "h", "split", "cls").count() == 0


def test_admission_refuses_what_is_unknown(spark):
    rows = [(" CC0 ", "image/jpeg", 300, 300), ("cc-by", "image/svg+xml", 900, 900), ("", "image/png", 900, 900), (None, "image/png", 900, 900), ("pd", "image/png", 299, 900), ("pd", "image/png", 900, None), ("cc-by-nc", "image/png", 900, 900)]
    df = spark.createDataFrame(rows, "l string, m string, w int, h int")
    assert [r.x for r in df.select(C.admitted(F.col("l"), F.col("m"), F.col("w"), F.col("h")).alias("x")).collect()] == [True] + [False] * 6


def test_grid_of_probes_equals_fits_one_by_one(spark):
    import numpy as np

    from lumenaudit.operators import grid

    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(300, 10)), rng.integers(0, 3, 300)
    y = (x[:, 1] - x[:, 7] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(f), int(t)) for v, f, t in zip(x, fold, y)], "z array<double>, fold int, y int").repartition(5)
    pairs = [(n, c) for n in (2, 8) for c in (0.01, 1.0, 100.0)]
    models = grid.fit_grid(df, "y", 10, 3, pairs)
    assert [m[:3] for m in models] == [(f, n, c) for f in range(3) for n, c in pairs]
    for f, n, c, weights, bias in models:
        rest = x[fold != f]
        _, _, vt = np.linalg.svd(rest - rest.mean(0), full_matrices=False)
        w, b = logistic_by_newton(rest @ vt[:n].T, y[fold != f], 1 / (c * len(rest)))
        assert np.allclose(weights, vt[:n].T @ w, atol=1e-5) and abs(bias - b) < 1e-5
    scores = grid.held_out_scores(df, "y", 10, models).groupBy("model").agg(F.count("p").alias("n"), F.sum("p").alias("s")).collect()
    assert {r.model: r.n for r in scores} == {i: int((fold == m[0]).sum()) for i, m in enumerate(models)}
    for r in scores:
        f, _, _, weights, bias = models[r.model]
        assert r.s == pytest.approx((x[fold == f] @ weights + bias).sum())
    # Perfectly told classes still converge, and folds whose complement has one class are left out.
    told = spark.createDataFrame([([float(i % 2 * 10), float(i % 5)], i % 2, i % 2) for i in range(40)], "z array<double>, fold int, y int")
    assert grid.fit_grid(told, "y", 2, 2, [(1, 1.0)]) == []
    told = told.withColumn("fold", (F.col("z")[1] % 2).cast("int"))
    assert all(np.isfinite(m[3]).all() for m in grid.fit_grid(told, "y", 2, 2, [(2, 100.0)]))


def test_saved_heads_and_calibrations_come_back_as_they_were(spark, tmp_path):
    head = {"mean": [0.1, 1 / 3], "std": [1.0, 2.0], "weights": [1e-17, -2.5], "bias": 0.1 + 0.2, "pca": object(), "model": object()}
    record = training.head_record(head, "vit", 8, 0.4454, 10)
    for _ in range(2):
        training.save_record(spark, record, str(tmp_path / "head"))
    assert training.read_record(spark, str(tmp_path / "head")) == record and record["feature_dim"] == 2
    fit = {"features": tuple(ALL), "weights": fusion.CALIBRATION["weights"], "intercept": fusion.CALIBRATION["intercept"], "threshold": 0.4454, "n": 7}
    training.save_record(spark, training.calibration_record(fit), str(tmp_path / "fusion"))
    back = training.read_record(spark, str(tmp_path / "fusion"))
    assert training.as_calibration(back) == fusion.CALIBRATION and back["fitted_on"] == {"split": "val", "n": 7}
    assert fusion.learned_fusion(_signals(spark, ALL), training.as_calibration(back)).first().p == pytest.approx(0.464847, abs=1e-6)
    with pytest.raises(ValueError, match="one weight"):
        training.as_calibration(back | {"weights": []})


def test_medians_of_groups_are_exact(spark, monkeypatch):
    import statistics

    rnd = random.Random(12)
    values = {"a": [rnd.choice((1.0, 2.0, 2.0, 1e9 * rnd.random())) for _ in range(501)], "b": [rnd.gauss(0, 1) for _ in range(400)], "one": [7.0], "two": [1.0, 4.0], "same": [3.0] * 50, None: [1.0, 2.0, 9.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for ranges in (128, 3):
        monkeypatch.setattr(metrics, "RANGES", ranges)
        assert {r.g: r.median for r in metrics.medians(df, ["g"], "v").collect()} == {g: statistics.median(vs) for g, vs in values.items()}
    p = {r.g: r for r in relational.group_profile(df, ["g"], ["v"], [], []).collect()}
    assert p["empty"].median_v is None and p["empty"].n == 1 and p[None].median_v == 2 and p["two"].median_v == 2.5 and len(p) == 7
    assert relational.group_profile(df.limit(0), ["g"], ["v"], [], []).count() == 0
