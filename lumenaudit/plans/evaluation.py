"""Evaluation, audit and training operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit as D
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import training as T
from ..sources import tables as S
from ..sources.scratch import delete_path, scratch_path
from .manifests import _BUCKET_SQL, _SPLIT_SQL, _WEEKS_SQL, TYPES, r6, weekly
from .registry import query

t = S.table


def scored(spark, sf: str) -> DataFrame:
    """Events as scores: y whether it is an error, s its value over 500 in steps of 0.02, g its user."""
    e = t(spark, sf, "events")
    return e.select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), (F.floor(F.col("value") / 10) / 50).alias("s"), (F.col("user_id") % 5).alias("g"), C.assign_split(F.col("user_id").cast("string")).alias("split"))


_S = f"(SELECT event_id, (event_type = 'error')::INT AS y, floor(value / 10) / 50 AS s, user_id % 5 AS g, {_SPLIT_SQL.replace('b <', _BUCKET_SQL.format('user_id::VARCHAR') + ' <')} AS split FROM events)"


def _auc(by: str = "", src: str = _S) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {key} sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE END AS auc FROM (
      SELECT *, coalesce(sum(neg) OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {key} s, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {key} s)) {group})"""


def _curve(by: str = "", src: str = _S) -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"(SELECT {key} s AS threshold, tp, fp, fp::DOUBLE / q AS fpr, tp::DOUBLE / p AS tpr, tp::DOUBLE / (tp + fp) AS precision FROM (SELECT {key} s, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(neg) OVER ({part} ORDER BY s DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS q FROM (SELECT {key} s, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {key} s)))"


def _ap(by: str = "") -> str:
    key, part, group = (f"{by}, ", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"(SELECT {key} sum(step * precision) AS average_precision FROM (SELECT *, tpr - coalesce(lag(tpr) OVER ({part} ORDER BY threshold DESC), 0) AS step FROM {_curve(by)}) {group})"


@query("w3_roc_auc", f"SELECT g, n_pos, n_neg, round(auc, 6) AS auc FROM {_auc('g')}")
def _(spark, sf):
    return M.roc_auc(scored(spark, sf), "y", "s", ["g"]).withColumn("auc", r6("auc"))


@query("w4_roc_pr_curve", f"SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision FROM {_curve()}")
def _(spark, sf):
    c = M.roc_pr_curve(scored(spark, sf), "y", "s")
    return c.select("threshold", "tp", "fp", *[r6(x).alias(x) for x in ("fpr", "tpr", "precision")])


@query("w5_average_precision", f"SELECT g, round(average_precision, 6) AS average_precision FROM {_ap('g')}")
def _(spark, sf):
    return M.average_precision(scored(spark, sf), "y", "s", ["g"]).withColumn("average_precision", r6("average_precision"))


_YOUDEN = "SELECT {k} CASE WHEN j > 0 THEN threshold ELSE 'infinity'::DOUBLE END AS threshold, greatest(j, 0) AS j FROM (SELECT {k} round(tpr - fpr, 12) AS j, threshold, row_number() OVER ({p} ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) AS r FROM {c}) WHERE r = 1"


@query("w6_youden_threshold", f"SELECT g, threshold, round(j, 6) AS j FROM ({_YOUDEN.format(k='g,', p='PARTITION BY g', c=_curve('g'))})")
def _(spark, sf):
    return M.youden_threshold(scored(spark, sf), "y", "s", ["g"]).withColumn("j", r6("j"))


def _headline(by: str) -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    join = f"USING ({by})" if by else "ON true"
    return f"""SELECT b.*, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision FROM (SELECT {key} n, n_fake, tp, fp, fn, tn, mean_fake, mean_real, min_score, max_score, round((tp + tn) / n::DOUBLE, 6) AS accuracy,
      round(greatest(n_fake, n - n_fake) / n::DOUBLE, 6) AS majority, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1, round((tp + fp) / n::DOUBLE, 6) AS predicted_rate FROM (
      SELECT {key} count(*) AS n, count(*) FILTER (y = 1) AS n_fake, count(*) FILTER (s >= .5 AND y = 1) AS tp, count(*) FILTER (s >= .5 AND y = 0) AS fp, count(*) FILTER (s < .5 AND y = 1) AS fn, count(*) FILTER (s < .5 AND y = 0) AS tn,
      round(avg(s) FILTER (y = 1), 6) AS mean_fake, round(avg(s) FILTER (y = 0), 6) AS mean_real, min(s) AS min_score, max(s) AS max_score FROM {_S} {group})) b LEFT JOIN (SELECT {key} auc FROM {_auc(by)}) a {join} LEFT JOIN {_ap(by)} p {join}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if kind == "double" and c not in ("min_score", "max_score") else c for c, kind in df.dtypes])


@query("e1_headline", _headline(""))
def _(spark, sf):
    return _rounded(M.headline(scored(spark, sf), "y", "s", 0.5))


@query("e3_headline_by_domain", _headline("g"))
def _(spark, sf):
    return _rounded(M.headline(scored(spark, sf), "y", "s", 0.5, ["g"]))


def _scrambled(x: str, h: str = "h") -> str:
    for shift, factor in ((16, 0x7FEB352D), (15, 0x31848BAB), (16, 1)):
        x = f"(SELECT * REPLACE (xor({h}, {h} >> {shift}) * {factor} % 4294967296 AS {h}) FROM {x})"
    return x


def _drawn(x: str, stage: int) -> str:
    """x (rep, part, c) with a row for each of its c draws and their 64-bit numbers u."""
    x = f"(SELECT *, (part % 4294967296)::UBIGINT AS h, (4 * rep + {2 * stage} + 7)::UBIGINT AS h0, (4 * rep + {2 * stage} + 8)::UBIGINT AS h1 FROM {x})"
    for h in ("h", "h0", "h1"):
        x = _scrambled(x, h)
    x = f"(SELECT * REPLACE ((h + h0) % 4294967296 AS h0, (h + h1) % 4294967296 AS h1) FROM {x})"
    x = f"(SELECT rep, part, h0, h1, unnest(range(c))::UBIGINT AS h FROM {_scrambled(_scrambled(x, 'h0'), 'h1')})"
    x = f"(SELECT * REPLACE ((h + h0) % 4294967296 AS h0, (h + h1) % 4294967296 AS h1) FROM {_scrambled(x)})"
    return f"(SELECT rep, part, h0 * 4294967296 + h1 AS u FROM {_scrambled(_scrambled(x, 'h0'), 'h1')})"


@query("e2_bootstrap_auc", f"""WITH d AS (SELECT row_number() OVER (ORDER BY s, y) - 1 AS i, y, s FROM (SELECT quality AS y, floor(n_chars / 100.0::DOUBLE) AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)),
  n AS (SELECT count(*) AS n, greatest({M.BLOCK}, (count(*) + {M.BLOCKS - 1}) // {M.BLOCKS}) AS size FROM d),
  r AS (SELECT rep, part, least({M.PART}, n - part * {M.PART}) AS c FROM (SELECT rep, n, unnest(range((n + {M.PART - 1}) // {M.PART})) AS part FROM n, range(0, 2000) r(rep))),
  b AS (SELECT rep, (u % n::UBIGINT)::BIGINT // size AS part, count(*) AS c FROM {_drawn('r', 0)}, n GROUP BY 1, 2),
  x AS (SELECT rep, part * size + (u % least(size, n - part * size)::UBIGINT)::BIGINT AS i FROM {_drawn('b', 1)}, n), j AS (SELECT rep, y, s FROM x JOIN d USING (i)),
  g AS (SELECT rep, s, sum(y) AS pos, sum(1 - y) AS neg FROM j GROUP BY 1, 2),
  a AS (SELECT rep, sum(pos * (below + 0.5 * neg))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY rep HAVING sum(pos) > 0 AND sum(neg) > 0)
  SELECT count(*) AS replicates, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM a""")
def _(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select("quality", F.floor(F.col("n_chars") / 100).alias("s"))
    return M.bootstrap_auc_drawn(d, "quality", "s", 2000, 7).select("replicates", r6("low").alias("low"), r6("high").alias("high"))


_SIG = f"(SELECT event_type AS signal, media, avg(s) AS s, (media // 1000) % 2 AS y FROM {_WEEKS_SQL} GROUP BY 1, 2)"


def labelled_signals(spark, sf: str) -> DataFrame:
    w = weekly(spark, sf).groupBy("event_type", "media").agg(F.avg("s").alias("s"))
    return w.select(F.col("event_type").alias("signal"), "media", "s", (F.floor(F.col("media") / 1000) % 2).cast("int").alias("y"))


@query("e4_signal_ablation", f"SELECT signal, n_pos + n_neg AS n, round(auc, 4) AS auc, CASE WHEN auc < .5 THEN 'INVERTED' ELSE 'OK' END AS direction, round(greatest(auc, 1 - auc), 4) AS flipped_auc, NULL::VARCHAR AS note FROM {_auc('signal', _SIG)}")
def _(spark, sf):
    a = M.signal_ablation(labelled_signals(spark, sf), "signal", "y", "s")
    return a.select("signal", "n", F.round("auc", 4).alias("auc"), "direction", F.round("flipped_auc", 4).alias("flipped_auc"), "note")


@query("e5_compare_baselines", f"SELECT g, CASE WHEN accuracy > majority THEN 'BEATS' ELSE 'DOES NOT BEAT' END AS against_majority, CASE WHEN auc > 0.5458 THEN 'BEATS' ELSE 'DOES NOT BEAT' END AS against_content FROM ({_headline('g')})")
def _(spark, sf):
    h = M.headline(scored(spark, sf), "y", "s", 0.5, ["g"])
    beats = lambda a, b: F.when(a > b, "BEATS").otherwise("DOES NOT BEAT")
    return h.select("g", beats(F.col("accuracy"), F.col("majority")).alias("against_majority"), beats(F.col("auc"), F.lit(0.5458)).alias("against_content"))


@query("e6_transfer_threshold", f"WITH y AS ({_YOUDEN.format(k='', p='', c=_curve('', f'(SELECT * FROM {_S} WHERE split = ' + chr(39) + 'val' + chr(39) + ')'))}) SELECT threshold, round(avg(((s >= threshold)::INT = y)::INT), 6) AS accuracy FROM {_S}, y WHERE split = 'test' GROUP BY threshold")
def _(spark, sf):
    s = scored(spark, sf)
    y = M.youden_threshold(S.filter_splits(s, ["val"]), "y", "s").select("threshold")
    hit = (F.col("s") >= F.col("threshold")).cast("int") == F.col("y")
    return S.filter_splits(s, ["test"]).join(F.broadcast(y), how="inner").groupBy("threshold").agg(r6(F.avg(hit.cast("double"))).alias("accuracy"))  # one row of thresholds


@query("a10_generator_recall", "SELECT l_suppkey, count(*) AS n, round(avg((l_discount >= 0.05)::INT), 6) AS recall, round(avg(l_discount), 6) AS mean_score FROM lineitem GROUP BY 1")
def _(spark, sf):
    g = M.generator_recall(t(spark, sf, "lineitem"), "l_suppkey", "l_discount", 0.05)
    return g.select("l_suppkey", "n", r6("recall").alias("recall"), r6("mean_score").alias("mean_score"))


@query("a11_score_histogram", "SELECT event_type, bin, n, round(n * 25 / sum(n) OVER (PARTITION BY event_type), 6) AS density FROM (SELECT event_type, CAST(least(floor(value / 500 * 25), 24) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("s", F.col("value") / 500)
    return R.score_histogram(e, "event_type", "s").withColumn("density", r6("density"))


_PROPS = "(SELECT doc_id, lang, quality AS y, {0}::DOUBLE AS s FROM documents JOIN labels USING (doc_id))"


def labelled_documents(spark, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "lang", "source", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"), F.size(F.split("text", "\n")).cast("double").alias("lines"))


@query("d5_audit_verdict", "SELECT 'chars' AS feature, round(auc, 6) AS auc, CASE WHEN a >= .9 THEN 'BROKEN' WHEN a >= .75 THEN 'SEVERE' WHEN a >= .6 THEN 'MODERATE' ELSE 'OK' END AS verdict FROM (SELECT auc, greatest(auc, 1 - auc) AS a FROM " + _auc("", _PROPS.format("n_chars")) + ")")
def _(spark, sf):
    a = M.roc_auc(labelled_documents(spark, sf), "y", "chars")
    return a.select(F.lit("chars").alias("feature"), r6("auc").alias("auc"), D.audit_verdict(F.greatest("auc", 1 - F.col("auc")), "container").alias("verdict"))


@query("d6_by_scope", "SELECT scope, round(auc, 6) AS auc FROM " + _auc("scope", "(SELECT *, unnest(['ALL', lang]) AS scope FROM " + _PROPS.format("n_chars") + ")"))
def _(spark, sf):
    return M.roc_auc(D.by_scope(labelled_documents(spark, sf), "lang"), "y", "chars", ["scope"]).select("scope", r6("auc").alias("auc"))


#: Numbers and one-hot columns of each tier.
_TIERS = {"container": (["chars"], ["lang", "source"]), "content_stats": (["words", "lines"], []), "both": (["chars", "words", "lines"], ["lang", "source"])}


@query("d3_separability")
def _(spark, sf):
    return D.separability(labelled_documents(spark, sf), _TIERS, "y", "doc_id")


@query("d4_permutation_importance")
def _(spark, sf):
    return D.permutation_importance(labelled_documents(spark, sf), _TIERS["both"], "y", "doc_id", 5)


_TRAIN = f"(SELECT * FROM (SELECT *, {_BUCKET_SQL.format('vec_id::VARCHAR')} AS b FROM embeddings) WHERE b < 0.7)"


def train_vectors(spark, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings").withColumn("split", C.assign_split(F.col("vec_id").cast("string")))
    return S.filter_splits(e, ["train"]).withColumn("y", (F.col("label") < 5).cast("int"))


@query("t1_standardiser", f"SELECT CAST(i AS INTEGER) AS dim, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(embedding[i + 1] AS DOUBLE)), 6) AS std FROM {_TRAIN}, range(0, 64) r(i) GROUP BY i")
def _(spark, sf):
    return T.fit_standardiser(train_vectors(spark, sf), "embedding").select("dim", r6("mean").alias("mean"), r6("std").alias("std"))


def all_vectors(spark, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")).withColumn("split", C.assign_split(F.col("vec_id").cast("string")))


def _saved(spark, record: dict, tag: str) -> dict:
    """A record as it comes back from storage."""
    path = scratch_path(spark, tag)
    T.save_record(spark, record, path)
    try:
        return T.read_record(spark, path)
    finally:
        delete_path(spark, path)


@query("t2_probe")
def _(spark, sf):
    d = train_vectors(spark, sf)
    components, c, cv_auc = T.choose_probe(d, "embedding", "y", "vec_id")
    fit = T.fit_probe(d, "embedding", "y", components, c)
    score = lambda h: all_vectors(spark, sf).withColumn("p", C.sigmoid(C.linear_logit(F.col("embedding"), h["weights"], h["bias"], h["mean"], h["std"])))
    threshold = T.operating_threshold(S.filter_splits(score(fit), ["val"]), "y", "p")
    head = _saved(spark, T.head_record(fit, "vit", components, threshold, d.count()), "probe-head")
    e, threshold = score(head), head["operating_threshold"]
    hit = e.groupBy("split").agg(F.avg(((F.col("p") >= threshold).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    chosen = {"components": components, "c": c, "cv_auc": cv_auc, "threshold": threshold}
    return M.roc_auc(e, "y", "p", ["split"]).join(hit, "split").select("*", *[F.lit(v).alias(k) for k, v in chosen.items()])


@query("t3_head_parity")
def _(spark, sf):
    d = train_vectors(spark, sf)
    components, c, _auc_of_folds = T.choose_probe(d, "embedding", "y", "vec_id")
    fit = T.fit_probe(d, "embedding", "y", components, c)
    head = _saved(spark, T.head_record(fit, "vit", components, 0.5, d.count()), "probe-head")
    return T.head_parity(S.filter_splits(all_vectors(spark, sf), ["test"]), "embedding", fit | {k: head[k] for k in ("mean", "std", "weights", "bias")})


@query("t4_combiner")
def _(spark, sf):
    wide = R.complete_rows(labelled_signals(spark, sf), "media", "signal", "s", TYPES).withColumn("y", (F.floor(F.col("media") / 1000) % 2).cast("int"))
    wide = wide.withColumn("split", C.assign_split(F.col("media").cast("string")))
    c = T.as_calibration(_saved(spark, T.calibration_record(T.fit_combiner(wide, TYPES, "y")), "calibration"))
    p = C.sigmoid(C.linear_logit(F.array(*TYPES), c["weights"], c["intercept"]))
    return wide.select("media", "split", p.alias("p")).withColumn("fake", F.col("p") >= c["threshold"])
