"""Manifest, admission, filter, join, aggregate and ordering operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..operators import content as N
from ..operators import relational as R
from ..sources import tables as S
from ..sources.scratch import scratch_path
from .registry import query

t = S.table
_SPLIT_SQL = "CASE WHEN b < 0.7 THEN 'train' WHEN b < 0.85 THEN 'val' ELSE 'test' END"
_BUCKET_SQL = "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT) / 4294967295.0"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def manifest(spark, sf: str) -> DataFrame:
    """path, class, domain, source, split of labelled documents; the split is by the hash of their source."""
    docs = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.col("quality").alias("class"), F.col("lang").alias("domain"), "source", "n_chars", "toxic", C.assign_split(F.col("source")).alias("split"))


_MANIFEST_SQL = f"(SELECT *, {_SPLIT_SQL} AS split FROM (SELECT d.doc_id, quality AS class, lang AS domain, source, n_chars, toxic, {_BUCKET_SQL.format('source')} AS b FROM documents d LEFT JOIN labels l USING (doc_id)))"


@query("s1_scan_manifest", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, sf):
    """A manifest as CSV, then its scan under a fixed schema."""
    path = scratch_path(spark, "manifest")
    S.write_report(t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return S.read_manifest(spark, path, StructType.fromDDL("doc_id long, lang string, source string, n_chars long"), required=True)


@query("s2_filter_splits", f"SELECT doc_id, split FROM {_MANIFEST_SQL} WHERE split IN ('val', 'test')")
def _(spark, sf):
    return S.filter_splits(manifest(spark, sf), ["val", "test"]).select("doc_id", "split")


@query("s3_ok_predictions", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS excluded FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    kept, excluded = S.ok_predictions(t(spark, sf, "orders"), "o_orderstatus", "F")
    return kept.select("o_orderkey").join(excluded, how="cross")  # one row with the number


@query(
    "s4_container_properties",
    """SELECT doc_id, w, h, w * h / 1e6 AS megapixels, CASE WHEN h = 0 THEN 0.0 ELSE round(w / CAST(h AS DOUBLE), 6) END AS aspect_ratio, abs(w - h) <= 2 AS is_square, n_chars / 1024.0 AS file_size_kb
    FROM (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS w, len(string_split(text, chr(10))) AS h FROM documents)""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("w"), F.size(F.split("text", "\n")).alias("h"))
    return S.derived_properties(d, F.col("w"), F.col("h"), F.col("n_chars")).withColumn("aspect_ratio", r6("aspect_ratio")).drop("n_chars")


@query(
    "s5_admit_uploads",
    """SELECT page_id, kind, safe, kind IS NOT NULL AND length(html) <= 20000 AS admitted FROM (
      SELECT page_id, html, CASE WHEN ext IN ('jpg','jpeg','png','webp') THEN 'image' WHEN ext IN ('mp4','mov','avi','mkv') THEN 'video' END AS kind,
        regexp_replace(regexp_extract(name, '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS safe
      FROM (SELECT page_id, html, name, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM (
        SELECT page_id, html, url || CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mkv' ELSE '' END AS name FROM pages)))""",
)
def _(spark, sf):
    p = t(spark, sf, "pages")
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".JPG").when(F.col("page_id") % 3 == 1, ".mkv").otherwise(""))
    p = p.select("page_id", "html", C.media_type(name).alias("kind"), C.safe_filename(name).alias("safe"))
    return p.select("page_id", "kind", "safe", (F.col("kind").isNotNull() & (F.length("html") <= 20000)).alias("admitted"))


@query("s6_check_magic", "SELECT page_id, bool_and(upper(hex(substr(html, off + 1, length(h) // 2))) = h) AS ok FROM pages, (VALUES (0, '3C21444F43'), (9, '20')) r(off, h) GROUP BY page_id")
def _(spark, sf):
    files = t(spark, sf, "pages").select(F.col("page_id").alias("file_id"), F.lit("html").alias("extension"), F.encode("html", "UTF-8").alias("header"))
    rules = spark.createDataFrame([("html", 0, "3C21444F43"), ("html", 9, "20")], "extension string, offset int, hex string")
    return S.check_magic(files, rules).select(F.col("file_id").alias("page_id"), "ok")


@query("s7_report_rows", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def _(spark, sf):
    """A report as CSV, and what is read back of it."""
    path = scratch_path(spark, "report")
    S.write_report(t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")), path)
    return S.read_manifest(spark, path, StructType.fromDDL("lang string, n long, chars long"), required=True)


@query("s8_embedding_archive", "SELECT vec_id, label, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def _(spark, sf):
    """The archive of embeddings, and what is read back of it."""
    path = scratch_path(spark, "embeddings")
    S.write_embeddings(t(spark, sf, "embeddings"), path, ["vec_id", "embedding", "label"])
    e = spark.read.parquet(path)
    return e.select("vec_id", "label", F.size("embedding").alias("dims"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


@query("c1_harmonise_label", "SELECT doc_id, CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' END AS label FROM labels WHERE quality IN (0, 1)")
def _(spark, sf):
    return t(spark, sf, "labels").select("doc_id", C.harmonise_label(F.col("quality"), {"1": "real", "0": "fake"}).alias("label")).where("label is not null")


@query("c2_probability_pair", "SELECT event_id, round(value / 500, 6) AS fake, round(1 - value / 500, 6) AS real, CASE WHEN value / 500 >= 1 - value / 500 THEN 'fake' ELSE 'real' END AS label FROM events")
def _(spark, sf):
    v = F.col("value") / 500
    e = t(spark, sf, "events").select("event_id", C.fake_real_pair(F.create_map(F.lit("Fake image"), v, F.lit("REAL"), 1 - v)).alias("p"))
    return e.select("event_id", r6("p.fake").alias("fake"), r6("p.real").alias("real"), "p.label")


@query("c3_assign_split", f"SELECT p_partkey, round(b, 6) AS bucket, {_SPLIT_SQL} AS split FROM (SELECT p_partkey, {_BUCKET_SQL.format('p_name')} AS b FROM part)")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", r6(C.split_bucket(F.col("p_name"))).alias("bucket"), C.assign_split(F.col("p_name")).alias("split"))


@query("c4_classify_framing", "SELECT doc_id, CASE WHEN contains(replace(text, 'the', 'close-up'), 'close-up') THEN 'close-up' WHEN contains(replace(text, 'der', 'wide shot'), 'wide shot') THEN 'wide' ELSE 'mid' END AS framing FROM documents")
def _(spark, sf):
    prompt = F.replace(F.replace("text", F.lit("the"), F.lit("close-up")), F.lit("der"), F.lit("wide shot"))
    return t(spark, sf, "documents").select("doc_id", C.classify_framing(prompt).alias("framing"))


@query("c5_clean_attribution", "SELECT page_id, url AS category, CASE WHEN page_id % 2 = 0 THEN 'Public domain (CC0)' ELSE 'unknown' END || ' - ' || url AS attribution FROM pages")
def _(spark, sf):
    category, line = C.clean_attribution(F.concat(F.lit("Category:"), "url"), F.when(F.col("page_id") % 2 == 0, "CC0"), F.lit(None).cast("string"), F.col("url"))
    return t(spark, sf, "pages").select("page_id", category.alias("category"), line.alias("attribution"))


@query("c6_admit_by_license", "SELECT p_partkey FROM part WHERE lower(trim(p_brand)) IN ('brand#11','brand#12','brand#23','brand#34') AND p_size >= 10")
def _(spark, sf):
    return t(spark, sf, "part").where(C.normal_license(F.col("p_brand")).isin("brand#11", "brand#12", "brand#23", "brand#34") & (F.col("p_size") >= 10)).select("p_partkey")


@query("c6_admission", "SELECT p_partkey FROM part WHERE nullif(trim(lower(p_brand)), '') IN ('brand#11', 'brand#23', 'brand#34', 'brand#42') AND CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'image/jpeg' WHEN 'ECONOMY' THEN 'image/png' WHEN 'SMALL' THEN 'image/tiff' END IN ('image/jpeg', 'image/png') AND p_size * 20 >= 300 AND p_retailprice >= 300")
def _(spark, sf):
    mime = C.harmonise_label(F.split_part("p_type", F.lit(" "), F.lit(1)), {"PROMO": "image/jpeg", "ECONOMY": "image/png", "SMALL": "image/tiff"})
    kept = C.admitted(F.col("p_brand"), mime, F.col("p_size") * 20, F.col("p_retailprice"), ("brand#11", "brand#23", "brand#34", "brand#42"))
    return t(spark, sf, "part").where(kept).select("p_partkey")


@query("c7_stable_id", "SELECT page_id, substr(sha1(url), 1, 12) AS stable_id FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", C.stable_id(F.col("url")).alias("stable_id"))


@query(
    "c8_bounded_dims",
    """SELECT p_partkey, CASE WHEN m > 1600 THEN greatest(1, CAST(floor(w * (1600.0::DOUBLE / m)) AS INTEGER)) ELSE w END AS width, CASE WHEN m > 1600 THEN greatest(1, CAST(floor(h * (1600.0::DOUBLE / m)) AS INTEGER)) ELSE h END AS height
    FROM (SELECT p_partkey, p_size * 60 AS w, p_size * 45 AS h, p_size * 60 AS m FROM part) WHERE least(w, h) >= 384""",
)
def _(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 60).alias("w"), (F.col("p_size") * 45).alias("h")).where(F.least("w", "h") >= 384)
    return p.select("p_partkey", C.bounded_side(F.col("w"), F.greatest("w", "h")).alias("width"), C.bounded_side(F.col("h"), F.greatest("w", "h")).alias("height"))


_CHARS_SQL = "(SELECT doc_id, unnest(string_split(text, '')) AS symbol FROM documents WHERE length(text) > 0)"
_ENTROPY_SQL = f"(SELECT doc_id, -sum(p * log2(p)) AS entropy FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, symbol, count(*)::DOUBLE AS n FROM {_CHARS_SQL} GROUP BY 1, 2)) GROUP BY doc_id)"


@query("c10_symbol_entropy", f"SELECT doc_id, round(entropy, 6) AS entropy FROM {_ENTROPY_SQL}")
def _(spark, sf):
    return N.text_entropy(t(spark, sf, "documents"), ["doc_id"], "text").where("entropy is not null").select("doc_id", r6("entropy").alias("entropy"))


@query("c9_quality_gate", f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'unreadable' WHEN n_chars < 384 THEN 'too_small' WHEN entropy < 4.0 THEN 'low_entropy' END AS reject_reason FROM documents LEFT JOIN {_ENTROPY_SQL} USING (doc_id)")
def _(spark, sf):
    d = t(spark, sf, "documents")
    d = N.text_entropy(d.withColumn("empty", F.coalesce(F.col("text") == "", F.lit(True))), ["doc_id", "n_chars", "empty"], "text")
    return N.quality_gate(d, [("unreadable", F.col("empty")), ("too_small", F.col("n_chars") < 384), ("low_entropy", F.col("entropy") < 4.0)]).select("doc_id", "reject_reason")


@query("c11_crop_box", "SELECT p_partkey, least(w, h) AS side, (w - least(w, h)) // 2 AS left_x, (h - least(w, h)) // 2 AS top_y FROM (SELECT p_partkey, p_size * 7 AS w, p_size * 4 + 100 AS h FROM part)")
def _(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7).alias("w"), (F.col("p_size") * 4 + 100).alias("h"))
    side, left, top = C.crop_box(F.col("w"), F.col("h"))
    return p.select("p_partkey", side.alias("side"), left.alias("left_x"), top.alias("top_y"))


@query("c12_reroot_path", "SELECT page_id, 'norm/real/' || regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') || '.jpg' AS path, url AS original_path FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", C.reroot_path(F.col("url"), "norm", F.lit("real")).alias("path"), F.col("url").alias("original_path"))


@query("c13_squash", "SELECT event_id, round(value / (value + 50), 6) AS ratio, round(least(1, greatest(0, value / 500)), 6) AS share, round(least(1, greatest(0, (value / 500 - 0.9) / 0.1)), 6) AS above FROM events")
def _(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").select("event_id", r6(C.squash(v, "ratio", 50)).alias("ratio"), r6(C.squash(v, "share", 500)).alias("share"), r6(C.squash(v / 500, "above")).alias("above"))


@query("c14_linear_probability", "SELECT vec_id, round(1 / (1 + exp(-(0.1 + list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (i - 32) / 16.0))))), 6) AS p FROM embeddings")
def _(spark, sf):
    logit = C.linear_logit(F.col("embedding"), [(i - 32) / 16.0 for i in range(1, 65)], 0.1)
    return t(spark, sf, "embeddings").select("vec_id", r6(C.sigmoid(logit)).alias("p"))


@query(
    "c15_bands",
    """SELECT event_id, CASE WHEN s >= .65 THEN 'high' WHEN s <= .35 THEN 'low' ELSE 'medium' END AS band, CASE WHEN s < .3 THEN 'low' WHEN s < .6 THEN 'medium' ELSE 'high' END AS risk,
    CASE WHEN s >= .5 AND s >= .6 THEN 'Verdict: LIKELY AI GENERATED / MANIPULATED' WHEN s >= .5 THEN 'Verdict: SUSPICIOUS — possible manipulation detected' WHEN s < .3 THEN 'Verdict: AUTHENTIC — no significant signs of manipulation detected' ELSE 'Verdict: LIKELY AUTHENTIC — minor inconsistencies detected, likely not manipulation' END AS headline
    FROM (SELECT event_id, value / 500 AS s FROM events)""",
)
def _(spark, sf):
    s = F.col("value") / 500
    e = t(spark, sf, "events").select("event_id", C.band(s).alias("band"), C.risk(s).alias("risk"), F.when(s >= 0.5, "suspicious").otherwise("authentic").alias("verdict"))
    return e.select("event_id", "band", "risk", C.headline(F.col("verdict"), F.col("risk")).alias("headline"))


@query("c16_signal_meta", "SELECT event_id, coalesce(label, event_type) AS label FROM events LEFT JOIN (VALUES ('click','Clicks'), ('view','Views')) m(event_type, label) USING (event_type)")
def _(spark, sf):
    meta = spark.createDataFrame([("click", "Clicks"), ("view", "Views")], "event_type string, label string")
    return R.lookup(t(spark, sf, "events"), meta, "event_type", "label", F.col("event_type")).select("event_id", "label")


@query("c17_latin1_text", "SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,'—','--'),'–','-'),'‘',''''),'’',''''),'“','\"'),'”','\"'),'…','...'),' ',' '),'•','*'),'×','x'), '[^\\x00-\\x{FF}]', '', 'g')) AS digest FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(C.latin1_text(F.col("text"))).alias("digest"))


@query("c18_json_breakdown", "SELECT event_id, coalesce(TRY_CAST(props->>'$.k' AS BIGINT), -1) AS k, '{\"type\":\"' || event_type || '\"}' AS built FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "struct<k long>")
    return t(spark, sf, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1).cast("long")).alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("built"))


_FRAMES_SQL = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value / 500 AS score FROM events)"


def frames(spark, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").withColumn("frame_idx", F.row_number().over(w) - 1).withColumn("score", F.col("value") / 500)


@query("c19_even_frames", f"SELECT user_id, frame_idx FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM {_FRAMES_SQL}) WHERE CASE WHEN 8 >= total THEN true ELSE list_contains(list_transform(range(0, 8), lambda i: CAST(floor(i * (total / 8.0::DOUBLE)) AS BIGINT)), frame_idx) END")
def _(spark, sf):
    return N.sample_frames(frames(spark, sf), "user_id", "frame_idx", 8).select("user_id", "frame_idx")


@query("c20_frame_time", f"SELECT user_id, frame_idx, round(CASE WHEN user_id % 7 > 0 THEN frame_idx / (user_id % 7)::DOUBLE ELSE 0 END, 6) AS seconds, round(CASE WHEN user_id % 7 > 0 THEN count(*) OVER (PARTITION BY user_id) / (user_id % 7)::DOUBLE END, 6) AS total FROM {_FRAMES_SQL}")
def _(spark, sf):
    f, fps = frames(spark, sf), F.col("user_id") % 7
    return f.select("user_id", "frame_idx", r6(C.frame_time(F.col("frame_idx"), fps)).alias("seconds"), r6(C.duration(F.count(F.lit(1)).over(Window.partitionBy("user_id")), fps)).alias("total"))


@query("c21_validate_records", "SELECT o_orderkey, concat_ws(',', CASE WHEN NOT (o_orderstatus IN ('F','O')) THEN 'status' END, CASE WHEN NOT (o_totalprice BETWEEN 0 AND 200000) THEN 'price' END) AS violations FROM orders")
def _(spark, sf):
    rules = {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice").between(0, 200000)}
    return N.validate_records(t(spark, sf, "orders"), rules).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("c22_client_key", "SELECT page_id, coalesce(nullif(trim(string_split(CASE WHEN page_id % 2 = 0 THEN ' ' || url || ', proxy' END, ',')[1]), ''), regexp_extract(url, '//([^/]+)', 1), 'unknown') AS client FROM pages")
def _(spark, sf):
    forwarded = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url", F.lit(", proxy")))
    return t(spark, sf, "pages").select("page_id", C.client_key(forwarded, F.regexp_extract("url", "//([^/]+)", 1), True).alias("client"))


@query("c23_within_root", "SELECT page_id, page_id % 3 <> 1 AS inside FROM pages")
def _(spark, sf):
    k = F.col("page_id") % 3
    path = F.concat(F.when(k == 0, "/up/./a/").when(k == 1, "/up/a/../../etc/").otherwise("/up/b/../"), F.col("page_id").cast("string"))
    return t(spark, sf, "pages").select("page_id", C.within_root(path, "/up").alias("inside"))


@query("j1_union_sources", "SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'turn', conv_id, text FROM conversations")
def _(spark, sf):
    part = lambda name, kind, key, text: t(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"))
    return R.union_sources(part("documents", "doc", "doc_id", "text"), part("pages", "page", "page_id", "html"), part("conversations", "turn", "conv_id", "text"))


@query("j2_join_scores", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("j3_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return R.pending(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


_WEEKS_SQL = "(SELECT user_id * 1000 + CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) / 7.0) AS BIGINT) AS media, event_type, value / (value + 50) AS s, user_id, event_id FROM events)"
TYPES = ["click", "error", "purchase", "signup", "view"]


def weekly(spark, sf: str) -> DataFrame:
    """media (user and week), event_type, s."""
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("long")
    return t(spark, sf, "events").select((F.col("user_id") * 1000 + week).alias("media"), "event_type", (F.col("value") / (F.col("value") + 50)).alias("s"), "user_id", "event_id")


@query("j4_complete_rows", f"SELECT * FROM (SELECT media, {', '.join(f'round(avg(s) FILTER (event_type = {x!r}), 6) AS {x}' for x in TYPES)} FROM {_WEEKS_SQL} GROUP BY media) WHERE {' AND '.join(f'{x} IS NOT NULL' for x in TYPES)}")
def _(spark, sf):
    long = weekly(spark, sf).groupBy("media", "event_type").agg(r6(F.avg("s")).alias("s"))
    return R.complete_rows(long, "media", "event_type", "s", TYPES)


_HASH_SQL = """(SELECT doc_id, source, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN coalesce(h[i + 1], 0) > coalesce(h[i], 0) THEN (1::HUGEINT << (63 - i)) ELSE 0 END)) AS u FROM (
  SELECT doc_id, any_value(source) AS source, histogram(g) AS h FROM (
    SELECT doc_id, source, unnest(CASE WHEN len(a) < 3 THEN [NULL] ELSE list_transform(range(1, len(a) - 1), lambda i: (961 * a[i] + 31 * a[i + 1] + a[i + 2]) % 65) END) AS g FROM (
      SELECT doc_id, source, list_transform(string_split(text, ''), lambda c: unicode(c)) AS a FROM documents)) GROUP BY doc_id))"""
_SIGNED = "CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT)"


def fingerprints(spark, sf: str) -> DataFrame:
    """doc_id, source, split, dhash of documents."""
    d = N.text_dhash(t(spark, sf, "documents"), ["doc_id", "source"], "text")
    return d.select("doc_id", "source", C.assign_split(F.col("source")).alias("split"), "dhash")


@query("d1_dhash", f"SELECT doc_id, {_SIGNED} AS dhash FROM {_HASH_SQL}")
def _(spark, sf):
    return fingerprints(spark, sf).select("doc_id", "dhash")


_PAIRS_SQL = f"""(SELECT a.h AS h1, b.h AS h2, bit_count(xor(a.h, b.h)) AS distance, least(a.lo, b.lo) <> greatest(a.hi, b.hi) AS crosses FROM
  (SELECT h, min(split) AS lo, max(split) AS hi FROM f GROUP BY h) a JOIN (SELECT h, min(split) AS lo, max(split) AS hi FROM f GROUP BY h) b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 4)"""
_F_SQL = f"WITH f AS MATERIALIZED (SELECT doc_id, source, {_SIGNED} AS h, {_SPLIT_SQL.replace('b <', _BUCKET_SQL.format('source') + ' <')} AS split FROM {_HASH_SQL})"


@query("j5_near_pairs", f"{_F_SQL} SELECT h1, h2, CAST(distance AS INTEGER) AS distance FROM {_PAIRS_SQL} WHERE crosses")
def _(spark, sf):
    return R.near_pairs(fingerprints(spark, sf), "dhash", different="split").withColumn("distance", F.col("distance").cast("int"))


@query("j6_tile_pairs", "SELECT a.label, round(max(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id >= 40 GROUP BY a.label")
def _(spark, sf):
    e = t(spark, sf, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return R.tile_pairs(e, "label", ["vec_id"], "v", 40).select("label", r6("best").alias("best"))


@query("j7_with_previous", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_id FROM events")
def _(spark, sf):
    return R.with_previous(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_id"]).select("event_id", "prev_event_id")


@query("j8_value_overlap", "WITH p AS (SELECT o_orderpriority, o_custkey % 100 AS k, count(DISTINCT o_orderstatus) AS c FROM orders GROUP BY 1, 2) SELECT count(*) FILTER (c = (SELECT count(DISTINCT o_orderstatus) FROM orders)) AS shared, count(*) AS all_values, round(count(*) FILTER (c = (SELECT count(DISTINCT o_orderstatus) FROM orders)) / count(*)::DOUBLE, 6) AS overlap FROM p")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 100).alias("k"))
    return R.value_overlap(o, "o_orderstatus", ["o_orderpriority", "k"]).withColumn("overlap", r6("overlap"))


@query("j9_lookup", "SELECT n_nationkey, n_name, coalesce(CASE WHEN r_regionkey < 3 THEN r_name END, 'elsewhere') AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    region = t(spark, sf, "region").where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return R.lookup(t(spark, sf, "nation"), region, "n_regionkey", "r_name", F.lit("elsewhere")).select("n_nationkey", "n_name", "r_name")


@query("a1_group_profile", """WITH d AS (SELECT lang, source, n_chars, n_chars < 1000 AS short FROM documents), h AS (SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS hist FROM (SELECT lang, source, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY lang)
  SELECT lang, n, min_n_chars, median_n_chars, max_n_chars, share_short, hist FROM (SELECT lang, count(*) AS n, min(n_chars) AS min_n_chars, median(n_chars) AS median_n_chars, max(n_chars) AS max_n_chars, round(avg(short::INT), 6) AS share_short FROM d GROUP BY lang) JOIN h USING (lang)""")
def _(spark, sf):
    d = t(spark, sf, "documents").select("lang", "source", "n_chars", (F.col("n_chars") < 1000).cast("int").alias("short"))
    p = R.group_profile(d, ["lang"], ["n_chars"], ["short"], ["source"])
    hist = F.array_join(F.transform(F.array_sort(F.map_entries("hist_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return p.select("lang", "n", "min_n_chars", "median_n_chars", "max_n_chars", r6("share_short").alias("share_short"), hist.alias("hist"))


@query("a2_counter", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(spark, sf):
    return R.counter(t(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


_DUP_SQL = f"(SELECT h, count(*) AS n, count(DISTINCT split) AS splits, count(DISTINCT class) AS classes FROM (SELECT sha256(text) AS h, split, lang AS class FROM {_MANIFEST_SQL} JOIN (SELECT doc_id, text, lang FROM documents) USING (doc_id)) GROUP BY h HAVING count(*) > 1)"


@query("a3_duplicate_groups", f"SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS members, count(*) FILTER (splits > 1) AS cross_split, count(*) FILTER (classes > 1) AS cross_class FROM {_DUP_SQL}")
def _(spark, sf):
    d = t(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), C.assign_split(F.col("source")).alias("split"), "lang")
    return R.duplicate_groups(d, "h", "split", "lang")


_DIST_SQL = "(SELECT o_orderstatus AS label, o_custkey % 50 AS size, count(*) AS n FROM orders GROUP BY 1, 2)"


def class_distributions(spark, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), (F.col("o_custkey") % 50).alias("size"))


@query("a4_class_distributions", f"SELECT label, count(*) AS distinct_sizes, min(size) AS min_size, '[' || array_to_string(list(size || ':' || n ORDER BY n DESC, size)[1:5], ', ') || ']' AS top5 FROM {_DIST_SQL} GROUP BY label")
def _(spark, sf):
    d = class_distributions(spark, sf)
    top = R.top_k(d, "size", 5, ["label"]).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "size", "n").alias("x")))).alias("top"))
    out = d.groupBy("label").agg(F.countDistinct("size").alias("distinct_sizes"), F.min("size").alias("min_size")).join(top, "label")
    return out.select("label", "distinct_sizes", "min_size", F.concat(F.lit("["), F.array_join(F.transform("top", lambda e: e["x"]), ", "), F.lit("]")).alias("top5"))


@query("a5_vetting_verdict", f"SELECT (SELECT count(DISTINCT label) FROM {_DIST_SQL}) AS classes, count(*) FILTER (c = 3) AS shared, CASE WHEN (SELECT min(size) FROM {_DIST_SQL}) < 1 THEN 'RISKY' WHEN count(*) FILTER (c = 3) = 0 THEN 'USABLE AFTER NORMALIZATION' ELSE 'PROMISING' END AS verdict FROM (SELECT size, count(DISTINCT label) AS c FROM {_DIST_SQL} GROUP BY size)")
def _(spark, sf):
    return N.vetting_verdict(class_distributions(spark, sf), "label", "size", 1)


@query("a6_frame_stats", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"))


@query("a7_region_means", "SELECT l_suppkey, round(coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0), 6) AS l_quantity_inside, round(coalesce(avg(l_quantity) FILTER (l_returnflag <> 'R'), 0), 6) AS l_quantity_outside FROM lineitem GROUP BY 1")
def _(spark, sf):
    m = R.region_means(t(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", ["l_quantity"])
    return m.select("l_suppkey", r6("l_quantity_inside").alias("l_quantity_inside"), r6("l_quantity_outside").alias("l_quantity_outside"))


@query("a8_block_cv", "SELECT l_suppkey, count(*) AS blocks, round(stddev_pop(m) / (avg(m) + 1e-6), 6) AS cv FROM (SELECT l_suppkey, l_orderkey // 16 AS b, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return R.block_cv(t(spark, sf, "lineitem"), ["l_suppkey"], [F.floor(F.col("l_orderkey") / 16)], F.col("l_extendedprice")).withColumn("cv", r6("cv"))


_GRID_SQL = "(SELECT vec_id, label, i // 8 AS y, i % 8 AS x, abs(CAST(embedding[i + 1] AS DOUBLE)) AS v, sqrt((i // 8 - 4) * (i // 8 - 4) + (i % 8 - 4) * (i % 8 - 4)) AS radius FROM embeddings, range(0, 64) r(i))"


def grid(spark, sf: str) -> DataFrame:
    """vec_id, label, y, x, v, radius: an embedding as 8 x 8 cells, radius from cell (4, 4)."""
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    e = e.select("vec_id", "label", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.abs(F.col("e").cast("double")).alias("v"))
    return e.withColumn("radius", F.sqrt((F.col("y") - 4) * (F.col("y") - 4) + (F.col("x") - 4) * (F.col("x") - 4)))


@query("a9_radial_profile", f"SELECT vec_id, bin, round(coalesce(mean, 0), 6) AS mean FROM (SELECT DISTINCT vec_id, CAST(b AS INTEGER) AS bin FROM embeddings, range(0, 20) q(b)) LEFT JOIN (SELECT vec_id, CAST(least(floor(radius / (top / 20)), 19) AS INTEGER) AS bin, avg(v) AS mean FROM (SELECT *, max(radius) OVER (PARTITION BY vec_id) AS top FROM {_GRID_SQL}) GROUP BY 1, 2) USING (vec_id, bin)")
def _(spark, sf):
    return R.radial_profile(grid(spark, sf), "vec_id", "radius", "v", 20).withColumn("mean", r6("mean"))


@query("a12_peak_fraction", "SELECT user_id, round(avg((value / 500 > 0.7)::INT), 6) AS peak FROM events GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(r6(F.avg((F.col("value") / 500 > 0.7).cast("double"))).alias("peak"))


def _page(spark, sf):
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.history_page(o, "customer#0000001", "c_name", {"o_orderstatus": "O"}, "o_orderdate", "o_orderkey", 5, 10)


_PAGE_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%customer#0000001%' AND o_orderstatus = 'O'"


@query("k3_history_page", f"SELECT o_orderkey, c_name, o_orderdate {_PAGE_SQL} ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 5")
def _(spark, sf):
    return _page(spark, sf)[0].select("o_orderkey", "c_name", "o_orderdate")


@query("a13_page_total", f"SELECT count(*) AS total {_PAGE_SQL}")
def _(spark, sf):
    return _page(spark, sf)[1]


@query("k1_top_k", "SELECT o_orderstatus, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r <= 2")
def _(spark, sf):
    return R.top_k(t(spark, sf, "orders"), "o_orderpriority", 2, ["o_orderstatus"]).drop("rank")


@query("k2_examples", "SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) AS examples FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY source")
def _(spark, sf):
    return R.examples(t(spark, sf, "documents"), "source", "doc_id")


_MD5_SQL = "md5('42|' || doc_id::VARCHAR)"


@query("k4_class_quota", f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_MD5_SQL}, doc_id) AS r FROM documents) WHERE r <= 20")
def _(spark, sf):
    return R.class_quota(t(spark, sf, "documents"), "lang", "doc_id", 20, 42).select("doc_id", "lang")


@query("k5_shuffle_sample", f"SELECT doc_id FROM documents ORDER BY {_MD5_SQL}, doc_id LIMIT 100")
def _(spark, sf):
    return R.shuffle_sample(t(spark, sf, "documents").select("doc_id"), "doc_id", 100, 42)


@query("w8_stratified_folds", f"SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_MD5_SQL}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def _(spark, sf):
    return R.stratified_folds(t(spark, sf, "labels"), "quality", "doc_id", 5, 42).select("doc_id", "fold")


@query("k6_largest_box", "SELECT p_brand, p_partkey, area FROM (SELECT p_brand, p_partkey, p_size * p_size AS area, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * p_size DESC, p_partkey) AS r FROM part) WHERE r = 1")
def _(spark, sf):
    return R.largest_box(t(spark, sf, "part"), "p_brand", F.col("p_size") * F.col("p_size"), "p_partkey")


@query("k7_ordered_groups", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY 1, 2")
def _(spark, sf):
    return R.counter(t(spark, sf, "documents"), ["lang", "source"]).orderBy("lang", "source")


@query("d2_leakage_report", f"{_F_SQL} SELECT cross_split + cross_class + near AS leak_total, cross_split, cross_class, near, cross_split + cross_class + near = 0 AS ok FROM (SELECT count(*) FILTER (splits > 1) AS cross_split, count(*) FILTER (classes > 1) AS cross_class FROM {_DUP_SQL}), (SELECT count(*) AS near FROM {_PAIRS_SQL} WHERE crosses)")
def _(spark, sf):
    exact = t(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), C.assign_split(F.col("source")).alias("split"), "lang")
    near = R.near_pairs(fingerprints(spark, sf), "dhash", different="split").agg(F.count(F.lit(1)).alias("near"))
    x = R.duplicate_groups(exact, "h", "split", "lang").join(near, how="inner")
    total = F.col("cross_split") + F.col("cross_class") + F.col("near")
    return x.select(total.alias("leak_total"), "cross_split", "cross_class", "near", (total == 0).alias("ok"))


_SPLIT_DOCS_SQL = "(SELECT doc_id, lang, sha256(text) AS x, h, split FROM f JOIN (SELECT doc_id, lang, text FROM documents) USING (doc_id))"
_NEAR_SQL = f"(SELECT h1, h2 FROM {_PAIRS_SQL} WHERE crosses ORDER BY 1, 2 LIMIT 5)"


@query("d2_leakage_examples", f"""{_F_SQL}, d AS MATERIALIZED (SELECT * FROM {_SPLIT_DOCS_SQL}), g AS (SELECT x, min(doc_id) AS first, count(DISTINCT split) AS splits, count(DISTINCT lang) AS classes FROM d WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1),
  picked AS ((SELECT 'cross_split' AS kind, x, first FROM g WHERE splits > 1 ORDER BY first, x LIMIT 5) UNION ALL (SELECT 'cross_class', x, first FROM g WHERE classes > 1 ORDER BY first, x LIMIT 5)),
  n AS (SELECT h1, h2, (SELECT min(doc_id) FROM d WHERE h = h1) AS a, (SELECT min(doc_id) FROM d WHERE h = h2) AS b FROM {_NEAR_SQL})
  SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY first, x) AS INTEGER) AS pos, items FROM (
    SELECT kind, x, first, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS items FROM picked JOIN d USING (x) GROUP BY ALL
    UNION ALL SELECT 'near_cross_split', h1 || '/' || h2, least(a, b), least(a, b) || ',' || greatest(a, b) FROM n)""")
def _(spark, sf):
    d = N.text_dhash(t(spark, sf, "documents").withColumn("h", F.sha2("text", 256)), ["doc_id", "source", "lang", "h"], "text").withColumn("split", C.assign_split(F.col("source")))
    return R.leakage_examples(d, "doc_id", "h", "split", "lang", R.near_pairs(d, "dhash", different="split"), "dhash")
