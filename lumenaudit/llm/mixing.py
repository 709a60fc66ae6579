"""Mixing sources to target weights: hash-random order, two-level prefix sums, exact cut at each source's budget.

Native: DataFrame functions only. Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source
of its own, ranked last; a null doc_id hashes as the empty string beside its text; repeated rows are separate rows (equal rows are
interchangeable); an empty table gives an empty result; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, materialize

#: Weights of the sources in code-point order, repeating; and the most often that a source may be repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: water-filling of the total by weight under the cap max_epochs * source_size.

    One row per source reaches the windows without a key; sources are a dimension, documents are not.
    In ascending order of cap/weight, a source is capped while its ratio is at most the level that the rest would get;
    the first that is not capped fixes the level for all that follow.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ranked = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("ord", F.row_number().over(filled))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    )
    first_open = F.min_by(F.col("level"), F.when(F.col("ratio") > F.col("level"), F.col("ord"))).over(everything)
    return ranked.withColumn("fill", F.coalesce(first_open, F.lit(0.0))).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("fill") * F.col("weight")).alias("target")
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, before, budget, taken for every row of docs.

    Each source's rows are put in the order of an md5 of doc_id and text, range-partitioned by its leading bits into about sqrt(N) buckets.
    Bucket totals give each bucket's offset, a running sum inside the bucket the rest, so no task holds a whole source.
    The budget floor(target) is taken as whole epochs over the source and then, in hash order, up to the exact word.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _random_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")
    return _placed(sizes, weights, max_epochs).select("doc_id", "source", "size", "source_size", "target", "before", "budget", "epochs", "rest", "taken")


def _random_key(doc_id: Column, text: Column) -> Column:
    """Of doc_id and text, so that rows without an id, or of one id, do not share a key."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text.cast("string")), F.lit(""))))


def _placed(sizes: DataFrame, weights, max_epochs: int) -> DataFrame:
    targets = materialize(source_targets(sizes, weights, max_epochs), "mix-targets")
    n_buckets = max(1, int(sizes.count() ** 0.5))
    keyed = sizes.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(2**32)).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("inner_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("before", F.col("bucket_before") + F.col("inner_before"))
        .drop("o_source", "o_bucket")
    )
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", F.floor("target").cast("long").alias("budget"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    return (
        placed.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before"))))
    )


def _once_more() -> Column:
    """Whether a whole document is taken once more than the epochs: the one that the budget cuts is, if at least half of it is within."""
    return (F.col("size") > 0) & ((F.col("rest") - F.col("before")) * 2 >= F.col("size"))


def copies_of(mixed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, copies: the mix in whole documents."""
    return mixed.select("doc_id", *keep, (F.col("epochs") + _once_more().cast("int")).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows of docs as often as the mix takes them whole.

    In a source's hash order all rows up to the cut are taken once more, so the cut, one row a source, is all that the texts have to meet: they are not shuffled.
    Rows that are equal in doc_id, source and size are taken together. Columns of docs may have any other names.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _random_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")
    place = F.struct("key", "doc_id", "size")
    cuts = _placed(sizes, weights, max_epochs).groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(_once_more(), place)).alias("cut"))
    cuts = materialize(cuts, "mix-cuts")
    source, cut, epochs, size = (free_name(f"mix_{c}", docs) for c in ("source", "cut", "epochs", "size"))
    own = F.struct(_random_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id"), F.col(size).alias("size"))
    copies = F.col(epochs) + F.coalesce((F.col(size) > 0) & (own <= F.col(cut)), F.lit(False)).cast("long")
    met = docs.join(cuts.toDF(source, epochs, cut), F.col("source").eqNullSafe(F.col(source))).withColumn(size, word_count(F.col("text")))
    return met.withColumn(size, copies).where(F.col(size) > 0).withColumn(size, F.explode(F.sequence(F.lit(1).cast("long"), F.col(size)))).select(*docs.columns)


OP9_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
o AS (SELECT *, row_number() OVER f AS ord,
        coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
        sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
        sum(source_size) OVER () AS total FROM r WINDOW f AS (ORDER BY ratio, source ASC NULLS LAST)),
l AS (SELECT *, CAST(total - capped_before AS DOUBLE) / CAST(weight_left AS DOUBLE) AS level FROM o),
lv AS (SELECT coalesce((SELECT level FROM l WHERE ratio > level ORDER BY ord LIMIT 1), 0.0) AS fill),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), fill * weight) AS target FROM l, lv),
p AS (SELECT sizes.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
j AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.before,
        CAST(floor(t.target) AS BIGINT) AS budget,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM j
"""


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
