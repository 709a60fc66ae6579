"""Corpus pipeline: toxicity, near-duplicates, source mixing, packing. Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

Defined results: a null or empty text is clean, near to nothing, has no words and so is never mixed in; a null doc_id is near to nothing and goes through the other stages as any row; of
rows equal in doc_id and text one stays, rows of one doc_id with different texts are told apart by them; ties follow the operators; empty tables give an empty
result with its columns; documents may have more columns of any names, and all stages but the last return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.llm.common import discard, free_name, materialize, table
from lumenaudit.llm.minhash import near_duplicates
from lumenaudit.llm.mixing import mixed_documents
from lumenaudit.llm.packing import pack_documents
from lumenaudit.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5; the model learns from the labels of those at hand."""
    name = free_name("toxicity", docs)
    return score_toxicity(docs, table(spark, sf_dir, "labels"), name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest doc_id and text; of rows equal in both, one.

    Texts are dealt by doc_id once, to meet the ids that go. Only rows of ids that occur twice and stay in part are told apart by their texts.
    """
    key, place, named = (free_name(c, docs) for c in ("text_md5", "dealt_by", "named"))
    marks = near_duplicates(docs).where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text_md5", F.lit("")).alias(key), "first")
    marks = materialize(marks.where(~F.col("first")).unionAll(_repeated(marks)), "pipeline-marks")
    per_id = marks.groupBy("doc_id").agg(F.bool_or("first").alias("stays"))
    ids = lambda df: df.select(F.col("doc_id").alias(place), F.lit(True).alias(named))
    # Rows without an id match nothing; they are dealt by their texts, else all would be one key's.
    spread = docs.withColumn(named, F.col("doc_id").isNotNull()).withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    kept = spread.join(ids(per_id.where(~F.col("stays"))).hint("merge"), [place, named], "left_anti")
    in_part = per_id.where("stays")
    if in_part.isEmpty():
        return kept.select(*docs.columns)
    of_these = kept.join(ids(in_part), [place, named], "left_semi").withColumn(key, F.coalesce(F.md5("text"), F.lit("")))
    own = marks.where("first").select(F.col("doc_id").alias(place), key)
    first = of_these.join(own, [place, key], "left_semi").dropDuplicates([place, key])
    return kept.join(ids(in_part), [place, named], "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def _repeated(marks: DataFrame) -> DataFrame:
    """Marks of the rows that stay and whose doc_id occurs more than once."""
    twice = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    return marks.where("first").join(twice, "doc_id", "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: sources that are to grow are repeated, others are thinned."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_near_duplicates", drop_near_duplicates), ("source_mixing", mix), ("sum_of_squares_packing", pack)]

#: SQL cannot express the toxicity stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
