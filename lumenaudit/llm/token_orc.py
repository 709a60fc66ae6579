"""Token ids as ORC: ascending doc_id, integer run-length encoding, row indexes, and Bloom filters on doc_id.

The layout lets a reader take stripes in parallel and skip files, stripes and row groups by doc_id from metadata alone. A row knows its file (shard) and its place in it
(row), so that the order of the ids is that of the files, whatever reads them. Defined results: a null or empty text is the end id alone, a very long one a row like others;
equal doc_ids follow each other in the order of a hash of their texts, so that many of them need not be in one file; a null doc_id comes first; doc_id may be of any type that
sorts; an empty table gives an empty dataset; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table
from .tokens import encoder

#: Bytes of text in a shard, about: a shard is one range of doc_id, sorted and written by one task into one file.
SHARD_BYTES = 32 << 20
#: From so many shards on (a TB) a shard takes more, up to LARGE_SHARD_BYTES (16 TB and more), so that 100 TB are about 100,000 files.
MANY_SHARDS = 1 << 15
LARGE_SHARD_BYTES = 1 << 30
#: Stripes that the text of a shard is worth; as files hold fewer bytes than texts, about half as many are written.
STRIPES = 16
#: Rows that are encoded at a time.
ROWS_AT_ONCE = 2_048


def n_shards_for(n_bytes: int) -> int:
    return max(1, min(-(-n_bytes // SHARD_BYTES), max(MANY_SHARDS, -(-n_bytes // LARGE_SHARD_BYTES))))


def write_token_orc(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_rows: int | None = None, stripe_bytes: int | None = None) -> None:
    """Write doc_id, ids, n_tokens, shard, row in files that follow each other in doc_id; each is sorted.

    The number of files follows the bytes of the texts, or shard_rows where given; stripe_bytes is a file's text divided by STRIPES unless given. The writer looks at its
    size after every 1,024 rows, so a stripe has at least so many.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_shards = n_shards_for(n_bytes) if shard_rows is None else max(1, -(-n_rows // shard_rows))
    stripe_bytes = stripe_bytes or max(SHARD_BYTES // STRIPES, n_bytes // n_shards // STRIPES)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(it):
        enc, shard, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in (whole.slice(at, ROWS_AT_ONCE) for whole in it for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            flat, sizes = enc.encode(b.column(1))
            ends = np.cumsum(sizes)
            ids = np.insert(flat.astype(np.int32), ends, np.int32(end_id))
            offsets = np.concatenate([[0], ends + np.arange(1, len(sizes) + 1)]).astype(np.int32)
            cols = [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes.astype(np.int64) + 1), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(np.arange(row, row + len(sizes)))]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "shard", "row"])

    (
        # Range bounds come from Spark's own sample of the keys; the hash of the text lets a doc_id that very many rows share go to several shards.
        rows.repartitionByRange(n_shards, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .mapInArrow(batches, f"doc_id {kind}, ids array<int>, n_tokens long, shard int, row long")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.rows.between.memory.checks", "1")
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, shard, row. A range or a short list of ids is pushed to the scan, which skips by stripe statistics and Bloom filters."""
    df = spark.read.orc(path)
    if lo is not None:
        df = df.where(F.col("doc_id") >= lo)
    if hi is not None:
        df = df.where(F.col("doc_id") <= hi)
    return df.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else df


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: sizes of shards, of which there are few, give each shard's start, the rows' places in it the rest."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def batches(it):
        for b in it:
            col = b.column(1)
            offsets = np.asarray(col.offsets)
            ids = np.asarray(col.values).astype("<u4")
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    digests = tokens.select("doc_id", "ids", "shard", "row").mapInArrow(batches, f"doc_id {kind}, shard int, row long, n_tokens long, ids_crc32 long")
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(ahead), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        digests.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, "shard")
        .select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def op5_token_orc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path)
    return token_digests(read_token_orc(spark, path))
