"""What a media item's own content says: entropy and fingerprint of its symbols, quality rules, sampled frames, and a first verdict on a dataset."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .relational import value_overlap

#: Fixed values of the fingerprint: buckets of a symbol histogram, one more than its bits, and the factors of three symbols in a row.
BUCKETS, FACTORS = 65, (961, 31, 1)


def _symbols(text: str | None) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _by_text(df: DataFrame, keys: list[str], text: str, name: str, kind: str, one) -> DataFrame:
    """keys and a column name, one(code points) of each row's text; texts stay where they are."""
    arrow = {"double": pa.float64(), "long": pa.int64()}[kind]

    def batches(it):
        for b in it:
            out = [one(_symbols(x)) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, arrow)], [*keys, name])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(batches, f"{schema}, `{name}` {kind}")


def text_entropy(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, entropy: Shannon entropy in bits of the text's symbols; null without any."""

    def one(codes: np.ndarray) -> float | None:
        if not len(codes):
            return None
        p = np.unique(codes, return_counts=True)[1] / len(codes)
        return float(-(p * np.log2(p)).sum())

    return _by_text(df, keys, text, "entropy", "double", one)


def symbol_entropy(counts: DataFrame, key: str, count: str) -> DataFrame:
    """key, entropy of a table of symbol counts (pixels, classes, words) that has a row for each key and symbol."""
    p = F.col(count) / F.sum(count).over(Window.partitionBy(key))
    return counts.withColumn("_p", p).groupBy(key).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def dhash(cells: Column) -> Column:
    """64 bits, the first the highest: whether each of 65 cells is less than the next."""
    bits = F.zip_with(F.slice(cells, 1, 64), F.slice(cells, 2, 64), lambda a, b: F.when(b > a, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def text_dhash(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, dhash: the difference hash of a text's histogram of three symbols in a row; 0 for texts of fewer."""

    def one(codes: np.ndarray) -> int:
        c = codes.astype(np.int64)
        n = max(0, len(c) - 2)
        cells = np.bincount(sum(f * c[k : k + n] for k, f in enumerate(FACTORS)) % BUCKETS, minlength=BUCKETS)
        return int(np.packbits(cells[1:] > cells[:-1]).view(">i8")[0])

    return _by_text(df, keys, text, "dhash", "long", one)


def quality_gate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with reject_reason: the first rule that fails, or null for a row that is kept."""
    reason = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        reason = F.when(fails, name).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def validate_records(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with violations: the names of the rules that a row breaks."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def sample_frames(df: DataFrame, media: str, index: str, count: int) -> DataFrame:
    """Rows of evenly spread frames of each media item."""
    total = F.count(F.lit(1)).over(Window.partitionBy(media))
    return df.withColumn("_at", C.even_indices(total, count)).where(F.array_contains("_at", F.col(index))).drop("_at")


def vetting_verdict(d: DataFrame, label: str, size: str, target: int) -> DataFrame:
    """One row: the verdict on a dataset whose classes may be told apart by size alone; null with fewer than two classes."""
    per = d.groupBy(label).agg(F.countDistinct(size).alias("k"), F.min(size).alias("lo")).agg(F.count(F.lit(1)).alias("classes"), F.min("k").alias("k"), F.min("lo").alias("lo"))
    x = per.join(value_overlap(d, label, [size]), how="inner")
    verdict = F.when(F.col("classes") < 2, None).when((F.col("k") == 1) & (F.col("shared") == 0), "UNUSABLE").when(F.col("lo") < target, "RISKY").when(F.col("shared") == 0, "USABLE AFTER NORMALIZATION").otherwise("PROMISING")
    return x.select("classes", "shared", verdict.alias("verdict"))
