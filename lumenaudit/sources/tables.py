"""Scans and sinks: manifests with a fixed schema, prediction tables, images, reports and embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str, schema: StructType, required: bool = False) -> DataFrame:
    """A header CSV of a fixed schema. A missing file is an empty source unless it is required."""
    try:
        return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def filter_splits(df: DataFrame, splits: list[str], column: str = "split") -> DataFrame:
    return df.where(F.col(column).isin(*splits))


def ok_predictions(df: DataFrame, status: str, ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """(rows of the status, one row with the number excluded)."""
    return df.where(F.col(status) == ok), df.agg(F.count_if(~F.col(status).eqNullSafe(F.lit(ok))).alias("excluded"))


def derived_properties(df: DataFrame, width: Column, height: Column, size_bytes: Column) -> DataFrame:
    """Properties that follow from a media item's width, height and size."""
    return df.select(
        "*",
        (width * height / 1e6).alias("megapixels"),
        F.when(height == 0, F.lit(0.0)).otherwise(width / height).alias("aspect_ratio"),
        (F.abs(width - height) <= 2).alias("is_square"),
        (size_bytes / 1024).alias("file_size_kb"),
    )


def container_properties(images: DataFrame) -> DataFrame:
    """Width, height and byte statistics of rows of Spark's image source. Spread and brightness come from one Arrow pass over the pixels."""
    @F.pandas_udf("struct<channel_spread double, brightness double>")
    def statistics(image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data, channels in zip(image["data"], image["nChannels"], strict=True):
            px = np.frombuffer(data, np.uint8).reshape(-1, max(1, channels))[:, :3].astype(float)
            rows.append((float((px.max(1) - px.min(1)).mean()), float(px.mean())))
        return pd.DataFrame(rows, columns=["channel_spread", "brightness"])

    seen = images.where("image is not null and image.height > 0").withColumn("stats", statistics("image"))
    base = seen.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.length("image.data").alias("bytes"), "stats.*")
    return derived_properties(base, F.col("width"), F.col("height"), F.col("bytes")).withColumn("is_grayscale", F.col("channel_spread") < 8)


def check_magic(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files with ok: whether every leading-byte rule (extension, hex, offset) of the file's extension holds; null where none is known."""
    found = F.hex(F.substring(F.col("header"), 1, 32))
    hit = F.expr("substring(found, offset * 2 + 1, length(hex))") == F.col("hex")
    checked = files.withColumn("found", found).join(rules, "extension").groupBy("file_id").agg(F.bool_and(hit).alias("ok"))
    return files.join(checked, "file_id", "left")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_embeddings(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").parquet(path)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the new schema; old rows get nulls in what was added."""
    return old.unionByName(new, allowMissingColumns=True)
