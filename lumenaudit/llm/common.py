"""Shared helpers of the training-data operators: scratch tables, tokenizer paths, CRC folds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import delete_path, discard, materialize, scratch_path, scratch_root  # noqa: F401  what the operators here share

#: The white space of the word pattern [^\x20\x09-\x0D]+. bytes.split() splits on exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """A file as given, or the installed public vocabulary of that name; resolved where it is used."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """name, or the first of name_, name__, ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
