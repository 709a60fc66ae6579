"""Pairs inside groups of rows that arrive sorted by group: small groups all at once, large ones in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of more rows than this are compared block by block.
SMALL = 48


def dealt_by(df: DataFrame, keys: list[str], then: str) -> DataFrame:
    """Rows of a group next to each other in one partition, in the order of the column then."""
    return df.repartition(*keys).sortWithinPartitions(*keys, then)


def whole_groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each group): a group that goes on in the next batch waits for it."""
    held: pa.Table | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        heads = _heads(rows, keys)
        last = int(heads[-1])
        held = rows.slice(last)
        if last:
            yield rows.slice(0, last), heads[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _heads(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        col = rows.column(k).combine_chunks()
        codes = col.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def close_pairs(heads: np.ndarray, n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: Callable[[slice, slice], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i before j in one group, that are near: near(i, j) tells it for arrays of rows, block(rows, rows) for all pairs of two slices."""
    sizes = np.diff(np.append(heads, n))
    group = np.repeat(np.arange(len(heads)), sizes)
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        i = small[small + d < n]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        for k in range(0, len(i), 16_384):
            p = i[k : k + 16_384]
            ok = near(p, p + d)
            yield p[ok], p[ok] + d
    for g in np.flatnonzero(sizes > SMALL):
        s, e = int(heads[g]), int(heads[g] + sizes[g])
        for k in range(s, e, 256):
            rows, rest = slice(k, min(k + 256, e)), slice(k, e)
            i, j = np.nonzero(block(rows, rest))
            ok = j > i
            i, j = i[ok] + k, j[ok] + k
            for c in range(0, len(i), 65_536):
                yield i[c : c + 65_536], j[c : c + 65_536]


def block_units(df: DataFrame, members: str, row: str, block: int) -> DataFrame:
    """Give a group of more than block members several units, each of two of its parts or of one: columns part, lo, hi. Each pair of rows meets in one unit or, where both are of one part, is wanted only in that part's own."""
    parts = F.ceil(F.col(members) / block).cast("int")
    return (
        df.withColumn("part", F.pmod(F.xxhash64(row), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("other")
    )
