"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Each piece goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the open sequences with g places left. Pieces are dealt by a hash
of their place into groups of bounded size, packed at the same time; the under-filled sequences that groups leave are packed once more.
Defined results: a null or empty text is a document of its end id alone; a very long text is cut into pieces; repeated rows are packed each, and dealt to groups each by its
place in the table; doc_id may be of any type; an empty table packs to nothing; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import encoder

#: Pieces that one task packs at most, about.
GROUP = 32_768


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): only documents longer than the capacity are cut."""

    def batches(it):
        enc = encoder(tokenizer)
        for b in it:
            flat, sizes = enc.encode(b.column(1))
            rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            at = 0
            for k, n in enumerate(sizes.tolist()):
                ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for p, s in enumerate(range(0, n + 1, capacity)):
                    part = ids[s : s + capacity]
                    for key, v in (("row", k), ("piece", p), ("start", s), ("length", len(part)), ("crc", zlib.crc32(part.tobytes()))):
                        rows[key].append(v)
                    if with_ids:
                        rows["ids"].append(part.astype(np.int32))
            cols = [b.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(rows["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(batches, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given."""
    open_at = np.zeros(capacity + 1, np.int64)  # N(g); a gap of the whole capacity is a new bin, of 0 a full one
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_bins = 0
    for k, size in enumerate(lengths.tolist()):
        # Change of the sum when gap g becomes g - size: (N(g-size)+1)^2 - N(g-size)^2 + (N(g)-1)^2 - N(g)^2, halved, constants left out.
        gain = open_at[: capacity - size + 1] - open_at[size:]
        change = gain.astype(np.float64)
        change[0] = -open_at[size] - 0.5  # a bin that becomes full is counted no more
        change[open_at[size:] == 0] = np.inf
        change[-1] = open_at[capacity - size] - 0.5 if size < capacity else -1.0
        g = int(change.argmin()) + size
        if g == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = bins[g].pop()
            open_at[g] -= 1
        bin_of[k], offset[k] = b, capacity - g
        if g > size:
            bins[g - size].append(b)
            open_at[g - size] += 1
    return bin_of, offset


def pack_pieces(pieces: DataFrame, capacity: int, group_size: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces is a written table: it is read more than once, and a row's place in it deals it to a group."""
    n_groups = max(1, -(-pieces.count() // group_size))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def first(group: pa.Table) -> pa.Table:
        g = int(group.column("group")[0].as_py())
        group = group.take(pc.sort_indices(group, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        length = group.column("length").to_numpy()
        b, off = sum_of_squares(length, capacity)
        fill = np.bincount(b, length, minlength=1).astype(np.int64)
        for name, values in (("bin", b * n_groups + g), ("offset", off), ("fill", fill[b])):
            group = group.append_column(name, pa.array(values))
        return group

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(n_groups)).cast("int"))
    packed = materialize(dealt.groupBy("group").applyInArrow(first, f"{kinds}, group int, bin long, offset long, fill long"), "pack-groups")
    # What the groups leave: sequences under half full join others as wholes; a few in each group, however many rows there are.
    loose = packed.where(F.col("fill") * 2 < capacity).groupBy("bin").agg(F.max("fill").alias("length"))
    n_second = max(1, -(-n_groups // 512))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["length", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        b, off = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"l_bin": pdf["bin"], "l_sequence": -1 - (b * n_second + g), "l_offset": off})

    moved = loose.withColumn("part", F.pmod(F.xxhash64("bin"), F.lit(n_second)).cast("int")).groupBy("part").applyInPandas(second, "l_bin long, l_sequence long, l_offset long")
    return (
        packed.join(moved, F.col("bin") == F.col("l_bin"), "left")
        .withColumn("sequence_id", F.coalesce("l_sequence", "bin"))
        .withColumn("offset", F.col("offset") + F.coalesce("l_offset", F.lit(0)))
        .drop("group", "bin", "fill", "l_bin", "l_sequence", "l_offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity, with_ids), "pack-pieces")
    return pack_pieces(pieces, capacity)


def op4_pack_documents(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
