"""MinHash near-duplicates: banded candidates, odd sketches to verify them, exact confirmation on full shingle sets.

Texts with equal shingle sets are one class, a node with a number of its own; its first row is that of the smallest doc_id. In each band's bucket every member is first
compared with the bucket's first document (a star); then, where a bucket still holds several components, all pairs between
them, in blocks of bounded size. Each pair is measured by the odd sketches of its MinHash samples, then by parity bitmaps of the full sets, whose
bounds leave a true link no room to fail, and what passes is confirmed on the sets themselves.

Defined results: a null, empty or blank text has an empty set and links with nothing; a text of fewer words than a shingle is one
shingle, however long the text; repeated rows are one class; rows of one doc_id with different texts are linked each by its own text and get the smallest doc_id
that is reached from it; a null doc_id gives a null component_id and is kept; an empty table gives an empty result; doc_id is a whole number (a string of one is read as
it); columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import discard, materialize, table
from .components import connected_components
from .units import block_units, close_pairs, dealt_by, whole_groups

#: A link has MUST * |intersection| >= OF * |union|.
MUST, OF = 100, 75
#: Members of a bucket that are compared as one block; and standard deviations left to a sketch.
BLOCK, SIGMAS = 1_024, 5.0


def _bitmap(shingle_set: np.ndarray) -> bytes:
    """Parity bitmap of a whole set, at least four bits a shingle, a power of two: shingle h toggles bit h mod size."""
    bits = max(64, 1 << int(4 * len(shingle_set) - 1).bit_length())
    odd = np.bincount((shingle_set & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signatures(it):
    for b in it:
        n = b.num_rows
        size, cls, keys, sketch, bitmap = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n, [None] * n
        for first, flat, sizes in S.shingle_sets(b.column(1)):
            some = np.flatnonzero(sizes)
            size[first : first + len(sizes)] = sizes
            if not len(some):
                continue
            samples = S.min_hashes(flat, sizes[some])
            bands, odd = S.band_keys(samples), S.odd_sketches(samples)
            for k, s in enumerate(np.split(flat, np.cumsum(sizes[some])[:-1])):
                at = first + int(some[k])
                cls[at] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                keys[at], sketch[at], bitmap[at] = bands[k].tobytes(), odd[k].tobytes(), _bitmap(s)
        cols = [b.column(0), b.column(2), pa.array(size), *(pa.array(x, pa.binary()) for x in (cls, keys, sketch, bitmap))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_md5", "n_shingles", "cls", "keys", "sketch", "bitmap"])


def _band_rows(it):
    """(band, key, node, rep) of each class."""
    for b in it:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            each = [pa.array(np.repeat(np.asarray(c), S.BANDS)) for c in b.columns[:2]]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(S.BANDS, dtype=np.int32), b.num_rows)), pa.array(keys), *each], ["band", "key", "node", "rep"])


def _most_odd(both: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Odd bits that the difference of two sets of both shingles together can show if they are linked, at six deviations."""
    s = both * ((MUST - OF) / (MUST + OF))
    y = 4 * s / bits
    var = np.maximum(bits / 4 * (1 - np.exp(-y)) - s * np.exp(-y), 0)
    return bits / 2 * (1 - np.exp(-y / 2)) + 6 * np.sqrt(var) + 4


def _plausible(pairs: np.ndarray, sizes: np.ndarray, maps: list[bytes]) -> np.ndarray:
    """Which pairs (rows of two indexes) the parity bitmaps leave open."""
    out = np.zeros(len(pairs), bool)
    bits = np.array([8 * len(m) for m in maps], np.int64)
    level = np.minimum(bits[pairs[:, 0]], bits[pairs[:, 1]])
    for n in np.unique(level):
        at = np.flatnonzero(level == n)
        used = np.unique(pairs[at])
        folded = np.empty((len(used), int(n) // 64), np.uint64)
        for k, i in enumerate(used.tolist()):
            folded[k] = np.bitwise_xor.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, int(n) // 64), axis=0)
        row = np.searchsorted(used, pairs[at])
        step = max(1, (1 << 21) // int(n))
        for k in range(0, len(at), step):
            r, p = row[k : k + step], pairs[at[k : k + step]]
            odd = np.bitwise_count(folded[r[:, 0]] ^ folded[r[:, 1]]).sum(1, dtype=np.int64)
            out[at[k : k + step]] = odd <= _most_odd(sizes[p[:, 0]] + sizes[p[:, 1]], float(n))
    return out


def _open_pairs(it):
    """Pairs between components that sketches and bitmaps leave open, each from the first band that brings it together."""
    most = S.most_bits(OF / MUST, SIGMAS)
    for rows, heads in whole_groups(it, ["band", "key", "lo", "hi"]):
        n = len(rows)
        band, node, comp, size, part, lo, hi = (rows.column(c).to_numpy() for c in ("band", "node", "component", "n_shingles", "part", "lo", "hi"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(n, -1)
        maps = rows.column("bitmap").to_pylist()
        whole = lo == hi

        def may(i, j):
            ok = (comp[i] != comp[j]) & (OF * size[i] <= MUST * size[j]) & (OF * size[j] <= MUST * size[i])
            return ok & (whole[i] | (part[i] != part[j]))

        near = lambda i, j: may(i, j) & (np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= most)

        def block(a, b):
            i, j = np.arange(a.start, a.stop)[:, None], np.arange(b.start, b.stop)[None]
            return may(i, j) & (np.bitwise_count(sketch[a, None] ^ sketch[None, b]).sum(2, dtype=np.int64) <= most)

        for i, j in close_pairs(heads, n, near, block):
            new = np.ones(len(i), bool)
            for t in range(int(band[i].max(initial=0))):
                new &= (keys[i, t] != keys[j, t]) | (band[i] <= t)
            pairs = np.column_stack([i[new], j[new]])
            if len(pairs):
                pairs = pairs[_plausible(pairs, size, maps)]
                yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])


def _full_sets(it):
    for b in it:
        sets: list = [None] * b.num_rows
        for first, flat, sizes in S.shingle_sets(b.column(1)):
            for k, s in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
                sets[first + k] = s.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _confirm(it):
    for b in it:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(MUST * both >= OF * (len(p) + len(q) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set").mapInArrow(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id, kept, first for every row of docs.

    kept: the row has its component's smallest doc_id. first: it has the component's smallest (doc_id, text_md5) too, so that of each component one text is first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("text_md5"))
    schema = "doc_id long, text_md5 string, n_shingles long, cls binary, keys binary, sketch binary, bitmap binary"
    sig = materialize(texts.mapInArrow(_signatures, schema), "minhash-signatures")
    known = sig.where(F.col("doc_id").isNotNull() & F.col("cls").isNotNull())
    # What belongs to a set is the same in all its rows.
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "keys", "sketch", "bitmap")]
    reps = known.groupBy("cls").agg(F.min(F.struct("doc_id", "text_md5")).alias("least"), F.count(F.lit(1)).alias("rows"), *same)
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    bands = reps.select("node", F.col("least.doc_id").alias("rep"), "keys").mapInArrow(_band_rows, "band int, key long, node long, rep long")
    # The first document is the likeliest origin of the others, so the star has it as its head.
    head = F.min(F.struct("rep", "node"))["node"].alias("head")
    shared = bands.groupBy("band", "key").agg(head, F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    members = materialize(bands.drop("rep").join(shared, ["band", "key"]), "minhash-members")

    # One text of each class that shares a bucket, dealt by key at every size. Its rows that repeat are together after the join, whose key tells them apart.
    wanted = members.select("node").distinct().join(reps.select("node", "least.*"), "node")
    whole = texts.join(wanted.hint("merge"), ["doc_id", "text_md5"]).dropDuplicates(["doc_id", "text_md5"]).select("node", "text")
    sets = materialize(whole.mapInArrow(_full_sets, "node long, shingles binary"), "minhash-sets")

    words = [F.conv(F.hex(F.substring("sketch", 1 + 8 * k, 8)), 16, -10).cast("long").alias(f"w{k}") for k in range(S.BITS // 64)]
    measure = reps.select("node", "n_shingles", *words)
    left, right = (measure.select([F.col(c).alias(f"{side}_{c}") for c in measure.columns]) for side in ("a", "b"))
    odd = sum((F.bit_count(F.col(f"a_w{k}").bitwiseXOR(F.col(f"b_w{k}"))) for k in range(1, S.BITS // 64)), F.bit_count(F.col("a_w0").bitwiseXOR(F.col("b_w0"))))
    stars = (
        members.where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        .join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))
        .where((odd <= S.most_bits(OF / MUST, SIGMAS)) & (OF * F.col("a_n_shingles") <= MUST * F.col("b_n_shingles")) & (OF * F.col("b_n_shingles") <= MUST * F.col("a_n_shingles")))
        .select("a", "b")
    )
    star_links = materialize(_confirmed(stars, sets), "minhash-star-links")
    first = connected_components(star_links, "minhash-first")

    # Buckets that still hold several components, in units of at most two blocks.
    placed = members.join(first.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left").withColumn("component", F.coalesce("component", "node")).drop("f_node")
    mixed = placed.groupBy("band", "key").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("band", "key")
    units = block_units(placed.join(mixed, ["band", "key"]), "members", "node", BLOCK).join(reps.select("node", "n_shingles", "keys", "sketch", "bitmap"), "node")
    dealt = dealt_by(units.select("band", "key", "lo", "hi", "part", "node", "component", "n_shingles", "keys", "sketch", "bitmap"), ["band", "key", "lo", "hi"], "node")
    open_pairs = dealt.mapInArrow(_open_pairs, "a long, b long")
    more_links = materialize(_confirmed(open_pairs.distinct(), sets), "minhash-more-links")
    discard(members, sets, first)
    joined = connected_components(star_links.unionAll(more_links), "minhash-all")
    discard(star_links, more_links)

    linked = joined.join(reps.select("node", "least"), "node")
    least = linked.groupBy("component").agg(F.min("least").alias("of_all"))
    linked = linked.join(least, "component").select(F.col("node").alias("l_node"), "of_all")
    classes = reps.join(linked, F.col("node") == F.col("l_node"), "left").where((F.col("rows") > 1) | F.col("of_all").isNotNull()).select("cls", F.coalesce("of_all", "least").alias("head"))
    numbered = F.col("doc_id").isNotNull()
    return sig.select("doc_id", "text_md5", "n_shingles", "cls").join(classes, "cls", "left").select(
        "doc_id",
        "text_md5",
        "n_shingles",
        F.when(numbered, F.coalesce("head.doc_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("head.doc_id", "doc_id"), F.lit(True)).alias("kept"),
        F.coalesce(~numbered | (F.struct("doc_id", "text_md5") == F.col("head")), F.lit(True)).alias("first"),
    )


def op7_minhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
