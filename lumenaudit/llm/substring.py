"""Exact substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

A window of `words` words is removed if its words also start in a document with a smaller doc_id. Its fingerprint is built of those of its two
halves (lengths are halved rounding up, so halves may share a word), and so is looked at only if the half that marks it is repeated:

1.  Half windows are thinned by winnowing: a window's mark is the least fingerprint among the half windows inside it. Equal windows have equal
    marks, so only marks, about 2 of `words` / 2 positions, are shuffled, and only those that occur in several documents survive.
2.  Windows whose mark survives are extended to full length and counted: per fingerprint the smallest doc_id. Those that start in a smaller document are removed.
3.  longest_repeats() goes on: windows repeated at one length that another such window continues are extended to 2, 4, ... times `words`, until no
    candidate survives, and tells the last length at which a document repeats a smaller one. What is removed needs no more than full length.

Documents of equal words are one class: the smallest doc_id stands for it, and larger ones lose every word if there are enough for a window. Text is shuffled once, to meet
its surviving marks. Fingerprints of words and windows have 64 bits.

Defined results: a null, empty or blank text has no words; fewer words than a window lose nothing; a null doc_id is neither smaller nor larger than another,
so its words stay and remove none; rows of equal doc_id do not remove each other's words; repeated rows each get the same result; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as R
from .common import discard, materialize, table

WORDS = 50
_rng = np.random.default_rng(12_50)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _half(words: int) -> int:
    return (words + 1) // 2


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of so many words."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * _PLACE[k % len(_PLACE)]
    return R.mix(out)


def doubled(fp: np.ndarray, step: int) -> np.ndarray:
    """Fingerprints of windows longer by step, from those at hand: of i and i + step."""
    return R.mix(fp[:-step] * _LEFT + fp[step:] * _RIGHT) if len(fp) > step else np.empty(0, np.uint64)


def least_of(fp: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    if len(fp) < width:
        return np.empty(0, fp.dtype)
    out, have = fp, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _documents(column):
    """(row, fingerprints of its words, its words joined by one space) of each text."""
    for first, to, raw, bounds in R.text_chunks(column):
        starts = R.word_starts(raw, bounds)
        h = R.fingerprints(raw, starts, R.word_ends(raw, bounds, starts))
        at = np.searchsorted(starts, bounds)
        data = raw.tobytes()
        for k in range(to - first):
            yield first + k, h[at[k] : at[k + 1]], data[bounds[k] : bounds[k + 1]].split()


def _sketches(words: int):
    half = _half(words)

    def read(it):
        for b in it:
            n, sha, marks = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for i, h, text in _documents(b.column(2)):
                n[i] = len(h)
                sha[i] = hashlib.sha256(b" ".join(text)).digest()
                marks[i] = np.unique(least_of(windows(h, half), words - half + 1)).view(np.int64)
            cols = [b.column(0), b.column(1), pa.array(n), pa.array(sha, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "doc_id", "n_words", "words_sha256", "marks"])

    return read


def _candidates(words: int):
    """Full windows whose mark survives: their places and fingerprints."""
    half = _half(words)

    def read(it):
        for b in it:
            marks = b.column(3)
            pos, fp = [None] * b.num_rows, [None] * b.num_rows
            for i, h, _ in _documents(b.column(2)):
                short = windows(h, half)
                alive = np.isin(least_of(short, words - half + 1), np.array(marks[i].values, np.int64).view(np.uint64))
                at = np.flatnonzero(alive)
                pos[i], fp[i] = at.astype(np.int32), doubled(short, words - half)[at].view(np.int64)
            cols = [*b.columns[:3], pa.array(pos, pa.list_(pa.int32())), pa.array(fp, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "doc_id", "text", "pos", "fp"])

    return read


def _kept(words: int):
    """What is left of a text without the words that the windows at pos cover."""

    def read(it):
        for b in it:
            removed, sha = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for i, text in enumerate(b.column(1)):
                own = text.as_py().encode().split()
                at = np.array(b.column(2)[i].values, np.int64)
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + words, -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed[i] = len(own) - int(keep.sum())
                sha[i] = hashlib.sha256(b" ".join(itertools.compress(own, keep.tolist()))).digest()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed), pa.array(sha, pa.binary())], ["node", "n_removed", "kept_sha256"])

    return read


def _repeated(found: DataFrame, key: str) -> DataFrame:
    """key, smallest: of the keys that occur in several documents the smallest doc_id. Written, so that a join on a passage that very many documents share can be split."""
    repeated = found.groupBy(key).agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest").select(key, "smallest")
    return materialize(repeated, f"substring-{key}")


def _levels(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows, one row of each class, its windows of full length whose half is repeated)."""
    if words < 2:
        raise ValueError("a window has two words at least")
    node = F.xxhash64("doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(node.alias("node"), "doc_id", "text")
    schema = "node long, doc_id long, n_words long, words_sha256 binary, marks array<long>"
    sketches = materialize(texts.mapInArrow(_sketches(words), schema), "substring-sketches")
    # One row of the smallest doc_id stands for all documents of equal words.
    long = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= words))
    classes = long.groupBy("words_sha256").agg(F.min(F.struct("doc_id", "node", "marks")).alias("first"))
    classes = materialize(classes.select("words_sha256", "first.*"), "substring-classes")
    # Half length.
    marks = classes.select("node", "doc_id", F.explode("marks").alias("mark"))
    alive = marks.join(_repeated(marks, "mark"), "mark").groupBy("node").agg(F.collect_list("mark").alias("marks"))
    # Full length, where the text meets its surviving marks.
    met = texts.join(alive.hint("merge"), "node").dropDuplicates(["node"]).select("node", "doc_id", "text", "marks")
    full = materialize(met.mapInArrow(_candidates(words), "node long, doc_id long, text string, pos array<int>, fp array<long>"), "substring-windows")
    return sketches, classes, full


def _found(full: DataFrame) -> DataFrame:
    return full.select("node", "doc_id", F.explode(F.arrays_zip("pos", "fp")).alias("w")).select("node", "doc_id", "w.pos", "w.fp")


def substring_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (binary) of each row of docs."""
    sketches, classes, full = _levels(docs, words)
    found = _found(full)
    again = found.join(_repeated(found, "fp"), "fp").where(F.col("smallest") < F.col("doc_id"))
    places = again.groupBy("node").agg(F.collect_list("pos").alias("pos"))
    left = full.select("node", "text").join(places.hint("merge"), "node").select("node", "text", "pos").mapInArrow(_kept(words), "node long, n_removed long, kept_sha256 binary")
    fate = materialize(classes.select("words_sha256", "node", F.col("doc_id").alias("first")).join(left, "node", "left").drop("node"), "substring-fates")
    discard(classes, full)
    out = sketches.drop("marks", "node").join(fate, "words_sha256", "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    own = F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(copy, empty).when(own, F.col("kept_sha256")).otherwise(F.col("words_sha256")).alias("kept_sha256"),
    )


def longest_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, longest (words) of the documents that stand for their words and repeat a window of a smaller one: the largest of words, 2 * words, 4 * words, ... at which they do."""
    sketches, classes, full = _levels(docs, words)
    level, size, reached = materialize(_in_several(_found(full)), "substring-level"), words, None
    while level.limit(1).count():
        here = level.where(F.col("smallest") < F.col("doc_id")).select("node").distinct().withColumn("longest", F.lit(size).cast("long"))
        reached = here if reached is None else reached.unionAll(here)
        rest = level.select(F.col("node").alias("of"), (F.col("pos") - size).alias("from"), F.col("fp").alias("more"))
        longer = level.join(rest, (F.col("node") == F.col("of")) & (F.col("pos") == F.col("from"))).select("node", "doc_id", "pos", F.xxhash64("fp", "more").alias("fp"))
        level, size = materialize(_in_several(longer), "substring-level"), 2 * size
    sizes = sketches.groupBy("node").agg(F.first("n_words").alias("n_words"))
    if reached is None:
        reached = classes.where("false").select("node", F.lit(0).cast("long").alias("longest"))
    longest = reached.groupBy("node").agg(F.max("longest").alias("longest"))
    return longest.join(classes.select("node", "doc_id"), "node").join(sizes, "node").select("doc_id", "n_words", "longest")


def _in_several(found: DataFrame) -> DataFrame:
    return found.join(_repeated(found, "fp"), "fp")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (
  SELECT row, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS s
  FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
least AS (SELECT s, min(doc_id) AS doc_id FROM win GROUP BY s),
gone AS (SELECT w.row, w.i FROM win w JOIN least l ON l.s = w.s WHERE l.doc_id < w.doc_id),
covered AS (SELECT row, list(DISTINCT p) AS ps FROM (SELECT row, unnest(range(i, i + 50)) AS p FROM gone) GROUP BY row),
kept AS (SELECT d.*, CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS ks FROM d LEFT JOIN covered c ON c.row = d.row)
SELECT doc_id, len(ws) AS n_words, len(ws) - len(ks) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))
