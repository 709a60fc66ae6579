"""Exact ranking metrics by prefix sums over distinct scores, per group.

A prefix sum has two levels: totals of ranges of the score, of which there are at most RANGES a group, and a running sum inside each range. So no task holds all scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: From which 32-bit number on a Poisson variable of mean 1 is at least 1, 2, ..., 12; and the step between resamples.
POISSON = np.array([math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)], np.uint64)
STEP = 0x9E3779B1
#: Ranges of a score that prefix sums are taken over.
RANGES = 128
#: Rows of a block of draws at least, blocks at most (one more where they do not divide), and draws of one part of a resample.
BLOCK, BLOCKS, PART = 1024, 4096, 1 << 22

def _distinct(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score: what the windows below order is this, not the rows."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def _ranged(df: DataFrame, score: str) -> list[float]:
    """Bounds between ranges of the score with about equal numbers of rows: at most RANGES - 1 numbers, whatever the table's size."""
    found = df.agg(F.percentile_approx(F.col(score).cast("double"), [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0]
    return sorted({float(x) for x in found or [] if x == x})


def _prefix_sums(d: DataFrame, by: list[str], cuts: list[float]) -> DataFrame:
    """d (by, s, pos, neg) with pos_below, neg_below, the sums over smaller scores, and p, q, the sums over the group."""
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("s").cast("double")))
    d = d.withColumn("_range", bucket)
    group = Window.partitionBy(*[f"_{c}" for c in by])
    ahead = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), "_pos", "_neg")
    totals = totals.select(*[f"_{c}" for c in by], "_at", *[F.coalesce(F.sum(f"_{x}").over(ahead), F.lit(0)).alias(f"_{x}_ahead") for x in ("pos", "neg")], F.sum("_pos").over(group).alias("p"), F.sum("_neg").over(group).alias("q"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inner = d.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_{x}_inside") for x in ("pos", "neg")])
    below = [(F.col(f"_{x}_inside") + F.col(f"_{x}_ahead")).alias(f"{x}_below") for x in ("pos", "neg")]
    return inner.join(totals, same).select(*by, "s", "pos", "neg", *below, "p", "q")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the exact median of each group, the mean of the two middle values where their number is even; null values do not count.

    Rows are counted by distinct value first. Totals of ranges tell which range holds a group's middle, and only that range (two at most) is put in order.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    cuts = F.array(*[F.lit(c) for c in _ranged(df, value)]).cast("array<double>")
    d = d.withColumn("_range", F.size(F.filter(cuts, lambda c: c < F.col("s").cast("double"))))
    group = Window.partitionBy(*[f"_{c}" for c in by])
    ahead = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*by, "_range").agg(F.sum("c").alias("_c")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), "_c")
    totals = totals.select("*", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_c").over(group).alias("_n"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = totals.where((F.col("_ahead") <= high) & (low < F.col("_ahead") + F.col("_c"))).drop("_c")
    same = F.col("_range").eqNullSafe(F.col("_at"))  # a plain equality lets the optimiser carry the lambda above to the side without s, which fails
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_ahead") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    found = d.join(middle, same).withColumn("_below", below)
    holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("c"))
    return found.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("s"))) + F.max(F.when(holds(high), F.col("s")))).cast("double") / 2).alias("median"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """auc with ties at half; null where a group has one class."""
    by = by or []
    d = _prefix_sums(_distinct(df, label, score, by), by, _ranged(df, score) if cuts is None else cuts)
    return d.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u")).select(
        *by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc")
    )


def _curve(df: DataFrame, label: str, score: str, by: list[str], cuts: list[float] | None) -> DataFrame:
    d = _prefix_sums(_distinct(df, label, score, by), by, _ranged(df, score) if cuts is None else cuts).where("p > 0 and q > 0")
    return d.withColumn("tp", F.col("p") - F.col("pos_below")).withColumn("fp", F.col("q") - F.col("neg_below"))


def roc_pr_curve(df: DataFrame, label: str, score: str, by: list[str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """A point for each distinct score, from the highest: fpr, tpr (recall), precision."""
    by = by or []
    return _curve(df, label, score, by, cuts).select(*by, F.col("s").alias("threshold"), "tp", "fp", (F.col("fp") / F.col("q")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Sum over distinct scores of the precision there times the recall that it adds."""
    by = by or []
    gained = F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _curve(df, label, score, by, cuts).groupBy(*by).agg(F.sum(gained).alias("average_precision"))


def youden_threshold(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """The highest threshold of the largest tpr - fpr; infinite where no score beats taking nothing."""
    by = by or []
    c = roc_pr_curve(df, label, score, by).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    best = c.groupBy(*by).agg(F.max(F.struct("j", "threshold")).alias("best"))
    return best.select(*by, F.when(F.col("best.j") > 0, F.col("best.threshold")).otherwise(F.lit(float("inf"))).alias("threshold"), F.greatest(F.col("best.j"), F.lit(0.0)).alias("j"))


def headline(df: DataFrame, label: str, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Counts, rates, accuracy, precision, recall, F1 (0 on zero division), AUC and average precision, per group."""
    by = by or []
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("n_fake"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
        F.avg(F.when(y, F.col(score))).alias("mean_fake"), F.avg(F.when(~y, F.col(score))).alias("mean_real"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    base = base.select(
        "*", ((tp + F.col("tn")) / n).alias("accuracy"), (F.greatest(F.col("n_fake"), n - F.col("n_fake")) / n).alias("majority"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((tp + fp) / n).alias("predicted_rate"),
    )
    cuts = _ranged(df, score)
    auc, ap = roc_auc(df, label, score, by, cuts).select(*by, "auc"), average_precision(df, label, score, by, cuts)
    if not by:
        return base.join(auc, how="inner").join(ap, how="left")
    return base.join(auc, by, "left").join(ap, by, "left")


def signal_ablation(long_df: DataFrame, signal: str, label: str, score: str, least: int = 20) -> DataFrame:
    """Per signal, over rows that have it: AUC, its direction and the AUC either way; a note where rows are too few or of one class."""
    n = long_df.where(F.col(score).isNotNull()).groupBy(signal).agg(F.count(F.lit(1)).alias("n"))
    auc = roc_auc(long_df, label, score, [signal])
    note = F.when(F.col("n") < least, "too few rows").when(F.col("auc").isNull(), "one class")
    usable = F.when(F.col("note").isNull(), F.col("auc"))
    return n.join(auc, signal, "left").withColumn("note", note).select(signal, "n", usable.alias("auc"), F.when(usable.isNotNull(), F.when(usable < 0.5, "INVERTED").otherwise("OK")).alias("direction"), F.when(usable < 0.5, 1 - usable).otherwise(usable).alias("flipped_auc"), "note")


def generator_recall(df: DataFrame, generator: str, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(generator).isNotNull() & (F.col(generator).cast("string") != "")).groupBy(generator).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) >= threshold).cast("double")).alias("recall"), F.avg(score).alias("mean_score"))


def multiplicities(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row is drawn in each replicate (rows x replicates): Poisson with mean 1, from a hash of the key and the replicate's number."""
    h = ((keys ^ (keys >> np.int64(32))) & np.int64(0xFFFFFFFF)).astype(np.uint32)
    return np.searchsorted(POISSON, _scrambled(_scrambled(h)[:, None] + (np.arange(replicates, dtype=np.uint32) * np.uint32(STEP) + np.uint32(seed))[None]), "right")


def _scrambled(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((16, 0x7FEB352D), (15, 0x31848BAB), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h


def bootstrap_auc(df: DataFrame, label: str, score: str, key: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """replicates, low, high: how many resamples have both classes, and the 2.5 and 97.5 percentiles of their AUC.

    Each row's number of copies in each resample follows from its key (a whole number, one a row) alone, so no draw is ever joined or shuffled: rows are dealt once by range of
    the score, their copies are made where they are summed, and each range gives one row a resample. Rows of a score that repeats within a batch are summed before they are dealt.
    """
    own = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.col(key).cast("long").alias("k"))
    cuts = _ranged(own, "s")

    def summed(it):
        """Rows as they are; of scores with more rows than resamples the sums."""
        for b in it:
            s, y, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "y", "k"))
            order = np.argsort(s, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]])) if len(s) else np.empty(0, np.int64)
            counts = np.diff(np.append(heads, len(s)))
            many = np.repeat(counts > replicates, counts)
            single = order[~many]
            yield pa.RecordBatch.from_arrays([pa.array(s[single]), pa.array(y[single]), pa.array(k[single]), pa.nulls(len(single), pa.binary())], ["s", "y", "k", "w"])
            for a, n in zip(heads[counts > replicates].tolist(), counts[counts > replicates].tolist(), strict=True):
                for c in (0, 1):
                    at = order[a : a + n][y[order[a : a + n]] == c]
                    w = sum((multiplicities(k[at[i : i + 4096]], replicates, seed).sum(0) for i in range(0, len(at), 4096)), np.zeros(replicates, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(s[at[:1]]), pa.array(y[at[:1]]), pa.array(k[at[:1]]), pa.array([w.astype(np.int64).tobytes()] * len(at[:1]), pa.binary())], ["s", "y", "k", "w"])

    def ranked(it):
        """Of each range and resample: positives, negatives, and twice the pairs of both inside it, ties at half."""
        here, below, twice, total, last = None, None, None, None, None
        tie = np.zeros((2, replicates), np.int64)

        def closed():
            nonlocal twice, below
            twice += tie[1] * (2 * below + tie[0])
            below += tie[0]
            tie[:] = 0

        def out():
            closed()
            rep = np.arange(replicates)
            return pa.RecordBatch.from_arrays([pa.array(np.full(replicates, here)), pa.array(rep), *(pa.array(x) for x in (total[1], total[0], twice))], ["range", "rep", "pos", "neg", "twice"])

        for b in it:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                s, y, k, r = (part.column(c).to_numpy(zero_copy_only=False) for c in ("s", "y", "k", "range"))
                w = multiplicities(k, replicates, seed)
                for i in np.flatnonzero(part.column("w").is_valid().to_numpy(zero_copy_only=False)):
                    w[i] = np.frombuffer(part.column("w")[i].as_py(), np.int64)
                heads = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]))
                at = [np.add.reduceat(np.where((y == c)[:, None], w, 0), heads, axis=0) for c in (0, 1)]
                for g, i in enumerate(heads.tolist()):
                    if here != r[i]:
                        if here is not None:
                            yield out()
                        here, last = int(r[i]), s[i]
                        below, twice, total = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64), np.zeros((2, replicates), np.int64)
                    elif last != s[i]:
                        closed()
                        last = s[i]
                    for c in (0, 1):
                        tie[c] += at[c][g]
                        total[c] += at[c][g]
        if here is not None:
            yield out()

    dealt = own.mapInArrow(summed, "s double, y int, k long, w binary").withColumn("range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("s"))))
    parts = dealt.repartition("range").sortWithinPartitions("range", "s").mapInArrow(ranked, "range long, rep long, pos long, neg long, twice long")
    ahead = Window.partitionBy("rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pairs = parts.withColumn("twice", F.col("twice") + 2 * F.col("pos") * F.coalesce(F.sum("neg").over(ahead), F.lit(0)))
    auc = pairs.groupBy("rep").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum("twice").alias("u")).where("p > 0 and q > 0").select((F.col("u") / 2 / (F.col("p") * F.col("q"))).alias("auc"))
    return auc.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))


def drawn(replicate: np.ndarray | int, stage: int, part: int, j: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit number of draw j of a part of a replicate, from a hash of these alone."""
    word = lambda x: (np.atleast_1d(x) & 0xFFFFFFFF).astype(np.uint32)
    own, at = word(4 * np.atleast_1d(replicate) + 2 * stage + seed), _scrambled(word(j))
    high, low = (_scrambled(at + _scrambled(_scrambled(word(part)) + _scrambled(own + np.uint32(k)))).astype(np.uint64) for k in (0, 1))
    return (high << np.uint64(32)) | low


def bootstrap_auc_drawn(df: DataFrame, label: str, score: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """replicates, low, high: how many resamples have both classes, and the 2.5 and 97.5 percentiles of their AUC. A resample is n draws with replacement from the n rows that have both
    label (0 or 1) and score.

    Rows are placed in the order of score and label, and places are cut into blocks. Each draw picks a block by its size, then a place inside the block, which is a draw from all rows.
    The first step is summed where it is made, and only how many draws each block has in each resample is dealt to the blocks; the second is made there, so no draw is shuffled.
    """
    own = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    n = own.count()
    size = max(BLOCK, -(-n // BLOCKS))
    blocks, parts = max(1, -(-n // size)), -(-n // PART)

    def picked(it):
        """How many draws of each part of a resample pick each block."""
        for b in it:
            for item in b.column("id").to_pylist():
                rep, part = divmod(item, parts)
                c = np.zeros(blocks, np.int64)
                for a in range(0, min(PART, n - part * PART), 1 << 18):
                    j = np.arange(a, min(a + (1 << 18), PART, n - part * PART))
                    c += np.bincount((drawn(rep, 0, part, j, seed) % np.uint64(n) // np.uint64(size)).astype(np.int64), minlength=blocks)
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), rep)), pa.array(c[at])], ["block", "rep", "c"])

    def ranked(cells: pa.Table, draws: pa.Table) -> pa.Table:
        """Of a block and each resample: positives and negatives of its first and its last score, which other blocks may share, and of those between, with twice the pairs of both, ties at half."""
        block, first, neg, pos, s = (cells.column(c).to_numpy() for c in ("block", "first", "neg", "pos", "s"))
        order, block = np.argsort(first), int(block[0])
        rows = min(size, n - block * size)
        ends = np.stack([first + neg, first + neg + pos], 1)[order].ravel() - block * size
        bounds, s = np.concatenate([[0], np.clip(ends, 0, rows)]), s[order]
        counts = np.zeros(replicates, np.int64)
        np.add.at(counts, draws.column("rep").to_numpy(), draws.column("c").to_numpy())
        found = []
        step = max(1, (1 << 20) // rows)
        for a in range(0, replicates, step):
            c = counts[a : a + step]
            r = np.repeat(np.arange(len(c)), c)
            j = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
            at = (drawn(a + r, 1, block, j, seed) % np.uint64(rows)).astype(np.int64)
            below = np.zeros((len(c), rows + 1), np.int64)
            np.cumsum(np.bincount(r * rows + at, minlength=len(c) * rows).reshape(len(c), rows), 1, out=below[:, 1:])
            each = np.diff(below[:, bounds], axis=1)
            q, p = each[:, 0::2], each[:, 1::2]
            for i in {0, len(s) - 1}:
                found.append((a + np.arange(len(c)), np.full(len(c), s[i]), p[:, i], q[:, i], np.full(len(c), None)))
            if len(s) > 2:
                p, q = p[:, 1:-1], q[:, 1:-1]
                found.append((a + np.arange(len(c)), np.full(len(c), s[1]), p.sum(1), q.sum(1), (p * (2 * (np.cumsum(q, 1) - q) + q)).sum(1)))
        return pa.concat_tables(pa.table([pa.array(x, kind) for x, kind in zip(f, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["rep", "s", "pos", "neg", "twice"]) for f in found)

    cells = _prefix_sums(_distinct(own, "y", "s", []), [], _ranged(own, "s")).select("s", "pos", "neg", (F.col("pos_below") + F.col("neg_below")).alias("first"))
    cells = cells.withColumn("block", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"(first + pos + neg - 1) div {size}"))))
    draws = df.sparkSession.range(replicates * parts).mapInArrow(picked, "block long, rep long, c long")
    # The numbers of partitions are given, since blocks have few bytes but much to do.
    sums = cells.repartition(blocks, "block").groupBy("block").cogroup(draws.repartition(blocks, "block").groupBy("block")).applyInArrow(ranked, "rep long, s double, pos long, neg long, twice long")
    sums = sums.repartition("rep").groupBy("rep", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("twice").alias("twice"))
    ahead = Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    pairs = sums.withColumn("twice", F.coalesce("twice", F.col("pos") * F.col("neg")) + 2 * F.col("pos") * F.coalesce(F.sum("neg").over(ahead), F.lit(0)))
    auc = pairs.groupBy("rep").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum("twice").alias("u")).where("p > 0 and q > 0").select((F.col("u") / 2 / (F.col("p") * F.col("q"))).alias("auc"))
    return auc.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
