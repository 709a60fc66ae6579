"""Joins, aggregations, sampling and ordering over manifests, scores and frames."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .metrics import medians

#: Rows that share a key of near_pairs, or tiles of one media item, that are compared as one block.
BLOCK = 512
#: Blocks of tiles that lie in one part.
PART = 4


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def complete_rows(long_df: DataFrame, media: str, signal: str, score: str, required: list[str]) -> DataFrame:
    """One row per media item that has a score for every required signal, signals as columns."""
    return long_df.where(F.col(signal).isin(*required)).groupBy(media).pivot(signal, required).agg(F.first(score, ignorenulls=True)).dropna(subset=required)


def near_pairs(df: DataFrame, hash_col: str, max_distance: int = 4, blocks: int = 6, different: str | None = None) -> DataFrame:
    """(h1, h2, distance) of distinct 64-bit hashes at most max_distance apart, found exactly.

    The bits are cut into blocks; a pair leaves at least blocks - max_distance of them untouched, so it is equal in the bits of some choice of so many blocks, and is told by
    the first such choice only. Rows of a choice that no other row has go before the join, and a choice that very many hashes share is compared in parts, each with all.
    Both joins are merged: the planner takes exploded rows for as few as the hashes, and would broadcast them through the driver.
    different: only pairs whose rows have more than one value of that column together.
    """
    if blocks <= max_distance:
        raise ValueError("a pair may differ in every block")
    h = F.col(hash_col).alias("h")
    hashes = df.groupBy(h).agg(F.min(different).alias("lo"), F.max(different).alias("hi")) if different else df.select(h).distinct()
    hashes = materialize(hashes.where("h is not null"), "near-hashes")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(masks[k] for k in c)) for c in combinations(range(blocks), blocks - max_distance)]
    keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for n, m in enumerate(choices)])
    keyed = hashes.select("*", F.explode(keys).alias("key")).select("key.*", *hashes.columns)
    shared = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = keyed.join(shared.drop("n").hint("merge"), ["choice", "bits"])
    one = members.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    all_ = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = (x.select("choice", "bits", "part", *[F.col(c).alias(f"{c}{n}") for c in hashes.columns]) for n, x in ((1, one), (2, all_)))
    pairs = a.join(b.hint("merge"), ["choice", "bits", "part"]).where(F.col("h1") < F.col("h2"))
    apart = F.col("h1").bitwiseXOR(F.col("h2"))
    pairs = pairs.withColumn("distance", F.bit_count(apart)).where(F.col("distance") <= max_distance)
    if different:
        pairs = pairs.where(F.least("lo1", "lo2") != F.greatest("hi1", "hi2"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, n) for n, m in enumerate(choices)])
    return pairs.where(F.col("choice") == first).select("h1", "h2", "distance")


def tile_pairs(tiles: DataFrame, media: str, positions: list[str], vector: str, least: float) -> DataFrame:
    """media, best: the largest inner product of two tiles of a media item that are at least so far apart in one of the positions.

    A media item's tiles lie in blocks, dealt by a hash; pairs of blocks are multiplied whole and each unit of them gives one number, so no pair of tiles is ever a row.
    """
    n = tiles.groupBy(media).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    at = [F.col(p).cast("double") for p in positions]
    rows = tiles.join(n, media).select(media, "_blocks", F.pmod(F.xxhash64(*positions), F.col("_blocks")).cast("int").alias("_block"), F.array(*at).alias("at"), F.col(vector).cast("array<double>").alias("v"))
    kind = tiles.schema[media].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        columns = {media: group.column(media).slice(0, 1), "blocks": pa.array([group.column("_blocks")[0].as_py()], pa.int32()), "block": pa.array([group.column("_block")[0].as_py()], pa.int32()), "n": pa.array([len(group)], pa.int32())}
        for c in ("at", "v"):
            columns[c] = pa.array([np.asarray(group.column(c).combine_chunks().flatten(), np.float64).tobytes()], pa.binary())
        return pa.table(columns)

    schema = f"`{media}` {kind}, blocks int, block int, n int, at binary, v binary"
    blocks = materialize(rows.groupBy(media, "_blocks", "_block").applyInArrow(pack, schema), "tile-blocks")
    # Blocks lie in parts of at most PART; every two parts meet in one unit, the key by which they are dealt, so a media item of any size is spread over tasks and a unit holds 2 * PART blocks.
    parts = F.ceil(F.col("blocks") / PART).cast("int")
    own = F.floor(F.col("block") / PART).cast("int")
    units = blocks.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    units = units.select(media, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "n", "at", "v")

    def highest(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        part = group.column("part").to_pylist()
        read = lambda c, k: np.frombuffer(group.column(c)[k].as_py()).reshape(group.column("n")[k].as_py(), -1)
        best = None
        for i in range(len(part)):
            for j in range(i, len(part)):
                if lo == hi or part[i] != part[j]:
                    far = (np.abs(read("at", i)[:, None] - read("at", j)[None]) >= least).any(2)
                    if far.any():
                        top = float((read("v", i) @ read("v", j).T)[far].max())
                        best = top if best is None else max(best, top)
        return pa.table({media: group.column(media).slice(0, 1), "best": pa.array([best], pa.float64())})

    met = units.groupBy(media, "lo", "hi").applyInArrow(highest, f"`{media}` {kind}, best double")
    return met.groupBy(media).agg(F.max("best").alias("best")).where("best is not null")


def with_previous(df: DataFrame, part: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def value_overlap(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """(shared, all_values, overlap): values that every class has, over all values."""
    n = df.select(label).distinct().agg(F.count(F.lit(1)).alias("classes"))
    per = df.groupBy(*values).agg(F.countDistinct(label).alias("_seen_in"))
    return per.join(n, how="inner").agg(F.count_if(F.col("_seen_in") == F.col("classes")).alias("shared"), F.count(F.lit(1)).alias("all_values")).withColumn("overlap", F.when(F.col("all_values") > 0, F.col("shared") / F.col("all_values")).otherwise(0.0))


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def group_profile(df: DataFrame, keys: list[str], sizes: list[str], flags: list[str], kinds: list[str]) -> DataFrame:
    """Count, min/median/max of sizes, shares of flags, and histograms of kinds as maps, per group. Medians are exact, without a buffer of a group's values."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in sizes for name, f in (("min", F.min), ("max", F.max))],
        *[F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in flags],
    )
    for c in sizes:
        m = medians(df, keys, c).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("median").alias(f"median_{c}"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(m, same, "left").drop(*[f"_{k}" for k in keys])
    out = out.select(*keys, "n", *[f"{name}_{c}" for c in sizes for name in ("min", "median", "max")], *[f"share_{c}" for c in flags])
    for k in kinds:
        counts = df.groupBy(*keys, k).count()
        out = out.join(counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "count")))).alias(f"hist_{k}")), keys)
    return out


def counter(df: DataFrame, keys: list[str], pivot: str | None = None, values: list | None = None) -> DataFrame:
    if pivot is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(*keys).pivot(pivot, values).count().fillna(0)


def duplicate_groups(df: DataFrame, hash_col: str, split: str, cls: str) -> DataFrame:
    """One row: groups of equal hashes, rows in them, groups that span splits, groups that span classes."""
    g = df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("splits"), F.countDistinct(cls).alias("classes")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.count_if(F.col("splits") > 1).alias("cross_split"), F.count_if(F.col("classes") > 1).alias("cross_class"))


def examples(df: DataFrame, key: str, item: str, n: int = 5) -> DataFrame:
    """The first n items of each group, in order; ranks bound what is collected."""
    w = Window.partitionBy(key).orderBy(item)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("examples"))


def leakage_examples(df: DataFrame, item: str, hash_col: str, split: str, cls: str, near: DataFrame | None = None, near_hash: str | None = None, n: int = 5) -> DataFrame:
    """kind, pos, items: the first n groups of equal hashes that span splits, the first n that span classes, and the first n near pairs across splits.

    Groups follow each other by their smallest item and show their first n items, joined by commas. near is (h1, h2, ...) over near_hash. Only n groups a kind meet their
    members again (a join with at most 3 n rows), and ranks cut what a group of any size sends.
    """
    groups = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(item).alias("first"), F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("splits"), F.countDistinct(cls).alias("classes")).where("n > 1")
    picked = None
    for kind, column in (("cross_split", "splits"), ("cross_class", "classes")):
        top = groups.where(F.col(column) > 1).orderBy("first", hash_col).limit(n).select(F.lit(kind).alias("kind"), F.col(hash_col).cast("string").alias("group"), F.col(hash_col).alias("h"), "first")
        picked = top if picked is None else picked.unionByName(top)
    members = df.select(F.col(hash_col).alias("h"), item).join(F.broadcast(picked), "h")
    if near is not None:
        pairs = near.orderBy("h1", "h2").limit(n).select(F.lit("near_cross_split").alias("kind"), F.concat_ws("/", "h1", "h2").alias("group"), F.explode(F.array("h1", "h2")).alias("h"))
        firsts = df.select(F.col(near_hash).alias("h"), item).join(F.broadcast(pairs), "h").groupBy("kind", "group", "h").agg(F.min(item).alias(item))
        firsts = firsts.withColumn("first", F.min(item).over(Window.partitionBy("kind", "group")))
        members = members.select("kind", "group", "first", item).unionByName(firsts.select("kind", "group", "first", item))
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "group").orderBy(item))).where(F.col("rank") <= n)
    shown = ranked.groupBy("kind", "group", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("x")))), lambda e: e["x"]), ",").alias("items"))
    return shown.select("kind", F.row_number().over(Window.partitionBy("kind").orderBy("first", "group")).alias("pos"), "items")


def region_means(df: DataFrame, keys: list[str], mask: Column, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(m, F.col(v))), F.lit(0.0)).alias(f"{v}_{side}") for v in values for side, m in (("inside", mask), ("outside", ~mask))])


def block_cv(df: DataFrame, media: list[str], block: list[Column], value: Column) -> DataFrame:
    names = [f"block{i}" for i in range(len(block))]
    means = df.groupBy(*media, *[b.alias(n) for b, n in zip(block, names, strict=True)]).agg(F.avg(value).alias("m"))
    return means.groupBy(*media).agg(F.count(F.lit(1)).alias("blocks"), (F.stddev_pop("m") / (F.avg("m") + 1e-6)).alias("cv"))


def radial_profile(cells: DataFrame, media: str, radius: str, value: str, bins: int = 50) -> DataFrame:
    """media, bin, mean for every bin of each media item: equal widths up to its largest radius, empty ones 0."""
    top = F.max(radius).over(Window.partitionBy(media))
    binned = cells.withColumn("bin", F.least(F.floor(F.col(radius) / (top / bins)), F.lit(bins - 1)).cast("int")).groupBy(media, "bin").agg(F.avg(value).alias("mean"))
    every = cells.select(media).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(binned, [media, "bin"], "left").fillna(0.0, subset=["mean"])


def score_histogram(df: DataFrame, label: str, score: str, bins: int = 25) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(label)))


def top_k(df: DataFrame, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    counts = df.groupBy(*(by or []), key).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.col("n").desc(), key).limit(k)
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), key)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shuffle_key(seed: int, column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string")))


def class_quota(df: DataFrame, cls: str, key: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(cls).orderBy(shuffle_key(seed, key), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shuffle_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(seed, key), key).limit(n)


def hashed_rank(df: DataFrame, by: list[str], order: Column, tie: str, name: str) -> DataFrame:
    """df with the number of each row, from 0, in its group by a hexadecimal hash and then tie: counted over ranges of the hash, so that no task holds a group."""
    h, bucket, before, count = (f"_{name}_{x}" for x in ("hash", "bucket", "before", "count"))
    keyed = df.withColumn(h, order).withColumn(bucket, F.substring(h, 1, 3))
    counts = keyed.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias(count))
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a group
    counts = counts.select(*[F.col(c).alias(f"_{name}_{c}") for c in by], F.col(bucket).alias(f"{bucket}_"), F.coalesce(F.sum(count).over(ahead), F.lit(0)).alias(before))
    same = F.col(bucket) == F.col(f"{bucket}_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{name}_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(h, tie)) - 1
    return keyed.withColumn(count, inside).join(counts, same).select(*df.columns, (F.col(count) + F.col(before)).alias(name))


def stratified_folds(df: DataFrame, cls: str, key: str, k: int, seed: int) -> DataFrame:
    """df with fold: the rows of each class dealt in turn, in hash order, to k folds, or to as many as the smallest class has rows."""
    smallest = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.min("n"), F.lit(k)).alias("_folds"))
    ranked = hashed_rank(df, [cls], shuffle_key(seed, key), key, "_rank")
    return ranked.join(smallest, how="inner").withColumn("fold", (F.col("_rank") % F.col("_folds")).cast("int")).drop("_rank", "_folds")  # one row of a number


def largest_box(df: DataFrame, media: str, area: Column, item: str) -> DataFrame:
    return df.groupBy(media).agg(F.max_by(F.col(item), F.struct(area, -F.col(item))).alias(item), F.max(area).alias("area"))


def history_page(df: DataFrame, search: str | None, name: str, equal: dict[str, str], newest: str, key: str, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(page, one row with the total): a top-n scan in the order newest first, then by key."""
    if search:
        df = df.where(F.col(name).ilike(f"%{search}%"))
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    page = df.orderBy(F.col(newest).desc(), F.col(key)).offset(max(0, offset)).limit(min(200, max(1, limit)))
    return page, df.agg(F.count(F.lit(1)).alias("total"))
