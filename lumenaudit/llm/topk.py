"""Exact top-k search by integer inner product with block-at-a-time pruning.

Vectors lie in document-range blocks, stretches of rows in the order of vec_id; a block keeps its forward index (the integer vectors) and each term's extremes. For a query,
blocks are taken in the order of their summed term maxima, sum over terms of max(q*min, q*max), until that bound falls below the query's kth score.
Shards, rows of blocks, meet tiles of queries: a shard's extremes tell first, without its vectors, which tiles hold a query that it can still serve.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; one of another size than the others' scores by the
terms both have; an integer component beyond +-sqrt(2^62 / terms), 2^28 for 64 terms, counts as that, so that scores stay within 64 bits; ties go to the smaller vec_id; repeated rows are candidates each; a query's own row is any with its vec_id; queries of one vec_id share one list of k, the best of
them all; a table without vectors or queries gives an empty result; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Vectors of a block and of a shard of blocks, and queries of a tile. A shard and a tile meet in one Arrow row; they are of one size, so that much is computed for what is moved.
#: LIST: shards whose extremes lie in one row.
BLOCK, SHARD, TILE, LIST = 256, 4_096, 4_096, 4_096
_LOWEST = np.iinfo(np.int64).min


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of every whole vector, held within +-sqrt(2^62 / terms), so that no inner product leaves 64 bits."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    most = F.floor(F.sqrt(F.lit(float(2**62)) / F.greatest(F.size(x), F.lit(1)))).cast("double")
    level = lambda e: F.greatest(-most, F.least(most, F.lit(float(scale)) * e.cast("double")))
    return embeddings.select("vec_id", "embedding").where(x.isNotNull() & finite & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda e: F.floor(level(e)).cast("long")).alias("v"))


def _matrix(rows: pa.Array) -> np.ndarray:
    """Rows of integers as a matrix, short ones filled with 0: a term that a vector lacks adds nothing."""
    sizes = np.diff(np.asarray(rows.offsets))
    out = np.zeros((len(rows), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = np.asarray(rows.flatten())
    return out


def _matrix_of(rows: list[bytes]) -> np.ndarray:
    return _matrix(pa.array([np.frombuffer(r, np.int64) for r in rows], pa.list_(pa.int64())))


def _packed(m: np.ndarray) -> tuple[bytes, int]:
    """(the matrix in the smallest integers that hold it, their width in bytes)"""
    most = int(np.abs(m).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    return m.astype(kind).tobytes(), np.dtype(kind).itemsize


def _unpack(flat: bytes, wide: int, n: int) -> np.ndarray:
    return np.frombuffer(flat, f"<i{wide}").reshape(n, -1).astype(np.int64)


_SHARDS = "shard long, n int, wide int, ids binary, flat binary, low binary, high binary"


def shards_of(vectors: DataFrame, size: int) -> DataFrame:
    """shard, n, wide, ids, flat, low, high: stretches of at most size rows in the order of vec_id as binary columns, with each term's extremes.

    The range's second key lets a vec_id that very many rows share go to several partitions; a partition gives as many shards as it needs.
    """
    n = max(1, -(-vectors.count() // size))

    def pack(it):
        part, seq, held = TaskContext.get().partitionId(), 0, None

        def one(rows: pa.Table) -> pa.RecordBatch:
            m = _matrix(rows.column(1).combine_chunks())
            flat, wide = _packed(m)
            columns = [[(part << 32) + seq], [len(m)], [wide], [rows.column(0).to_numpy().astype(np.int64).tobytes()], [flat], [m.min(0).tobytes()], [m.max(0).tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SHARDS.split(", ")])

        for b in it:
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            while len(held) > size:
                yield one(held.slice(0, size))
                held, seq = held.slice(size), seq + 1
        if held is not None and len(held):
            yield one(held)

    return vectors.select("vec_id", "v", F.xxhash64("v").alias("h")).repartitionByRange(n, "vec_id", "h").sortWithinPartitions("vec_id", "h").select("vec_id", "v").mapInArrow(pack, _SHARDS)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries x blocks) summed term maxima; terms that either side lacks add nothing."""
    w = min(q.shape[1], low.shape[1])
    return np.maximum(q[:, :w], 0) @ high[:, :w].T + np.minimum(q[:, :w], 0) @ low[:, :w].T


def _best(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller place."""
    if score.shape[1] <= k:
        return score, place
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
    over, tie = score > kth[:, None], score == kth[:, None]
    room = k - over.sum(1)
    rows = np.flatnonzero(tie.sum(1) > room)  # which of the ties
    if len(rows):
        order = np.argsort(np.where(tie[rows], place[rows], np.iinfo(np.int64).max), axis=1, kind="stable")
        first = np.arange(score.shape[1])[None] < room[rows, None]
        tie[rows[:, None], order] &= first
    keep = np.nonzero(over | tie)
    return score[keep].reshape(len(score), k), place[keep].reshape(len(score), k)


def search(qid: np.ndarray, q: np.ndarray, did: np.ndarray, d: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Top k of one shard for a tile of queries: (query row, vec_id, score), and how many (query, block) pairs were scored. floor: a score that the kth is known to reach."""
    heads = np.arange(0, len(d), BLOCK)
    bound = bounds(q, np.minimum.reduceat(d, heads), np.maximum.reduceat(d, heads))
    order = np.argsort(-bound, axis=1, kind="stable")
    w = min(q.shape[1], d.shape[1])
    # Integer products below 2^53 are exact in doubles, whose matrix product is fast.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * w < 2**53
    qf, df = (x[:, :w].astype(np.float64 if exact else np.int64) for x in (q, d))
    score, place = np.full((len(q), k), _LOWEST), np.full((len(q), k), len(d), np.int64)  # places are in the order of vec_id
    theta, alive, scored = floor.copy(), np.arange(len(q)), 0
    for step in range(len(heads)):
        # A block whose bound equals the kth score may still hold a tie with a smaller vec_id.
        alive = alive[bound[alive, order[alive, step]] >= theta[alive]]
        for b in np.unique(order[alive, step]):
            rows = alive[order[alive, step] == b]
            at = np.arange(heads[b], min(heads[b] + BLOCK, len(d)))
            scored += len(rows)
            new = (qf[rows] @ df[at].T).astype(np.int64)
            new[(new < theta[rows, None]) | (did[at][None] == qid[rows, None])] = _LOWEST
            some = (new > _LOWEST).any(1)
            rows, new = rows[some], new[some]
            if len(rows):
                score[rows], place[rows] = _best(np.hstack([score[rows], new]), np.hstack([place[rows], np.broadcast_to(at, new.shape)]), k)
                theta[rows] = np.maximum(theta[rows], score[rows].min(1))
    row, col = np.nonzero(score > _LOWEST)
    return row, did[place[row, col]], score[row, col], scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = SHARD, tile_rows: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, v (integers).

    Every tile of queries searches one shard first, whose kth score is a floor for the kth over all; the shards' extremes then tell which others can reach it.
    """
    shards = materialize(shards_of(vectors, block_rows), "topk-shards")
    tiles = materialize(shards_of(queries, tile_rows).toDF("tile", "q_n", "q_wide", "q_ids", "q_flat", "q_low", "q_high"), "topk-tiles")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    n_shards = shards.count()
    if not n_shards:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def found_in(it):
        for b in it:
            for r in b.to_pylist():
                q, d = _unpack(r["q_flat"], r["q_wide"], r["q_n"]), _unpack(r["flat"], r["wide"], r["n"])
                qid, did = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                floor = np.full(len(q), _LOWEST) if r["floor"] is None else np.frombuffer(r["floor"], np.int64)
                row, vec, score, _ = search(qid, q, did, d, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(row), r["tile"]), row, qid[row], vec, score)], ["tile", "row", "query_id", "vec_id", "score"])

    schema = "tile long, row long, query_id long, vec_id long, score long"
    numbered = shards.select("shard").withColumn("i", F.row_number().over(Window.orderBy("shard")) - 1)  # one row a shard
    homes = tiles.select("tile", F.pmod(F.xxhash64("tile"), F.lit(n_shards)).cast("int").alias("i")).join(numbered, "i").select("tile", "shard")
    homes = materialize(homes, "topk-homes")
    first = homes.join(tiles, "tile").join(shards, "shard").withColumn("floor", F.lit(None).cast("binary"))
    first = materialize(first.mapInArrow(found_in, schema), "topk-first")

    def floors(group: pa.Table) -> pa.Table:
        """The kth score of each row of a tile, of those that have k."""
        row, score = group.column("row").to_numpy(), group.column("score").to_numpy()
        out = np.full(int(group.column("q_n")[0].as_py()), _LOWEST)
        n, least = np.bincount(row, minlength=len(out)), np.full(len(out), np.iinfo(np.int64).max)
        np.minimum.at(least, row, score)
        out[n >= k] = least[n >= k]
        return pa.table({"tile": [group.column("tile")[0].as_py()], "floor": pa.array([out.tobytes()], pa.binary())})

    known = first.select("tile", "row", "score").join(tiles.select("tile", "q_n"), "tile").groupBy("tile").applyInArrow(floors, "tile long, floor binary")
    floored = materialize(tiles.join(known, "tile", "left"), "topk-floors")

    def extremes(group: pa.Table) -> pa.Table:
        """The extremes of up to LIST shards as two matrices: a few hundred bytes a shard."""
        low, high = (_matrix_of(group.column(c).to_pylist()) for c in ("low", "high"))
        return pa.table({"list": [group.column("list")[0].as_py()], "shards": pa.array([group.column("shard").to_numpy().tobytes()], pa.binary()), "lows": pa.array([low.tobytes()], pa.binary()), "highs": pa.array([high.tobytes()], pa.binary())})

    def reachable(it):
        """(tile, shard) where some query's bound by the shard's extremes is no lower than its floor."""
        for b in it:
            for r in b.to_pylist():
                q, shard = _unpack(r["q_flat"], r["q_wide"], r["q_n"]), np.frombuffer(r["shards"], np.int64)
                floor = np.full(len(q), _LOWEST) if r["floor"] is None else np.frombuffer(r["floor"], np.int64)
                low, high = (np.frombuffer(r[c], np.int64).reshape(len(shard), -1) for c in ("lows", "highs"))
                open_ = np.zeros(len(shard), bool)
                for s in range(0, len(q), 512):
                    open_ |= (bounds(q[s : s + 512], low, high) >= floor[s : s + 512, None]).any(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(open_.sum()), r["tile"])), pa.array(shard[open_])], ["tile", "shard"])

    listed = numbered.join(shards.select("shard", "low", "high"), "shard").select(F.expr(f"i div {LIST}").alias("list"), "shard", "low", "high")
    lists = materialize(listed.groupBy("list").applyInArrow(extremes, "list long, shards binary, lows binary, highs binary"), "topk-extremes")
    met = floored.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_shards - 1) // LIST)))).join(lists, "list")
    pairs = materialize(met.mapInArrow(reachable, "tile long, shard long").join(homes, ["tile", "shard"], "left_anti"), "topk-pairs")
    rest = materialize(pairs.join(floored, "tile").join(shards, "shard").mapInArrow(found_in, schema), "topk-rest")
    discard(shards, tiles, floored, lists, pairs, homes)
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(integer_vectors(table(spark, sf_dir, "embeddings")), "topk-vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
