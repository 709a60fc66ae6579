"""Ranked lexical search by NRA: sequential, impact-sorted reads with score intervals, and no other access to a list.

One pass over the documents keeps, of each, the terms that any query asks for. Its rows lie in segments of at most SEGMENT documents; a task turns a segment into
one list per term, sorted by falling impact. A query reads its lists in step, all postings whose weighted impact reaches a falling level; a
document's score is then at least the sum of what was read of it (lower), and at most that plus, for each list that has not shown it, the
list's next impact (upper). No new document can enter once the sum of all next impacts is below the kth lower score or the floor; from then on
only documents whose upper score reaches that bound are followed, and reads go on until lower and upper of each of these
meet, so that membership, ties and scores are final. Rounds over growing shares of the documents raise the floors: the kth score so far of each query,
below which later segments need not look.

Queries are taken in blocks of at most BLOCK_TERMS pairs of query and term (or one query), read and broadcast one block at a time, each with its pass over the documents.

Defined results: a null or empty text, of a document or a query, has no terms; a query without terms finds nothing; repeated documents are ranked each; equal scores go by
ascending doc_id, a null doc_id last, equal rows in any order; queries of one item_id are separate rows with results each; an empty table on either side gives an empty result; columns other than
doc_id, text and item_id are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R
from .common import discard, materialize, table

#: ASCII that is no letter or digit separates terms; the formula's constants.
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:0x80] = [not chr(c).isalnum() for c in range(0x80)]
TOP_TF, PER_TF, PER_LENGTH, SLOPE, WEIGHT = 1_000_000_000, 1000, 8, 75, 1000
#: Documents of a segment, pairs of query and term of a block (16 MB), shares of the documents by which rounds end, and the fall of the level between reads.
SEGMENT, BLOCK_TERMS, SHARES, FALL = 16_384, 1 << 20, (1 / 64, 1 / 8, 1.0), 0.7
#: Bytes that tell which document of a segment a query's lists have shown.
SEEN = 1 << 27


def _terms(column):
    """(first row, row of each term, fingerprint) of some texts."""
    for first, _, raw, bounds in R.text_chunks(column, 4 << 20):
        data = R.lower_ascii(raw)
        starts = R.word_starts(data, bounds, _OUTSIDE)
        ends = R.word_ends(data, bounds, starts, _OUTSIDE)
        yield first, np.searchsorted(bounds, starts, "right") - 1, R.fingerprints(data, starts, ends, _OUTSIDE), len(bounds) - 1


def _query_terms(it):
    for b in it:
        for first, row, h, _ in _terms(b.column(1)):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.append(heads, len(h)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row[heads])), pa.array(h[heads].view(np.int64)), pa.array(times)], ["query", "term", "times"])


def _postings(wanted):
    """doc_id, n (all terms), at (numbers of the wanted terms), tf of each document."""

    def read(it):
        known = wanted.value
        for b in it:
            for first, row, h, rows in _terms(b.column(1)):
                n = np.bincount(row, minlength=rows)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                both, tf = np.unique(row[hit] * np.int64(max(len(known), 1)) + at[hit], return_counts=True)
                row, at = both // max(len(known), 1), both % max(len(known), 1)
                offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array(n), *lists], ["doc_id", "n", "at", "tf"])

    return read


class Segment:
    """Documents as impact-sorted lists: of term t, docs[starts[t]:starts[t + 1]] with falling parts."""

    def __init__(self, doc: np.ndarray, at: np.ndarray, part: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((-part, at))
        self.docs, self.parts, self.n = doc[order], part[order], n_docs
        self.starts = np.searchsorted(at[order], np.arange(n_terms + 1))


def nra(segment: Segment, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, exact scores, postings read) of all that reach the kth score and the floor, ties included; scores above 0."""
    some = (weights > 0) & (segment.starts[terms + 1] > segment.starts[terms])
    terms, weights = terms[some], weights[some]
    place, end = segment.starts[terms].copy(), segment.starts[terms + 1]
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    lower, seen = np.zeros(segment.n, np.int64), np.zeros((segment.n, len(terms)), bool)
    ahead = weights * segment.parts[place]
    followed, read, level = None, 0, float(ahead.max())
    while True:
        for t in np.flatnonzero((place < end) & (ahead >= level)):
            # The list falls: as far as its weighted parts reach the level.
            part = segment.parts[place[t] : end[t]]
            stop = int(np.searchsorted(-part, -(level / weights[t]), "right"))
            stop = max(stop, 1)
            d = segment.docs[place[t] : place[t] + stop]
            lower[d] += weights[t] * part[:stop]
            seen[d, t] = True
            place[t] += stop
            read += stop
            ahead[t] = weights[t] * segment.parts[place[t]] if place[t] < end[t] else 0
        if followed is None:
            bound = max(floor, int(np.partition(lower, -k)[-k]) if segment.n >= k else 0, 1)
            if ahead.sum() < bound:  # no document that no list has shown can enter
                followed = np.flatnonzero(lower + ahead.sum() >= bound)
        if followed is not None:
            low = lower[followed]
            upper = low + (~seen[followed]) @ ahead
            bound = max(bound, int(np.partition(low, -k)[-k]) if len(low) >= k else 0)
            stays = upper >= bound
            if (upper[stays] == low[stays]).all():
                return followed[stays], low[stays], read
            followed = followed[stays]
        level = min(level * FALL, float(ahead.max()))


def _segments(it):
    """Rows in groups of at most SEGMENT."""
    held, rows = [], 0
    for b in it:
        while b.num_rows:
            part = b.slice(0, SEGMENT - rows)
            b = b.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == SEGMENT:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(block, k: int):
    """query, doc_id, score: of each query what a segment can add to its best k."""

    def search(it):
        starts, terms, weights, floors, n_terms, n_docs, n_words = block.value
        for rows in _segments(it):
            doc_ids = rows.column("doc_id").combine_chunks()
            at, tf = (rows.column(c).combine_chunks() for c in ("at", "tf"))
            doc = np.repeat(np.arange(len(rows)), np.diff(at.offsets.to_numpy()))
            at, tf = (x.flatten().to_numpy().astype(np.int64) for x in (at, tf))
            n = rows.column("n").to_numpy()
            m = 100 - SLOPE + (SLOPE * n * n_docs) // n_words
            part = (TOP_TF * tf) // (PER_TF * tf + PER_LENGTH * m[doc])
            segment = Segment(doc, at, part, len(rows), n_terms)
            order = np.argsort(doc_ids.fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable")
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows))
            for q in range(len(starts) - 1):
                own = slice(starts[q], starts[q + 1])
                step = max(1, SEEN // int(starts[q + 1] - starts[q]))
                if step >= len(rows):
                    d, score, _ = nra(segment, terms[own], weights[own], k, int(floors[q]))
                else:  # a query of very many terms sees the segment in parts
                    cuts = np.searchsorted(doc, np.arange(0, len(rows) + step, step))
                    parts = [(i * step, slice(a, b)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                    each = [(lo, nra(Segment(doc[x] - lo, at[x], part[x], step, n_terms), terms[own], weights[own], k, int(floors[q]))) for lo, x in parts]
                    d, score = np.concatenate([lo + r[0] for lo, r in each]), np.concatenate([r[1] for _, r in each])
                best = np.lexsort((rank[d], -score))[:k]
                if len(best):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), doc_ids.take(pa.array(d[best])), pa.array(score[best])], ["query", "doc_id", "score"])

    return search


def _blocks(sizes: DataFrame):
    """Ranges of queries of at most BLOCK_TERMS terms together, or one."""
    first, last, held = None, None, 0
    for row in sizes.orderBy("query").toLocalIterator():
        if first is not None and held + row.terms > BLOCK_TERMS:
            yield first, last
            first, held = None, 0
        first, last, held = row.query if first is None else first, row.query, held + row.terms
    if first is not None:
        yield first, last


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each row of queries (item_id, text)."""
    spark = docs.sparkSession
    asked = materialize(queries.select("item_id", F.col("text").cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()), "search-queries")
    terms = materialize(asked.select("query", "text").mapInArrow(_query_terms, "query long, term long, times long"), "search-terms")
    found = None
    for first, last in _blocks(terms.groupBy("query").agg(F.count(F.lit(1)).alias("terms"))):
        best = _search_block(spark, docs, terms.where(F.col("query").between(first, last)), k)
        found = best if found is None else found.unionAll(best)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long, rank int")
    return found.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark, docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    # At most BLOCK_TERMS rows, or one query's.
    own = terms.orderBy("query", "term").toArrow()
    query, term, times = (own.column(c).to_numpy() for c in ("query", "term", "times"))
    known, number = np.unique(term.view(np.uint64), return_inverse=True)
    wanted = spark.sparkContext.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(_postings(wanted), "doc_id long, n long, at array<int>, tf array<int>").where(F.col("n") > 0), "search-postings")
    n_docs, n_words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    for row in rows.select(F.explode("at").alias("at")).groupBy("at").count().toLocalIterator():  # a number for each of the block's terms
        df[row["at"]] = row["count"]
    weight = np.floor(WEIGHT * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    ids, starts = np.unique(query, return_index=True)
    starts, weights = np.append(starts, len(query)), times * weight[number]
    floors, best, done = np.zeros(len(ids), np.int64), None, 0.0
    place = F.pmod(F.xxhash64("doc_id", "n", F.size("at")), F.lit(1 << 20)) / (1 << 20)
    for share in SHARES:  # each document is in one round
        block = spark.sparkContext.broadcast((starts, number, weights, floors, len(known), n_docs, n_words))
        more = rows.where((place >= done) & (place < share)).mapInArrow(_search(block, k), "query long, doc_id long, score long")
        best = materialize(_best(more if best is None else more.unionAll(best.drop("rank")), k), "search-best")
        floors = floors.copy()
        for row in best.where(F.col("rank") == k).select("query", "score").toLocalIterator():
            floors[row.query] = row.score
        done = share
    discard(rows)
    return _named(spark, best, ids)


def _named(spark, best: DataFrame, ids: np.ndarray) -> DataFrame:
    names = spark.createDataFrame(pa.table({"number": np.arange(len(ids)), "of": ids}))
    return best.join(names, F.col("query") == F.col("number")).select(F.col("of").alias("query"), "doc_id", "score", "rank")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
has AS (SELECT * FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM has),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ts) AS term FROM has) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
m AS (SELECT row, doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * CAST(nn AS BIGINT)) // CAST(ll AS BIGINT) AS m FROM has, total),
p AS (SELECT tf.row, m.doc_id, tf.term, (1000000000 * CAST(tf AS BIGINT)) // (1000 * CAST(tf AS BIGINT) + 8 * m.m) AS part FROM tf JOIN m ON m.row = tf.row),
s AS (SELECT q.item_id, p.row, p.doc_id, CAST(sum(q.times * w.w * p.part) AS BIGINT) AS score FROM q JOIN w ON w.term = q.term JOIN p ON p.term = q.term GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
