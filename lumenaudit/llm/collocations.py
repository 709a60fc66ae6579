"""Phrase collocation mining: best-first branch-and-bound growth from words to pairs to triples.

Nodes are phrases; growing one by a word counts its extensions. The counts of a prefix bound every score below it: an extension of p occurs at
most g(p) times, the occurrences of p that another word follows, and a cut's two parts occur at least as often as the whole, so no extension of p = (x, ...)
scores above 1000000 * g(p) / f(x), and none is a candidate if g(p) is below the least count. Words are expanded where the counts leave a
candidate; of the pairs the best are expanded first. A round takes, per language, the pairs whose bound reaches a level, counts the triples below
them, and counts the triples around every pair that itself scores at the level, for these decide whether it is dropped. At the end of a
round all phrases that score at the level or above are known with their fates; if they are at least `limit` (or the level is 0), the language is settled, ties
included, else its level falls and the frontier grows.

What tasks need to know of the frontier are bitmaps of one fixed size (bitmaps.py); what they let through in error is counted exactly and scores below
the level. Words are known by 64-bit fingerprints of language and letters; counts are summed per task before they are shuffled.

Defined results: a null or empty text has no words; a null lang is `und`, as a lang of that name; repeated rows count each time; ties are broken by a, then by the
phrase's bytes; an empty table gives an empty result; columns other than text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R
from .bitmaps import bitmap, may_hold, pair_column, pair_key
from .common import materialize, table

#: What ends a piece, what parts words inside it, and the scale of scores.
BREAKS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
SCALE = 1_000_000
#: Phrases held before their counts are sent, and the ranks that the first round's level looks at, in limits; each round looks at WIDER times as many.
HELD, AHEAD, WIDER = 1_000_000, 2, 4

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[np.frombuffer(BREAKS, np.uint8)] = True
_OUTSIDE = _IS_BREAK.copy()
_OUTSIDE[np.frombuffer(GAPS, np.uint8)] = True


def _read(batch: pa.RecordBatch):
    """(bytes, starts, ends, row, word, linked) of some texts: linked[i] says that word i + 1 follows word i in its piece. Columns text, lang_key."""
    langs = batch.column("lang_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for first, _, raw, bounds in R.text_chunks(batch.column("text")):
        data = R.lower_ascii(raw)
        starts = R.word_starts(data, bounds, _OUTSIDE)
        if not len(starts):
            continue
        ends = R.word_ends(data, bounds, starts, _OUTSIDE)
        row = first + np.searchsorted(bounds, starts, "right") - 1
        word = R.mix(R.fingerprints(data, starts, ends, _OUTSIDE) ^ langs[row])
        breaks = np.concatenate([[0], np.cumsum(_IS_BREAK[data])])
        linked = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        yield data, starts, ends, row, word, np.append(linked, False)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def _count_words(it):
    for batch in it:
        for data, starts, ends, row, word, linked in _read(batch):
            w, at, inv, f = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
            before = np.concatenate([[False], linked[:-1]])
            g, p = (np.bincount(inv[x], minlength=len(w)) for x in (linked, before))
            cols = [pa.array(w.view(np.int64)), batch.column("lang").take(pa.array(row[at])), _strings(data, starts[at], ends[at]), pa.array(f), pa.array(g), pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, ["w", "lang", "word", "f", "g", "p"])


class _Held:
    """Phrases as columns of fingerprints and numbers; counts() sums the numbers of equal ones."""

    def __init__(self, words: int, sums: int):
        self.words, self.names = words, [f"w{k + 1}" for k in range(words)] + ["a", "g", "p"][:sums]
        self.parts: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, words: list[np.ndarray], numbers: list[np.ndarray]) -> None:
        self.parts.append([*words, *numbers])
        self.n += len(words[0])

    def counts(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.n = [], 0
        key = cols[0]
        for w in cols[1 : self.words]:
            key = R.mix(pair_key(key, w))
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out = [c[order[heads]].view(np.int64) for c in cols[: self.words]]
        out.append(np.diff(np.append(heads, len(key))))
        out += [np.add.reduceat(c[order].astype(np.int64), heads) for c in cols[self.words :]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], self.names)


def _count_pairs(alive):
    """Pairs of neighbours whose words both may be frequent."""

    def count(it):
        held = _Held(2, 3)
        for batch in it:
            for *_, word, linked in _read(batch):
                ok = may_hold(alive.value, word)
                i = np.flatnonzero(linked[:-1] & ok[:-1] & ok[1:])
                held.add([word[i], word[i + 1]], [linked[i + 1], (i > 0) & linked[i - 1]])
                if held.n >= HELD:
                    yield held.counts()
        if held.n:
            yield held.counts()

    return count


def _count_triples(alive, grown, judged):
    """Triples below a pair of the frontier, and those that end in a pair to be judged; the other pair must be frequent."""

    def count(it):
        held = _Held(3, 1)
        for batch in it:
            for *_, word, linked in _read(batch):
                i = np.flatnonzero(linked[:-2] & linked[1:-1])
                left, right = pair_key(word[i], word[i + 1]), pair_key(word[i + 1], word[i + 2])
                want = (may_hold(grown.value, left) & may_hold(alive.value, right)) | (may_hold(judged.value, right) & may_hold(alive.value, left))
                i = i[want]
                held.add([word[i], word[i + 1], word[i + 2]], [])
                if held.n >= HELD:
                    yield held.counts()
        if held.n:
            yield held.counts()

    return count


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"(cast({a} as decimal(14,0)) * cast({a} as decimal(14,0)) * cast({SCALE} as decimal(7,0))) div (cast({left} as decimal(14,0)) * cast({right} as decimal(14,0)))")


def _bound(count: str, of: str) -> Column:
    return F.expr(f"(cast({count} as decimal(14,0)) * cast({SCALE} as decimal(7,0))) div cast({of} as decimal(14,0))")


def _levels(scored: DataFrame, rank: int) -> DataFrame:
    """lang, level: a score that at least rank of the language's phrases reach, from counts over at most 2,000 steps of the score; 0 if there are fewer."""
    step = F.when(F.col("score") >= 1000, F.col("score") - F.col("score") % 1000).otherwise(F.col("score"))
    steps = scored.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("here"))
    so_far = F.sum("here").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return steps.withColumn("so_far", so_far).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("so_far") >= rank, F.col("step"))), F.lit(0)).cast("long").alias("level"))


def mine_collocations(docs: DataFrame, limit: int = 2000, min_count: int = 10, max_words: int = 3, drop_share: int = 50) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: each language's best phrases of 2 to max_words (2 or 3) words.

    A phrase is dropped if a longer candidate that contains it has at least drop_share hundredths of its count.
    """
    if max_words not in (2, 3):
        raise ValueError("max_words must be 2 or 3")
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.col("text").cast("string").alias("text"))
    keep = lambda found: spark.sparkContext.broadcast(found)

    words = texts.mapInArrow(_count_words, "w long, lang string, word string, f long, g long, p long")
    words = materialize(words.groupBy("w").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), *[F.sum(c).alias(c) for c in "fgp"]), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= min_count)

    # Roots: every word that can begin or end a candidate.
    alive = keep(bitmap(frequent.where(F.greatest("g", "p") >= min_count), F.col("w")))
    pairs = texts.mapInArrow(_count_pairs(alive), "w1 long, w2 long, a long, g long, p long").groupBy("w1", "w2").agg(*[F.sum(c).alias(c) for c in "agp"])
    first = frequent.select(F.col("w").alias("w1"), "lang", F.col("f").alias("l"))
    second = frequent.select(F.col("w").alias("w2"), F.col("f").alias("r"))
    pairs = pairs.where(F.col("a") >= min_count).join(first, "w1").join(second, "w2")
    pairs = materialize(pairs.withColumn("score", _score("a", "l", "r")).withColumn("bound", _bound("g", "l")), "phrase-pairs")

    least = F.greatest(F.lit(min_count), F.ceil(F.col("a") * drop_share / 100))
    levels = had = None
    triples: DataFrame | None = None
    rank = AHEAD * limit
    while True:
        levels = _levels(pairs, rank)
        if had is not None:  # settled languages stay as they are
            levels = levels.join(unsettled, "lang", "left_semi").unionByName(had.join(unsettled, "lang", "left_anti"))
        levels = materialize(levels, "phrase-levels")
        if max_words == 2:
            break
        here = pairs.join(levels, "lang")
        new = lambda c: F.col(c) >= F.col("level") if had is None else (F.col(c) >= F.col("level")) & (F.col(c) < F.col("was"))
        if had is not None:
            here = here.join(had.select("lang", F.col("level").alias("was")), "lang")
        grown = here.where((new("bound") & (F.col("g") >= min_count)) | (new("score") & (F.col("g") >= least)))
        judged = here.where(new("score") & (F.col("p") >= least))
        sets = [keep(bitmap(x, pair_column("w1", "w2"))) for x in (pairs, grown, judged)]
        more = texts.mapInArrow(_count_triples(*sets), "w1 long, w2 long, w3 long, a long").groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
        more = materialize(_scored_triples(more, pairs, frequent), "phrase-triples")
        triples = more if triples is None else triples.unionByName(more)
        alive_now = _survivors(pairs, triples.dropDuplicates(["w1", "w2", "w3"]), levels, drop_share)
        per_lang = alive_now.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        unsettled = materialize(levels.where("level > 0").join(per_lang, "lang", "left").where(F.coalesce("found", F.lit(0)) < limit).select("lang"), "phrase-open")
        if unsettled.limit(1).count() == 0:
            break
        had, rank = levels, rank * WIDER

    if max_words == 2:
        found = pairs.join(levels, "lang").where(F.col("score") >= F.col("level")).select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", "score")
    else:
        found = alive_now
    return _ranked(found, frequent, totals, limit)


def _scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, l, r, score of the lowest-scoring cut, ties to the first."""
    pair = lambda x, y, name: pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    word = lambda x, name: words.select(F.col("w").alias(x), F.col("f").alias(name))
    cut = (
        triples.join(pair("w1", "w2", "l2"), ["w1", "w2"]).join(pair("w2", "w3", "r1"), ["w2", "w3"])
        .join(words.select(F.col("w").alias("w1"), "lang", F.col("f").alias("l1")), "w1").join(word("w3", "r2"), "w3")
        .withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    )
    of = lambda one, two: F.when(F.col("s1") <= F.col("s2"), F.col(one)).otherwise(F.col(two))
    return cut.select("lang", "w1", "w2", "w3", "a", of("l1", "l2").alias("l"), of("r1", "r2").alias("r"), of("s1", "s2").alias("score"))


def _survivors(pairs: DataFrame, triples: DataFrame, levels: DataFrame, drop_share: int) -> DataFrame:
    """All phrases at their language's level or above that no longer candidate drops."""
    at_level = lambda df: df.join(levels, "lang").where(F.col("score") >= F.col("level"))
    inside = triples.select("w1", "w2", "a").unionAll(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    kept = at_level(pairs).join(inside, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < drop_share * F.col("a"), F.lit(True)))
    cols = ["lang", "w1", "w2", "w3", "a", "l", "r", "score"]
    return kept.withColumn("w3", F.lit(None).cast("long")).select(cols).unionAll(at_level(triples).select(cols))


def _ranked(found: DataFrame, words: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """The first of each language: of 64 parts first, then of all, so that no task ranks all ties of a language."""
    text = lambda k: words.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"t{k}"))
    named = found.join(text(1), "w1").join(text(2), "w2").join(text(3), "w3", "left")
    named = named.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3")).withColumn("part", F.pmod(F.hash("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)
    n_words = (F.lit(2) + F.col("w3").isNotNull().cast("int")).cast("long")
    return named.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", n_words.alias("words"), "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces))),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS a FROM w GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS a FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS a FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w1, c.w2, NULL AS w3, c.a, 1 AS words, l.a AS l, r.a AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
  UNION ALL
  SELECT c.lang, c.w1, c.w2, c.w3, c.a, 1, l.a, r.a
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1, c.w2, c.w3, c.a, 2, l.a, r.a
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3),
scored AS (SELECT *, concat_ws(' ', w1, w2, w3) AS phrase, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, words) = 1),
longer AS (
  SELECT lang, x, y, max(a) AS a FROM (SELECT lang, w1 AS x, w2 AS y, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON b.w3 IS NULL AND x.lang = b.lang AND x.x = b.w1 AND x.y = b.w2 WHERE x.a IS NULL OR 100 * x.a < 50 * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n AS n, score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
