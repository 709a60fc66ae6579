"""Language-model scores by subword lattice likelihood: a word's probability is the sum over all its segmentations, weighted by an existing vocabulary's scores.

A word's lattice has an arc for each piece of the vocabulary, weighted by that piece's score, and, if training texts hold the word, one arc over all of it, weighted by how often they do.
A forward recursion in log space sums the segmentations of the pieces. The scores are used as they are but for one temperature, chosen on training words that occur once, which are most like words not seen.
Absolute discounting sets aside the share of the pieces: each distinct training word gives up D = (n1 + 1) / (n1 + 2 n2 + 2) of its count, n1 and n2 being the numbers of words seen once and twice.
Pieces do not cross white space, so a text's sum is the product of its words' sums and the end's, and the probabilities of all texts sum to at most one.
Words meet counts and probabilities by joins on the word, never through the driver. Texts are read once: chunks of bounded bytes keep each document as numbers of its chunk's distinct words.

Defined results: a null, empty or blank text is its end alone; repeated rows are scored, and where they train counted, each; a null doc_id
trains; a very long text is a chunk of its own; without training rows c and N are 0 and the pieces alone make the words; where no word occurs once the temperature is 1; a word of any length is summed in windows of 32,768 characters; an empty table gives an empty result; characters
outside the vocabulary are spelled in bytes, as is the mark of a word's start inside a word; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs as R
from .common import discard, materialize, table, tokenizer_path

#: Bytes of text that make a chunk, about; temperatures of the scores that are compared; what an end has, in tokens, before texts are seen (spelt words have the rest of one token).
CHUNK_BYTES, TEMPERATURES, END = 12 << 20, (0.5, 0.75, 1.0, 1.25, 1.5), 0.001
#: Up to so many words of one length are summed each by itself; so many characters are a window.
FEW, WINDOW = 8, 1 << 15
ADD = 0.1
_MARK = "▁"
_NEG = -1e30


def start_weights(scores: np.ndarray) -> np.ndarray:
    """Weights of pieces from a vocabulary's scores: log probabilities are taken as they are; other scores fall by one a rank, and rank r weighs 1 / (r + 10)."""
    as_logs = np.exp(np.minimum(scores, 0))
    if 0.9 < as_logs.sum() < 1.1:
        return as_logs
    return 1 / (10 - np.minimum(scores, 0))


class Vocabulary:
    """Pieces that a word can be made of, 256 bytes first, and the start log probability of each from its score."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        # Texts are in lower case and words hold no white space: other pieces have no place in a lattice.
        pieces = [(p, sp.get_score(i)) for i in plain if _MARK not in (p := sp.id_to_piece(i))[1:] and not any("A" <= c <= "Z" for c in p)]
        weight = np.concatenate([np.full(256, 1e-4), start_weights(np.array([s for _, s in pieces]))])
        self.start = np.log(weight / weight.sum())
        self.size, self.longest = len(weight), max(len(p) for p, _ in pieces)
        self.place = np.random.default_rng(41).integers(1, 2**62, self.longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = np.empty(len(pieces), np.uint64)
        for k, (p, _) in enumerate(pieces):
            code = np.array([ord(c) for c in p], np.uint64)
            h[k] = (code * self.place[: len(p)]).sum() + np.uint64(len(p))
        self.rows = R.RunCache()
        self.rows.add(self._key(h))

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        h = R.mix(h)
        h[h == 0] = 1
        return h

    def arcs(self, code: np.ndarray) -> list[np.ndarray]:
        """For words (rows) of equal length: by piece length l, the piece (or -1) at each start; 256 and over are pieces, bytes stand for none here."""
        out, h = [], np.zeros(code.shape, np.uint64)
        marks = code[:, 1:] == ord(_MARK)
        for n in range(1, min(self.longest, code.shape[1]) + 1):
            h = h[:, : code.shape[1] - n + 1] + code[:, n - 1 :] * self.place[n - 1]
            row = self.rows.find(self._key((h + np.uint64(n)).T.ravel())).reshape(h.shape[::-1]).T
            out.append(np.where(row >= 0, row + 256, -1))
        if marks.any():  # a mark of the text's own starts no word
            for a in out:
                a[:, 1:][marks[:, : a.shape[1] - 1]] = -1
        return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _spelled(code: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probability of characters as their UTF-8 bytes."""
    chars, at = np.unique(code, return_inverse=True)
    return np.array([logp[list(chr(int(c)).encode("utf-8", "surrogatepass"))].sum() for c in chars])[at].reshape(code.shape)


def _log_sum(x: list[np.ndarray]) -> np.ndarray:
    if len(x) == 1:
        return x[0]
    x = np.stack(x)
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def _arc_weights(arcs: list[np.ndarray], code: np.ndarray, logp: np.ndarray) -> list[np.ndarray]:
    """Log weights by piece length; a character that is no piece is spelled in bytes, so that every place has an arc."""
    out = [np.where(a >= 0, logp[a], _NEG) for a in arcs]
    none = arcs[0] < 0
    if none.any():
        out[0][none] = _spelled(code[none], logp)
    return out


def _sum_one(code: np.ndarray, voc: Vocabulary, logps: np.ndarray) -> np.ndarray:
    """The sums of one word of any length, in windows of its ends that overlap by the longest piece."""
    length, reach = len(code), voc.longest
    last = [np.zeros(1) for _ in logps]  # log sums at the places from `low` to the window's begin
    for begin in range(0, length, WINDOW):
        low, end = max(0, begin - reach), min(begin + WINDOW, length)
        part = code[None, low:end]
        arcs = voc.arcs(part)
        for m, logp in enumerate(logps):
            starts, ends, weights = [], [], []
            for k, w in enumerate(_arc_weights(arcs, part, logp), 1):
                at = np.flatnonzero((w[0] > _NEG) & (np.arange(w.shape[1]) + k + low > begin))
                starts.append(at)
                ends.append(at + k)
                weights.append(w[0][at])
            ends = np.concatenate(ends)
            order = np.argsort(ends, kind="stable")
            cut = np.searchsorted(ends[order], np.arange(begin - low + 1, end - low + 2)).tolist()
            start, weight = np.concatenate(starts)[order].tolist(), np.concatenate(weights)[order].tolist()
            alpha = last[m].tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b == a + 1:
                    alpha.append(alpha[start[a]] + weight[a])
                else:
                    x = [alpha[start[k]] + weight[k] for k in range(a, b)]
                    top = max(x)
                    alpha.append(top + math.log(sum([math.exp(v - top) for v in x])))
            last[m] = np.array(alpha[-reach - 1 :])
    return np.array([x[-1] for x in last])


def lattice(code: np.ndarray, voc: Vocabulary, logps: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations, for each row of log weights (rows) and word (columns): code is words of equal length as rows."""
    n, length = code.shape
    if n <= FEW:
        return np.stack([_sum_one(c, voc, logps) for c in code], 1)
    arcs = voc.arcs(code)
    # A step sums over the lengths that have a piece there in some word.
    has = [(a >= 0).any(0) for a in arcs]
    has[0][:] = True
    out = np.empty((len(logps), n))
    for m, logp in enumerate(logps):
        weights = _arc_weights(arcs, code, logp)
        alpha = np.full((n, length + 1), _NEG, order="F")
        alpha[:, 0] = 0
        for e in range(1, length + 1):
            alpha[:, e] = _log_sum([alpha[:, e - k] + weights[k - 1][:, e - k] for k in range(1, min(len(arcs), e) + 1) if has[k - 1][e - k]])
        out[m] = alpha[:, length]
    return out


def _by_length(words: list[bytes]):
    """(rows, codes) of words of the same number of characters, each after the mark of a word's start; places lie together in memory."""
    texts = [_MARK + w.decode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, 200_000 // int(n))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, code[starts[part] + np.arange(n)[:, None]].T


def log_probabilities(words: list[bytes], voc: Vocabulary, logps: np.ndarray) -> np.ndarray:
    """A row for each row of log weights, a column for each word."""
    out = np.empty((len(logps), len(words)))
    for rows, code in _by_length(words):
        out[:, rows] = lattice(code, voc, logps)
    return out


def tempered(start: np.ndarray, temperature: float) -> np.ndarray:
    """Log probabilities of pieces whose log weights are the scores' times a number."""
    x = start * temperature
    return x - np.log(np.exp(x).sum())


def _held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


class _Chunk:
    """Distinct words of successive texts, and each text as numbers of them."""

    def __init__(self):
        self.ids, self.held, self.sizes, self.words, self.parts, self.bytes = [], [], [], [], [], 0

    def add(self, ids: list, held: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> None:
        data = R.lower_ascii(raw)
        starts = R.word_starts(data, bounds) if len(data) else np.empty(0, np.int64)
        ends = R.word_ends(data, bounds, starts) if len(starts) else starts
        u, at, inv = np.unique(R.fingerprints(data, starts, ends), return_index=True, return_inverse=True)
        sizes = np.diff(np.searchsorted(starts, bounds))
        train = np.bincount(inv, np.repeat(~held, sizes), len(u)).astype(np.int64)
        whole = data.tobytes()
        self.words += [whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        self.parts.append((u, inv, train))
        self.ids += ids
        self.held.append(held)
        self.sizes.append(sizes)
        self.bytes += len(raw)

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        h = np.concatenate([u for u, _, _ in self.parts])
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inv, np.concatenate([n for _, _, n in self.parts]), len(u)).astype(np.int64)
        # Numbers by how often a word occurs, so that two bytes hold nearly all; the others follow in four.
        order = np.argsort(-np.bincount(inv, np.concatenate([np.bincount(i, minlength=len(u)) for u, i, _ in self.parts]), len(u)), kind="stable")
        number_of = np.empty(len(u), np.uint32)
        number_of[order] = np.arange(len(u))
        u, at, n = u[order], at[order], n[order]
        heads = np.cumsum([0] + [len(p[0]) for p in self.parts])
        numbers = np.concatenate([number_of[inv[k : k + len(p[0])]][p[1]] for k, p in zip(heads, self.parts)])
        places, far = np.minimum(numbers, _FAR).astype("<u2"), numbers[numbers >= _FAR].astype("<u4")
        held = np.concatenate(self.held)
        columns = [
            (number, pa.int64()), (u.view(np.int64), pa.list_(pa.int64())), ([self.words[k] for k in at.tolist()], pa.list_(pa.binary())), (n, pa.list_(pa.int64())), (self.ids, pa.list_(kind)),
            (held, pa.list_(pa.bool_())), (np.concatenate(self.sizes).astype("<i4").tobytes(), pa.binary()), (places.tobytes(), pa.binary()), (far.tobytes(), pa.binary()), (int((~held).sum()), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in columns], _CHUNK)


_FAR = 0xFFFF
_CHUNK = ["chunk", "h", "word", "n", "doc_ids", "held", "sizes", "places", "far", "train"]


def chunked(docs: DataFrame, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of successive documents."""
    rows = docs.select("doc_id", "text", _held_out(F.col("doc_id")).alias("held"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def chunks(it):
        part, seq, chunk, arrow_kind = TaskContext.get().partitionId() << 32, 0, _Chunk(), None
        for b in it:
            held = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            arrow_kind = b.column(0).type
            for first, to, raw, bounds in R.text_chunks(b.column(1), min(most_bytes, 1 << 22)):
                if chunk.bytes and chunk.bytes + len(raw) > most_bytes:
                    yield chunk.row(part + seq, arrow_kind)
                    chunk, seq = _Chunk(), seq + 1
                chunk.add(b.column(0)[first:to].to_pylist(), held[first:to], raw, bounds)
        if chunk.ids:
            yield chunk.row(part + seq, arrow_kind)

    return rows.mapInArrow(chunks, f"chunk long, h array<long>, word array<binary>, n array<long>, doc_ids array<{kind}>, held array<boolean>, sizes binary, places binary, far binary, train long")


def fit_temperature(words: DataFrame, vocab: str) -> float:
    """The temperature at which the distinct words (word, c) that occur once in training texts are likeliest, to two digits; the driver gets one number a temperature."""

    def expect(it):
        voc, total = vocabulary(vocab), np.zeros(len(TEMPERATURES))
        logps = np.stack([tempered(voc.start, t) for t in TEMPERATURES])
        for b in it:
            total += log_probabilities(b.column(0).to_pylist(), voc, logps).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["t", "lp"])

    got = words.where("c = 1").select("word").mapInArrow(expect, "t long, lp double").groupBy("t").agg(F.sum("lp").alias("lp")).collect()
    lp = np.zeros(len(TEMPERATURES))
    for r in got:
        lp[r.t] = r.lp
    if not lp.any():
        return 1.0
    # The best of a parabola through the best and its neighbours.
    k = min(max(int(lp.argmax()), 1), len(lp) - 2)
    low, mid, high = lp[k - 1 : k + 2]
    bend, step = low - 2 * mid + high, TEMPERATURES[1] - TEMPERATURES[0]
    best = TEMPERATURES[k] + step / 2 * (low - high) / bend if bend < 0 else TEMPERATURES[int(lp.argmax())]
    return round(float(np.clip(best, TEMPERATURES[0], TEMPERATURES[-1])), 2)


def score_texts(docs: DataFrame, vocab: str = "piece_bpe_32k.model", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    chunks = materialize(chunked(docs, chunk_bytes), "lm-chunks")
    words = chunks.select(F.explode(F.arrays_zip("h", "word", "n")).alias("w")).select("w.h", "w.word", "w.n").groupBy("h").agg(F.sum("n").alias("c"), F.min("word").alias("word"))
    words = materialize(words, "lm-words")
    n_texts = chunks.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n_all, distinct = int(totals.n) + n_texts, int(totals.v) + (n_texts > 0)
    temperature = fit_temperature(words, vocab)
    discount = (totals.once + 1) / (totals.once + 2 * totals.twice + 2)
    spelt, end = np.log(discount * int(totals.v) + 1 - END), np.log((n_texts + END) / (n_all + 1))
    ln10, below = np.log(10), n_all + ADD * (distinct + 1)

    def spell(it):
        v = vocabulary(vocab)
        logps = tempered(v.start, temperature)[None]
        for b in it:
            own = np.maximum(b.column(1).to_numpy() - discount, 0)
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(own), spelt + log_probabilities(b.column(2).to_pylist(), v, logps)[0]) - np.log(n_all + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp / ln10)], ["h", "c", "lp"])

    scored = materialize(words.select("h", "c", "word").mapInArrow(spell, "h long, c long, lp double"), "lm-scored")
    discard(words)
    looked_up = chunks.select(F.col("chunk").alias("d_chunk"), F.posexplode("h").alias("pos", "h")).join(scored, "h").select("d_chunk", "pos", "c", "lp")
    kind = docs.schema["doc_id"].dataType.simpleString()
    end_base = np.log10((n_texts + ADD) / below)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """One chunk: its row, and its words' counts and log probabilities."""
        r = {c: left.column(c)[0] for c in left.column_names}
        pos = right.column("pos").to_numpy()
        c, lp = np.empty(len(pos), np.int64), np.empty(len(pos))
        c[pos], lp[pos] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        sizes = np.frombuffer(r["sizes"].as_py(), "<i4").astype(np.int64)
        places = np.frombuffer(r["places"].as_py(), "<u2").astype(np.int64)
        places[places == _FAR] = np.frombuffer(r["far"].as_py(), "<u4")
        text = np.repeat(np.arange(len(sizes)), sizes)
        of_text = lambda x: np.bincount(text, x[places], len(sizes))
        known = of_text((c > 0).astype(float)).astype(np.int64) + int(n_texts > 0)
        return pa.table({"doc_id": r["doc_ids"].values, "held_out": r["held"].values, "n_tokens": sizes + 1, "n_known": known, "train_tokens": np.full(len(sizes), n_all), "base_score": of_text(np.log10((c + ADD) / below)) + end_base, "score": of_text(lp) + end / ln10})

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    own = chunks.select("chunk", "doc_ids", "held", "sizes", "places", "far")
    return own.groupBy("chunk").cogroup(looked_up.groupBy("d_chunk")).applyInArrow(score, schema)


def op10_lattice_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
