"""Token counts by rank-synchronous merging: a batch's distinct pre-tokens as ragged arrays, each sequence's lowest-rank pair applied at once.

A long pre-token (a blob, a line without spaces) has thousands of ranks; its places wait in a queue by rank, and a pass touches the places of one rank and their neighbours, so that
its time grows with its length but for the logarithm of a sort.

Exact for a SentencePiece BPE model with identity normalisation, a dummy prefix, kept white space and byte fallback. A run of spaces, whose pieces share the last rank of all, is
counted from its length once the word behind it is. Defined results: a null or empty text has 0 bytes and 0 tokens; a very long text or run is counted whole like others; repeated rows are counted each; an empty table gives an empty result; doc_id may be of any type; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as R
from .common import table, tokenizer_path

_MARK = "▁"
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[0x20] = True
_NEVER = np.iinfo(np.int64).max
#: Symbols from which on a pre-token is merged by itself.
LONG = 192


class PieceRanks:
    """Symbols, pair -> (rank, merged symbol), and which ranks may be applied at all their places in a sequence at once."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        symbol = {sp.id_to_piece(i): k for k, i in enumerate(plain)}
        score = np.array([sp.get_score(i) for i in plain])
        self.n_pieces = len(plain)
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        shared = np.bincount(rank) > 1
        for c in sorted({c for p in symbol for c in p}):
            symbol.setdefault(c, len(symbol))
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, k in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        lefts, rights, merged = [], [], []
        for piece, k in list(symbol.items())[: self.n_pieces]:
            for i in range(1, len(piece)):
                a, b = symbol.get(piece[:i]), symbol.get(piece[i:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    merged.append(k)
        lefts, rights, self.merged = np.array(lefts), np.array(rights), np.array(merged)
        self.rank = rank[self.merged]
        # A merged symbol that can take part in a merge of its own rank or before it must be applied leftmost only.
        earliest = np.full(len(symbol), _NEVER)
        np.minimum.at(earliest, lefts, self.rank)
        np.minimum.at(earliest, rights, self.rank)
        alone = np.zeros(len(shared), bool)
        alone[rank[: self.n_pieces][earliest[: self.n_pieces] <= rank[: self.n_pieces]]] = True
        self.leftmost = alone | shared
        self.pairs = R.RunCache()
        self.pairs.add(self._key(lefts, rights))
        runs = {len(s): rank[k] for s, k in symbol.items() if k < self.n_pieces and set(s) == {_MARK}}
        # Runs of the mark of 1, 2, ... that are pieces, if they merge after all others and by one rank; None where they do not.
        held = [k for s, k in symbol.items() if k < self.n_pieces and _MARK in s[1:] and set(s) != {_MARK}]
        self.runs = frozenset(runs) if {1, 2} <= set(runs) and set(runs.values()) == {rank.max()} and not held else None
        self.of_run: dict[int, int] = {}

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = R.mix((a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) + np.uint64(1)))
        h[h == 0] = 1
        return h

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or _NEVER, merged symbol) of adjacent symbols; a symbol below 0 never merges."""
        row = self.pairs.find(self._key(np.maximum(a, 0), np.maximum(b, 0)))
        row[(a < 0) | (b < 0)] = -1
        return np.where(row >= 0, self.rank[row], _NEVER), np.where(row >= 0, self.merged[row], -1)

    def count_run(self, n: int) -> int:
        """Pieces of n marks: of equal ranks the leftmost pair goes first, so a run is merged from the left as it is read."""
        if self.runs is None:
            return int(self.count([_MARK * n])[0])
        if n not in self.of_run:
            stack: list[int] = []
            for _ in range(n):
                stack.append(1)
                while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                    last = stack.pop()
                    stack[-1] += last
            if len(self.of_run) > 100_000:
                self.of_run.clear()
            self.of_run[n] = len(stack)
        return self.of_run[n]

    def count_after(self, marks: list[int], words: list[str]) -> np.ndarray:
        """Surviving symbols of each word behind so many marks. Of more than two the word takes one or none, as behind two of them."""
        if self.runs is None:
            return self.count([_MARK * m + w for m, w in zip(marks, words, strict=True)])
        wide = [k for k, m in enumerate(marks) if m > 2]
        out = self.count([_MARK * min(m, 2) + w for m, w in zip(marks, words, strict=True)])
        one = self.count([_MARK + words[k] for k in wide])
        for k, n in zip(wide, one.tolist(), strict=True):
            out[k] = n - 1 + self.count_run(marks[k]) if out[k] == n else n + self.count_run(marks[k] - 1)
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token; one outside the vocabulary counts its UTF-8 bytes. A long one is merged by itself, for its ranks are many."""
        long = [k for k, t in enumerate(texts) if len(t) > LONG]
        if not long:
            return self._count_together(texts)
        out = np.zeros(len(texts), np.int64)
        short = [k for k, t in enumerate(texts) if len(t) <= LONG]
        out[short] = self._count_together([texts[k] for k in short])
        for k in long:
            out[k] = self._count_alone(texts[k])
        return out

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, what each counts if it survives, UTF-8 bytes)"""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_char[code]
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        return sym, np.where((sym < 0) | (sym >= self.n_pieces), width, 1), width

    def _count_alone(self, text: str) -> int:
        """The same for one pre-token: places wait in a queue by rank, and a pass touches those of the lowest rank and their neighbours only."""
        sym, cost, width = self._symbols([text])
        n, fixed = len(sym), int(width[sym < 0].sum())
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, into = np.full(n, _NEVER), np.full(n, -1)
        rank[:-1], into[:-1] = self.look_up(sym[:-1], sym[1:])
        waiting: dict[int, list] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != _NEVER]
            if not len(places):
                return
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, cuts):
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                if self.leftmost[r]:
                    for p in part.tolist():
                        heapq.heappush(waiting[r], p)
                else:
                    waiting[r].append(part)

        wait(np.arange(n - 1))
        while ranks:
            r = ranks[0]
            if self.leftmost[r]:  # equal ranks, one at a time from the left
                while waiting[r] and not (alive[waiting[r][0]] and rank[waiting[r][0]] == r):
                    heapq.heappop(waiting[r])
                at = np.array([heapq.heappop(waiting[r])] if waiting[r] else [], np.int64)
                if not waiting[r] and not len(at):
                    del waiting[heapq.heappop(ranks)]
                    continue
            else:
                at = np.unique(np.concatenate(waiting.pop(heapq.heappop(ranks))))
                at = at[alive[at] & (rank[at] == r)]
                if not len(at):
                    continue
                # Of places that overlap, the first, third, ...
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                order = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[order % 2 == 0]
            gone = after[at]
            sym[at], cost[at] = into[at], 1
            alive[gone] = False
            rank[gone] = _NEVER
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            changed = np.r_[at, before[at]]
            changed = np.unique(changed[changed >= 0])
            last = after[changed] >= n
            rank[changed[last]] = _NEVER
            changed = changed[~last]
            rank[changed], into[changed] = self.look_up(sym[changed], sym[after[changed]])
            wait(changed)
        return fixed + int(cost[alive & (sym >= 0)].sum())

    def _count_together(self, texts: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        sym, cost, width = self._symbols(texts)
        owner = np.repeat(np.arange(len(texts)), size)
        out = np.zeros(len(texts), np.int64)
        # Characters outside the vocabulary that no piece holds never merge: count them now, and let them cut the sequence.
        np.add.at(out, owner[sym < 0], width[sym < 0])
        rank, into = np.full(len(sym), _NEVER), np.full(len(sym), -1)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[:-1][owner[:-1] != owner[1:]] = _NEVER
        while len(sym):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, heads)
            over = least == _NEVER
            sizes = np.diff(np.append(heads, len(sym)))
            if over.any():
                done = np.repeat(over, sizes)
                ended = done & (sym >= 0)
                np.add.at(out, owner[ended], cost[ended])
                sym, owner, cost, rank, into = (x[~done] for x in (sym, owner, cost, rank, into))
                if not len(sym):
                    break
                least, sizes = least[~over], sizes[~over]
                heads = np.cumsum(sizes) - sizes
            now = rank == np.repeat(least, sizes)
            at = np.flatnonzero(now)
            # Of places that overlap, the first, third, ... ; of a rank that must go leftmost, the sequence's first.
            fresh = np.r_[True, np.diff(at) > 1]
            order = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = order % 2 == 0
            first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            take &= first | ~self.leftmost[rank[at]]
            at = at[take]
            sym[at], cost[at] = into[at], 1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            # A merged pair's right symbol had a rank of its own with what follows it: look that up anew, and the left neighbour's.
            dirty = np.zeros(len(sym), bool)
            dirty[at] = True
            place = np.cumsum(keep) - 1
            sym, owner, cost, rank, into = (x[keep] for x in (sym, owner, cost, rank, into))
            changed = place[at]
            changed = np.unique(np.r_[changed, changed[changed > 0] - 1])
            last = changed == len(sym) - 1
            rank[changed[last]] = _NEVER
            changed = changed[~last]
            rank[changed], into[changed] = self.look_up(sym[changed], sym[changed + 1])
            rank[changed[owner[changed] != owner[changed + 1]]] = _NEVER
        return out


class TokenCounter:
    def __init__(self, path: str):
        self.ranks, self.cache, self.known = PieceRanks(path), R.RunCache(), R.Ragged(np.int64)

    def count(self, column) -> np.ndarray:
        parts = [self._chunk(raw, bounds) for _, _, raw, bounds in R.text_chunks(column, 1 << 21)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def _chunk(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        whole = raw.tobytes()
        if _MARK.encode() in whole:  # the mark stands for a space
            texts = [whole[a:b].replace(_MARK.encode(), b" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            whole = b"".join(texts)
            raw, bounds = np.frombuffer(whole, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = len(bounds) - 1
        if not len(raw):
            return np.zeros(n, np.int64)
        starts = R.word_starts(raw, bounds, _ONLY_SPACE)
        ends = R.word_ends(raw, bounds, starts, _ONLY_SPACE)
        text = np.searchsorted(bounds, starts, "right") - 1
        first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.empty(0, bool)
        spaces = np.where(first, starts - bounds[text] + 1, starts - np.r_[0, ends[:-1]])
        h = R.fingerprints(raw, starts, ends, _ONLY_SPACE)
        wide = spaces > 1
        h[wide] = R.mix(h[wide] + spaces[wide].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        rows = self.cache.find(h)
        if (rows < 0).any():
            if self.cache.full():
                self.cache.clear()
                self.known = R.Ragged(np.int64)
                rows[:] = -1
            new, at = np.unique(h[rows < 0], return_index=True)
            at = np.flatnonzero(rows < 0)[at]
            found = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self.known.extend(self.ranks.count_after(spaces[at].tolist(), found), np.ones(len(found), np.int64))
            self.cache.add(new)
            rows = self.cache.find(h)
        out = R.per_text(self.known.flat[rows], starts, bounds)
        # Spaces at a text's end are a pre-token of their own; a text of spaces alone has the dummy prefix too.
        stop = bounds[:-1].copy()
        np.maximum.at(stop, text, ends)
        tail = bounds[1:] - stop + ((np.diff(bounds) > 0) & (stop == bounds[:-1]))
        for k in np.flatnonzero(tail):
            out[k] += self.ranks.count_run(int(tail[k]))
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no shuffle."""

    def batches(it):
        c = counter(model)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(c.count(b.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_count_tokens(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
