"""Tokenizing whole texts inside Arrow batches; the tokenizers library is asked once per distinct pre-token and worker.

word_bpe_49k.json cuts a text into runs before any merge: contractions, letters, single digits, other signs. Where a text has only ASCII
and Latin-1 letters the runs are found on its bytes for a whole batch at once; every other text goes to the library as it is.
"""

from __future__ import annotations

import os

import numpy as np

from . import runs as R
from .common import tokenizer_path

_SPACE, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[R.SPACES] = _SPACE
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[0x80:] = _LETTER
_APOSTROPHE = ord("'")


class TextEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_path(path))
        self.lib.no_truncation()
        self.lib.no_padding()
        self.specials = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.cache, self.ids = R.RunCache(), R.Ragged()

    def _ask(self, found: list[bytes]) -> None:
        """Runs of letters are asked for many at a time, as words of one text: each ends with a piece that ends a word."""
        texts = [b.decode() for b in found]
        known: dict[str, list[int]] = {}
        letters = [t for t in texts if t.isalpha()]
        for k in range(0, len(letters), 512):
            part = letters[k : k + 512]
            ids = self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                known.update(zip(part, (ids[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())), strict=True))
        rest = [t for t in texts if t not in known]
        known.update(zip(rest, (e.ids for e in self.lib.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        rows = [known[t] for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ids.extend(np.fromiter((i for x in rows for i in x), np.uint32, int(sizes.sum())), sizes)

    def _odd(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts that have other characters than ASCII and Latin-1 letters, or a special token's string."""
        high = data >= 0x80
        lead = data == 0xC3
        follows = np.zeros(len(data), bool)
        follows[1:] = lead[:-1]
        wrong = high & ~lead & ~follows | follows & ((data == 0x97) | (data == 0xB7))
        odd = R.per_text(wrong, np.arange(len(data)), bounds) > 0
        whole = data.tobytes()
        for s in self.specials:
            at = whole.find(s)
            while at >= 0:
                odd[np.searchsorted(bounds, at, "right") - 1] = True
                at = whole.find(s, at + 1)
        return odd

    def _runs(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        begins = kind != _SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        heads = bounds[:-1][np.diff(bounds) > 0]
        begins[heads] = kind[heads] != _SPACE
        starts = np.flatnonzero(begins)
        if len(starts) > 1 and (data[starts] == _APOSTROPHE).any():
            n = len(data)
            text_end = bounds[np.searchsorted(bounds, starts, "right")]
            nxt = np.append(starts[1:], n)
            single = np.flatnonzero((data[starts] == _APOSTROPHE) & (nxt == starts + 1) & (starts + 1 < text_end))
            at = starts[single]
            single, at = single[kind[at + 1] == _LETTER], at[kind[at + 1] == _LETTER]
            one = data[at + 1]
            two = data[np.minimum(at + 2, n - 1)]
            has_two = at + 2 < text_end[single]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = has_two & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            begins[at[short | long] + 1] = False
            after = np.concatenate([at[short] + 2, at[long] + 3])
            ends_of = np.concatenate([text_end[single[short]], text_end[single[long]]])
            after = after[after < ends_of]
            begins[after[kind[after] != _SPACE]] = True
            starts = np.flatnonzero(begins)
        inside = kind != _SPACE
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        stops = np.flatnonzero(last) + 1
        ends = np.append(starts[1:], len(data))
        ends = np.minimum(ends, stops[np.searchsorted(stops, starts, "right")]) if len(starts) else ends[:0]
        return starts, ends

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per text) of a string column; a null text has none."""
        flats, counts = [], []
        for _, _, raw, bounds in R.text_chunks(column):
            flat, sizes = self._chunk(raw, bounds)
            flats.append(flat)
            counts.append(sizes)
        return (np.concatenate(flats), np.concatenate(counts)) if flats else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _chunk(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        odd = self._odd(raw, bounds) if len(raw) else np.zeros(n, bool)
        if odd.any():
            return self._mixed(raw, bounds, odd)
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        data = R.lower_ascii(raw)
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
        data[capital] += 0x20
        starts, ends = self._runs(data, bounds)
        h = R.fingerprints(data, starts, ends)
        rows = self.cache.find(h)
        if (rows < 0).any():
            if self.cache.full():
                self.cache.clear()
                self.ids = R.Ragged()
                rows[:] = -1
            new, first = np.unique(h[rows < 0], return_index=True)
            where = np.flatnonzero(rows < 0)[first]
            whole = data.tobytes()
            self._ask([whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            self.cache.add(new)
            rows = self.cache.find(h)
        flat, sizes = self.ids.take(rows)
        return flat, R.per_text(sizes, starts, bounds)

    def _mixed(self, raw: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The odd texts go to the library one by one, the others on; then all are put in order."""
        n = len(odd)
        keep = np.repeat(~odd, np.diff(bounds))
        plain_bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[~odd])])
        flat, sizes = self._chunk(raw[keep], plain_bounds) if (~odd).any() else (np.empty(0, np.uint32), np.empty(0, np.int64))
        whole = raw.tobytes()
        texts = [whole[bounds[k] : bounds[k + 1]].decode("utf-8", "replace") for k in np.flatnonzero(odd)]
        parts = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * n
        for k, p in zip(np.flatnonzero(~odd), parts, strict=True):
            out[k] = p
        for k, e in zip(np.flatnonzero(odd), self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return np.concatenate(out), np.array([len(p) for p in out], np.int64)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
