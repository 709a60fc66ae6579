"""Word shingles, MinHash samples and odd sketches of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np

from . import runs as R

#: Words of a shingle; MinHash samples in BANDS bands of ROWS; bits of an odd sketch.
WORDS, BANDS, ROWS, BITS = 5, 32, 4, 256
_rng = np.random.default_rng(5_0_75)
_STEP = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column):
    """(first row, flat, sizes): the sorted distinct 64-bit shingles of each text. Fewer words than WORDS make one shingle, none make none."""
    for first, to, raw, bounds in R.text_chunks(column):
        n = to - first
        if not len(raw):
            yield first, np.empty(0, np.uint64), np.zeros(n, np.int64)
            continue
        data = R.lower_ascii(raw)
        starts = R.word_starts(data, bounds)
        h = R.fingerprints(data, starts, R.word_ends(data, bounds, starts))
        at = np.searchsorted(starts, bounds)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            w = h[a:b]
            if len(w) >= WORDS:
                s = w[: len(w) - WORDS + 1] * _STEP[0]
                for k in range(1, WORDS):
                    s = s + w[k : len(w) - WORDS + 1 + k] * _STEP[k]
                sets.append(np.unique(R.mix(s)))
            elif len(w):
                sets.append(R.mix((w * _STEP[: len(w)]).sum(keepdims=True) + np.uint64(len(w))))
            else:
                sets.append(w)
        yield first, np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def min_hashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples (texts x BANDS*ROWS) of texts that all have a shingle."""
    heads = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), BANDS * ROWS), np.uint32)
    work = np.empty(len(flat), np.uint64)
    for j in range(BANDS * ROWS):
        np.multiply(flat, _FACTOR[j], out=work)
        np.add(work, _ADD[j], out=work)
        out[:, j] = np.minimum.reduceat((work >> np.uint64(32)).astype(np.uint32), heads)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """64-bit keys (texts x BANDS)."""
    s = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    return R.mix((s * _BAND[None]).sum(2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (texts x BITS/8 bytes): sample j with value v toggles one bit that a hash of (j, v) names."""
    bit = (R.mix((samples.astype(np.uint64) + np.uint64(1)) * _FOLD[None]) >> np.uint64(64 - int(np.log2(BITS)))).astype(np.int64)
    odd = np.zeros((len(samples), BITS), np.int64)
    np.add.at(odd, (np.repeat(np.arange(len(samples)), samples.shape[1]), bit.ravel()), 1)
    return np.packbits((odd & 1).astype(np.uint8), axis=1)


def most_bits(similarity: float, sigmas: float) -> int:
    """XOR population count up to which a pair may have the similarity: the odd-sketch estimate, lowered by so many deviations of sampling."""
    k = BANDS * ROWS
    low = max(0.0, similarity - sigmas * (similarity * (1 - similarity) / k) ** 0.5)
    mean = BITS / 2 * (1 - np.exp(-4 * k * (1 - low) / BITS))
    return int(np.ceil(mean + 2 * (BITS / 4 * np.exp(-4 * k * (1 - low) / BITS) * (1 - np.exp(-4 * k * (1 - low) / BITS))) ** 0.5))
