"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_501)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ascii = np.arange(256)
#: Bytes inside words: letters, digits and all bytes of non-ASCII characters.
ALNUM = (_ascii >= 128) | np.isin(_ascii, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8))
#: Bytes inside words: everything but a blank and the controls from tab to carriage return.
VISIBLE = ~((_ascii == 32) | ((_ascii >= 9) & (_ascii <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of words in them, and the number of
    words before each text (one more entry than texts). Texts must not be null."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = inside[raw]
    begins = word[1:-1] & ~word[:-2]
    stops = word[1:-1] & ~word[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = word[1:-1][edges]
    stops[edges - 1] = word[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return LOWER[raw], starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings from ``starts`` to ``ends``, by sums over a rolling product."""
    power = np.full(len(data) + 1, _BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.add.accumulate(_BYTES[data] * power[:-1], out=sums[1:])
    power[1:] = _INVERSE
    np.multiply.accumulate(power, out=power)
    return mix((sums[ends] - sums[starts]) * power[starts])


def word_hashes(texts: pa.Array, inside: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text."""
    data, starts, ends, before = word_spans(texts, inside)
    return hash_spans(data, starts, ends), before


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter text is one run, no words are none."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : i + n]
    return mix(out)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value mixed with how often it stood before, so that no two are alike."""
    if len(values) == 0:
        return values
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    first = np.ones(len(values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    occurrence = np.empty(len(values), np.uint64)
    occurrence[order] = (np.arange(len(values)) - start).astype(np.uint64)
    return mix(values + occurrence * _INVERSE)
