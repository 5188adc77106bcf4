"""Words, shingles, MinHash samples and odd sketches of whole texts, vectorised with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_FOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: All ASCII but letters and digits.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FOLD)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0][:n], _powers[1][:n]


def text_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts in a row, nulls empty, A-Z lower-cased, and each text's bounds in them."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    return (_LOWER[held] if lower else held), bounds - bounds[0]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of a polynomial in 64-bit values, before each place and at the end."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def spans_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of what prefix_sums() has read."""
    return mix((sums[ends] - sums[begins]) * powers(len(sums))[1][begins] + (ends - begins).astype(np.uint64))


def word_spans(held: np.ndarray, bounds: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words between blank bytes (ASCII white space), and each text's bounds in them."""
    ink = np.zeros(len(held) + 2, bool)
    ink[1:-1] = ~blank[held]
    # A text's end ends its last word: edges are looked for with a blank between texts.
    begin, end = ink[1:-1] & ~ink[:-2], ink[1:-1] & ~ink[2:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(held))]
    begin[cut] = ink[1:-1][cut]
    end[cut - 1] = ink[1:-1][cut - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, bounds)


def word_hashes(texts: pa.Array, lower: bool = True, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in a row, and each text's bounds in them (one more than texts)."""
    held, bounds = text_bytes(texts, lower)
    begins, ends, at = word_spans(held, bounds, blank)
    return spans_hashes(prefix_sums(_BYTE[held]), begins, ends), at


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width words, by the run's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, width):
        acc *= _FOLD
        acc += words[j : j + n]
    return mix(acc)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's set as sorted distinct hashes; with fewer words than width the whole sequence is the one shingle."""
    words, bounds = word_hashes(texts)
    every = windows(words, width)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            found = np.sort(every[a : b - width + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    acc = acc * _FOLD + w
            yield mix(np.array([acc], np.uint64))
        else:
            yield np.empty(0, np.uint64)


class MinHash:
    """count samples a set; rows samples make a band; an odd sketch of bits parities over all samples."""

    def __init__(self, bands: int, rows: int, bits: int = 0, seed: int = 1) -> None:
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(seed)
        self.count = bands * rows
        self.a = rng.integers(0, 2**32, self.count, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, self.count, dtype=np.uint32)
        self.salt = mix(np.arange(1, self.count + 1, dtype=np.uint64) * _FOLD)

    def samples(self, grams: np.ndarray, step: int = 2048) -> np.ndarray:
        """The least value of each of the permutations over a set that is not empty."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.count, 2**32 - 1, np.uint32)
        for i in range(0, len(x), step):
            part = self.a[:, None] * x[None, i : i + step]
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """samples: (n, count). A 64-bit key for each band, which differs between bands."""
        s = samples.astype(np.uint64).reshape(-1, self.bands, self.rows)
        acc = np.broadcast_to(self.salt[: self.bands], s.shape[:2]).copy()
        for j in range(self.rows):
            acc *= _FOLD
            acc += s[:, :, j]
            acc ^= acc >> np.uint64(29)
        return mix(acc).view(np.int64)

    def odd_sketches(self, samples: np.ndarray) -> np.ndarray:
        """(n, bits / 64) words: bit p is the parity of the numbered samples that hash to p."""
        n = len(samples)
        at = mix(samples.astype(np.uint64) * _FOLD + self.salt) % np.uint64(self.bits)
        flat = at.astype(np.int64) + np.arange(n)[:, None] * self.bits
        odd = (np.bincount(flat.ravel(), minlength=n * self.bits) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(n, self.bits), axis=1, bitorder="little").view(np.int64)

    def most_odd(self, least: float) -> int:
        """The XOR population count that two sets of that similarity reach on average; more says less similar."""
        apart = 2 * self.count * (1 - least)
        return int(np.ceil(self.bits / 2 * (1 - np.exp(-2 * apart / self.bits))))
