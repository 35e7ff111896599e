"""Words of UTF-8 text as 64-bit hashes, and hashes of runs of words, in whole arrays.

A word is a maximal run of bytes that are no separators. All separators in use are ASCII, and
no byte of a longer UTF-8 character is, so bytes decide as characters would. The hash of a
run is a polynomial modulo 2^64 taken from prefix sums, followed by a bit mixer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD_BYTE, _ODD_WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
#: Bytes hashed at a time; the tables of powers are as long.
_BLOCK = (1 << 18) - 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                                  for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _RUNS = _Powers(_ODD_BYTE), _Powers(_ODD_WORD)


class WordRule:
    """Which bytes separate words, and whether A-Z count as a-z."""

    def __init__(self, separators: bytes, fold: bool) -> None:
        self.inside = np.ones(256, bool)
        self.inside[np.frombuffer(separators, np.uint8)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        if fold:
            self.fold[65:91] += 32
        self.values = _BYTE_VALUES[self.fold]


_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Separated by white space, letters as they are.
SPACED = WordRule(_SPACE, False)
#: Separated by white space, A-Z as a-z.
SPACED_FOLDED = WordRule(_SPACE, True)
#: Digits, letters and everything beyond ASCII; A-Z as a-z.
ALPHANUMERIC = WordRule(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


@dataclass
class Words:
    """Words of several texts in a row: byte ranges, hashes, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_end(self) -> np.ndarray:
        """For each word, the index after the last word of its text."""
        return np.repeat(self.bounds[1:], self.counts)


def tokenize(data: np.ndarray, offsets: np.ndarray, rule: WordRule) -> Words:
    inside = rule.inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    after = np.concatenate([[False], inside[:-1]])
    before = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (edge[:-1] | ~after))
    ends = np.flatnonzero(inside & (edge[1:] | ~before)) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        part = data[base:ends[last - 1]]
        up, down = _BYTES.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(rule.values[part] * up[:len(part)], out=sums[1:])
        low, high = starts[first:last] - base, ends[first:last] - base
        hashes[first:last] = (sums[high] - sums[low]) * down[low]
        first = last
    return Words(starts, ends, mix(hashes), np.searchsorted(starts, offsets))


class Runs:
    """Hashes of any run of words, from prefix sums over all words of a piece."""

    def __init__(self, hashes: np.ndarray) -> None:
        up, self.down = _RUNS.upto(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def all_of(self, length: int) -> np.ndarray:
        """The run that starts at each word, whether or not it stays within one text."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
