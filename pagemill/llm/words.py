"""Words of many texts at once, as numpy arrays: places in the joined bytes, and codes from prefix polynomials.

A sequence is summed up once as a polynomial over 64-bit integers; the code of any stretch of it is the
difference of two prefix sums, shifted to the origin. Words are stretches of bytes, n-grams stretches of
words. Equal stretches have equal codes; unequal ones almost always differ, and callers that must be sure
compare the bytes (``Words.same``).
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
# Elements that are summed at once; wide arrays exist only for one such block.
BLOCK = 1 << 16


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 … BLOCK of an odd base and of its inverse, modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, b, dtype=np.uint64)))) for b in (base, inverse))


def _power(table: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """Powers from a table of the first BLOCK ones."""
    high = exponents // BLOCK
    steps = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(high.max(initial=0)), table[BLOCK], dtype=np.uint64))))
    return steps[high] * table[exponents % BLOCK]


def stretch_codes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """The polynomial code of each stretch ``values[start:end]``; starts and ends must both ascend."""
    up, down = _powers(base)
    sums = [np.empty(len(places), dtype=np.uint64) for places in (starts, ends)]
    carry, scale = np.uint64(0), np.ones(1, dtype=np.uint64)
    for at in range(0, len(values) + 1, BLOCK):
        block = values[at : at + BLOCK].astype(np.uint64) + np.uint64(1)  # no element counts as nothing
        run = np.cumsum(block * up[: len(block)], dtype=np.uint64) * scale
        run = np.concatenate((np.zeros(1, np.uint64), run)) + carry
        for places, found in zip((starts, ends), sums, strict=True):
            low, high = np.searchsorted(places, (at, at + BLOCK))
            found[low:high] = run[places[low:high] - at]
        carry, scale = run[-1], scale * up[BLOCK]
    return (sums[1] - sums[0]) * _power(down, starts)


def byte_table(rule) -> np.ndarray:
    """Which byte values a rule holds for."""
    return np.array([bool(rule(b)) for b in range(256)])


class Words:
    """The words of some texts in order; A-Z are lower-cased.

    ``data`` holds the texts' bytes, each text after a line feed, which must be no word byte. ``starts`` and
    ``ends`` are the places of words in it, ``text`` the number of each word's text, ``code`` its 64-bit code.
    """

    def __init__(self, values: list[bytes], in_word: np.ndarray, base: int = BASE) -> None:
        joined = b"\n".join([b"", *values, b""]).lower()
        self.data = np.frombuffer(joined, dtype=np.uint8)
        inside = in_word[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.text_starts = np.cumsum([1, *[len(v) + 1 for v in values]], dtype=np.int64)
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.code = stretch_codes(self.data, self.starts, self.ends, base)

    def __len__(self) -> int:
        return len(self.starts)

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()

    def same(self, words: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether each word's bytes are those of another word of these texts."""
        return same_bytes(self.data, self.starts[words], self.ends[words], self.data, self.starts[others], self.ends[others])

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, the same for the same bytes only, and one place of each number."""
        _, first, number = np.unique(self.code, return_index=True, return_inverse=True)
        if self.same(np.arange(len(self)), first[number]).all():
            return number, first
        found: dict[bytes, int] = {}  # two words have one code: their bytes decide
        number = np.array([found.setdefault(self.bytes_of(i), len(found)) for i in range(len(self))], dtype=np.int64)
        return number, np.unique(number, return_index=True)[1]


def same_bytes(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each pair of stretches of two byte arrays whether they are equal, in blocks of bounded size."""
    sizes = a_ends - a_starts
    equal = sizes == b_ends - b_starts
    pairs = np.flatnonzero(equal & (sizes > 0))
    before = np.concatenate(([0], np.cumsum(sizes[pairs])))
    low = 0
    while low < len(pairs):
        high = max(low + 1, int(np.searchsorted(before, before[low] + (BLOCK << 2), side="right")) - 1)
        part = pairs[low:high]
        offsets = before[low:high] - before[low]
        within = np.arange(int(before[high] - before[low]), dtype=np.int64)
        differs = a[within + np.repeat(a_starts[part] - offsets, sizes[part])] != b[within + np.repeat(b_starts[part] - offsets, sizes[part])]
        equal[part] = ~np.logical_or.reduceat(differs, offsets)
        low = high
    return equal
