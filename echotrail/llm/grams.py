"""Hashes of words and word windows, computed over whole batches of texts with numpy."""

from __future__ import annotations

import numpy as np

# Odd multipliers and offsets drawn once from a fixed seed.
_RNG = np.random.default_rng(41)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word in bytes that end with white space."""
    blank = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


class Words:
    """The words of a batch of texts: ``names`` (64-bit), and the first word of each text in ``first``.

    ``names`` of equal words are equal. With ``lower``, A to Z count as a to z.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, lanes: int = 1):
        self.count = len(texts)
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        if lower:
            data = _LOWER[data]
        begin, end = word_spans(data)
        lengths = np.fromiter(map(len, texts), np.int64, self.count)
        ends = np.cumsum(lengths + 1)
        # Which text a word belongs to follows from where it starts.
        self.first = np.searchsorted(begin, np.concatenate([[0], ends])).astype(np.int64)
        self.names = self._name(data, begin, end)
        self.begin, self.end = begin, end
        self.data = joined

    @staticmethod
    def _name(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each word: a sum over its bytes of scrambled (byte value, place in the word)."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        lengths = end - begin
        out = mix(lengths.astype(np.uint64) * _BASE + np.uint64(1))
        live, at, place = np.arange(len(begin)), begin.copy(), 0
        # One pass per place in the word: words are short, so few passes see all of them. Words beyond
        # 64 bytes are hashed one by one below.
        while len(live) and place < 64:
            out[live] = (out[live] ^ _BYTE[data[at]]) * _BASE
            out[live] ^= out[live] >> np.uint64(29)
            place += 1
            more = lengths[live] > place
            live, at = live[more], at[more] + 1
        for i in live:
            tail = data[begin[i] + 64:end[i]].astype(np.uint64)
            powers = mix(np.arange(len(tail), dtype=np.uint64) + np.uint64(7))
            out[i] = mix(np.asarray([out[i] ^ np.bitwise_xor.reduce(mix(tail * _BASE ^ powers))], np.uint64))[0]
        return mix(out)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``size`` words within a text, and the first window of each text."""
        n = np.diff(self.first)
        counts = np.maximum(n - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        if not first[-1]:
            return np.zeros(0, np.uint64), first
        starts = np.repeat(self.first[:-1] - first[:-1], counts) + np.arange(first[-1])
        return self.window_at(starts, size, seed), first

    def window_at(self, starts: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        out = np.full(len(starts), seed * 2 + 1, np.uint64)
        for i in range(size):
            out = (out ^ self.names[starts + i]) * _BASE
            out ^= out >> np.uint64(32)
        return mix(out)


def batches_by_size(rows, bytes_per_batch: int = 4 * 1024 * 1024):
    """Cut an iterator of rows whose last item is the text into lists of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= bytes_per_batch or len(held) >= 20_000:
            yield held
            held, size = [], 0
    if held:
        yield held
