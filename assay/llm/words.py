"""Words of many texts: runs of bytes other than ASCII white space, and hashes of runs of
words, with array operations (no object per word but for long ones)."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

# Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64
#: Names of long words that a worker keeps.
NAMES = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Names(dict):
    """Number of a long word: 64 bits of BLAKE2b, which no known way of writing words makes equal."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= NAMES:
            self.clear()
        number = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return number


_names = _Names()
#: The low k bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each text's words).

    A word of at most 16 bytes is read as two numbers, which with its length tell it from all
    others; longer words are hashed by BLAKE2b, one by one."""
    joined = b"\n".join(raw) + b"\n"
    begin, end = _edges(np.frombuffer(joined, np.uint8))
    size = end - begin
    padded = joined + bytes(16)
    eight = np.ndarray((len(joined) + 8,), "<u8", padded, strides=(1,))  # eight bytes from each place on
    first = eight[begin] & _LOW[np.minimum(size, 8)]
    second = eight[np.minimum(begin + 8, len(joined))] & _LOW[np.clip(size - 8, 0, 8)]
    out = mix(mix(first + U(0x9E3779B97F4A7C15) * size.astype(U)) + second * U(0xD1B54A32D192ED03))
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = _names[joined[begin[k]:end[k]]]
    stops = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    return out, np.concatenate([[0], np.searchsorted(begin, stops)])


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def word_spans(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's first byte and end in the texts joined by line feeds."""
    return _edges(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, size, U)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += words[k:k + n] * U(factor)
    return mix(out)
