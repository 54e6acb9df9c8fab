"""Vectorised word and shingle hashing over batches of UTF-8 texts (numpy only).

A batch is one byte buffer with the texts one after another. Words are maximal runs of word bytes; the
classes used here contain either all bytes of a multi-byte character or none, so byte runs are character runs.
A word's 64-bit hash comes from prefix sums of ``T[byte] * P**i`` modulo 2**64, so a whole batch costs a few
passes of numpy and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes of text handled at once; scratch arrays are about 40 times as large, and a worker keeps tables of 32 times as much.
CHUNK_BYTES = 1 << 18

#: Bytes of words that are anything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of ASCII digits, lower-case letters and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = _U(pow(int(_P), -1, 2**64))
_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _cache.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _cache["p"] = _powers(size)
        inv = np.full(size, _INVERSE, dtype=np.uint64)
        inv[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(inv, out=inv)
        _cache["i"] = inv
    return _cache["p"], _cache["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of a batch. starts, ends: byte offsets in data; first: index of each text's first word (n + 1)."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool = True):
        # A space byte between texts ends every word there.
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.data = LOWER[raw] if lower else raw
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.offsets[1:])
        inside = word_bytes[self.data]
        inside[self.offsets[1:] - 1] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self._sums: np.ndarray | None = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            powers, _ = _power_tables(n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(_TABLE[self.data] * powers[:n], out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``longest`` bytes."""
        sums = self._prefix()
        _, inverse = _power_tables(len(self.data) + 1)
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[self.starts]) * inverse[self.starts] + (ends - self.starts).astype(np.uint64))


def _mixed(columns: Iterator[np.ndarray], n: int, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, _U(0x243F6A8885A308D3 + k), dtype=np.uint64)
        for j, words in enumerate(columns):
            out = (out ^ words) * _U(0xD6E8FEB86659FD93) + _U(j + 1)
            out ^= out >> _U(29)
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words (fewer words: none)."""
    n = len(words) - k + 1
    return _mixed((words[j : j + n] for j in range(k)), n, k) if n > 0 else np.zeros(0, dtype=np.uint64)


def shingles_at(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words from these places."""
    return _mixed((words[starts + j] for j in range(k)), len(starts), k)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first text and the texts, about limit bytes at a time; a longer text comes alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts[at:]:
        yield at, texts[at:]


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow string or binary column as bytes; null is empty."""
    import pyarrow as pa

    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]
