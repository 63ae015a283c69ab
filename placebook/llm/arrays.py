"""Words and shingles of many texts at once, as numpy arrays over their bytes.

Words are runs of bytes other than blank and the five ASCII controls 9 to 13. A word's
hash is that of its bytes, the same in every task and run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEPT_POWERS = 100_000
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS["up"]) < n:
        n += n // 4
        for name, factor in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def forget() -> None:
    """Let go of the powers, as many as bytes in the longest batch: 28 MB for 1.5 MB of texts."""
    if len(_POWERS["up"]) > KEPT_POWERS:
        _POWERS.update({name: np.ones(1, np.uint64) for name in _POWERS})


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of all texts: hashes, byte spans in ``data``, and text borders.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``begins[i]`` is where its
    bytes begin in ``data``. One separator byte follows every text.
    """

    data: np.ndarray
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def joined_bytes(texts: pa.Array, before: str = "") -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8, ``before`` and a line feed around each; nulls are empty. And
    where each begins."""
    large = pa.large_string()
    ended = pc.binary_join_element_wise(*(x if isinstance(x, pa.Array) else pa.scalar(x, large) for x in (before, texts.cast(large).fill_null(""), "\n", "")))
    ends = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    if not len(ended) or ended.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(ended) + 1, np.int64)
    return np.frombuffer(ended.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, wherever it lies."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words_of(texts: pa.Array) -> Words:
    data, begins = joined_bytes(texts)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    return Words(data, begins, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, begins))


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within a text, and the texts' borders in them.

    A text of fewer words, but any, has one shingle: all its words.
    """
    hashes, first, counts = words.hashes, words.first, words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    borders = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - borders[:-1], n) + np.arange(borders[-1])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    room = np.repeat(first[1:], n) - at
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        part = padded[at + k] * np.uint64(int(BASE) * (2 * k + 1) % 2**64)
        part[room <= k] = 0
        total += mix(part + np.uint64(k))
    return mix(total), borders


def occurrence(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many equal keys of the same group come earlier."""
    order = np.argsort(keys ^ mix(group.astype(np.uint64)), kind="stable")
    key, own = keys[order], group[order]
    new = np.ones(len(keys), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - begin
    return out
