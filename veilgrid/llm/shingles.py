"""Shingle sets of texts, as sorted distinct 64-bit hashes.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A to Z in lower case. A text's set are the hashes of all its
runs of five words; with fewer words that of the whole sequence; without words it is empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
#: Bytes of text that are hashed at once, at least one text; bounds the memory of a worker.
BLOCK = 512 << 10
_U = np.uint64
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _sets_of_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sets of the texts that lie in ``data`` between offsets."""
    n = len(data)
    docs = len(offsets) - 1
    if not n:
        return [np.empty(0, np.int64)] * docs
    b = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # of a text; the end counts as one
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | first[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | first[1:])) + 1
    up, down = _powers(n)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[b] * up[:n])])
    words = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BYTE[7])
    at = np.searchsorted(starts, offsets)  # a text's words are at[i] to at[i + 1]
    runs = np.zeros(max(0, len(words) - SIZE + 1), np.uint64)
    for k in range(SIZE):
        runs += words[k : len(words) - SIZE + 1 + k] * _PLACE[k] if len(runs) else _U(0)
    runs = _mix(runs).view(np.int64)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i >= SIZE:
            out.append(np.unique(runs[i : j - SIZE + 1]))
        elif j > i:
            whole = (words[i:j] * _PLACE[: j - i]).sum(keepdims=True, dtype=np.uint64) + np.array([j - i], np.uint64) * _BYTE[3]
            out.append(_mix(whole).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text of a string array, in order; a null text has an empty one."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        part = offsets[at : to + 1]
        yield from _sets_of_block(data[part[0] : part[-1]], part - part[0])
        at = to
