"""Hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


BASE = np.uint64(0x9E3779B97F4A7C15)
SIGNS = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: the bytes of all texts end to end, offsets: their ends (and a leading 0), between: for each byte
    whether it separates words. Hash of each word by differences of a running polynomial, and the number of
    words up to each offset."""
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    up, down = _powers(len(data) + 1)
    run = np.concatenate(([np.uint64(0)], np.cumsum(SIGNS[data] * up[: len(data)], dtype=np.uint64)))
    words = mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end, and the offsets of its texts in them."""
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if buffers[2] is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts laid end to end start and end; a text's end also ends a word."""
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, most: int = 1 << 20) -> np.ndarray:
    """Hash of each span, some ``most`` bytes at a time."""
    signs = mix64(SIGNS + np.uint64(seed)) if seed else SIGNS
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        first, piece = starts[at], data[starts[at] : ends[to - 1]]
        up, down = _powers(len(piece) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(signs[piece] * up[: len(piece)], dtype=np.uint64)))
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix64((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out
