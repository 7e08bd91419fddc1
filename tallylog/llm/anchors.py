"""Anchors of word windows: rolling word-sequence hashes and their leftmost minima.

Every window of ``window`` words is filed under the smallest hash among its ``gram``-word
sequences (the leftmost of equals). Equal windows have equal anchors at equal offsets, and
overlapping windows mostly share one, so there are far fewer anchors than windows.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20250311)
_BYTES = _random.integers(1, 1 << 63, 256, np.uint64)
_POWERS = np.cumprod(np.concatenate(([1], np.full(4095, 0x9E3779B97F4A7C15, np.uint64))).astype(np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word (and one past the end), and a 64-bit hash of each word.

    ``joined`` has its words separated by one space.
    """
    data = np.frombuffer(joined, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(data == 32) + 1, [len(data) + 1]))
    place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))[: len(data)]
    weighed = np.where(data == 32, np.uint64(0), _BYTES[data] * _POWERS[place & 4095])
    return starts, mixed(np.add.reduceat(weighed, starts[:-1]))


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each ``length`` words in a row, from hashes of doubling lengths."""
    whole, at, done, have, size = None, 0, 0, words, 1
    n = len(words) - length + 1
    while length >> at:
        if length >> at & 1:
            part = have[done : done + n]
            whole = part if whole is None else mixed(whole * _STEP + part)
            done += size
        have = mixed(have[: len(have) - size] * _STEP + have[size:]) if len(have) > size else have[:0]
        size, at = 2 * size, at + 1
    return whole


def leftmost_minima(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest value in each ``span`` values in a row."""
    n = len(values) - span + 1
    best, places, size = values, np.arange(len(values)), 1
    while 2 * size <= span:
        first, second = best[:-size], best[size:]
        left = first <= second
        best, places, size = np.where(left, first, second), np.where(left, places[:-size], places[size:]), 2 * size
    first, second = best[:n], best[span - size : span - size + n]
    return np.where(first <= second, places[:n], places[span - size : span - size + n])


def window_anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and position of each anchor, and the first window filed under it (and one past the last window)."""
    hashes = sequence_hashes(words, gram)
    places = leftmost_minima(hashes, window - gram + 1)
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1))
    positions = places[firsts]
    return hashes[positions], positions, np.append(firsts, len(places))
