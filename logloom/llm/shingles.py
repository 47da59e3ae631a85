"""Sets of hashed word shingles, for many texts at a time in numpy."""

from __future__ import annotations

import hashlib
import re

import numpy as np

U = np.uint64
_G = np.random.default_rng(20240607)
_BYTE = _G.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x5851F42D4C957F2D)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_PLACE = _G.integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0d]")
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    global _powers
    if not _powers or len(_powers[0]) < n:
        steps = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(steps - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of ``data`` and the byte where it starts."""
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[a], [True]])))  # a word's first byte, the space behind it, ...
    starts, ends = edge[::2], edge[1::2]
    pw, inverse = powers(len(a) + 1)
    with np.errstate(over="ignore"):
        h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * pw[: len(a)])])
        return _mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            runs += words[i : i + len(runs)] * _PLACE[i]
        return _mix(runs)


def _set(words: np.ndarray, runs: np.ndarray, k: int) -> np.ndarray:
    if len(words) >= k:
        return np.unique(runs)
    if not len(words):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return _mix(np.array([(words * _PLACE[: len(words)]).sum(dtype=np.uint64) + U(len(words))], np.uint64))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words (lower-cased A-Z); a text of fewer words has one, an empty text none."""
    words, starts = word_hashes(b" ".join(texts).lower())
    runs = _runs(words, k)
    cut = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    return [_set(words[i:j], runs[i : max(i, j - k + 1)], k) for i, j in zip(cut[:-1], cut[1:])]


def long_set(text: bytes, k: int, most_bytes: int) -> np.ndarray:
    """The set of one long text, whose words are hashed in parts that end at spaces."""
    words, i = [], 0
    while i < len(text):
        cut = _SPACES.search(text, i + most_bytes)
        j = cut.start() if cut else len(text)
        words.append(word_hashes(text[i:j].lower())[0])
        i = j
    joined = np.concatenate(words)
    return _set(joined, _runs(joined, k), k)


def sets_of(texts: list, k: int = 5, most_bytes: int = 1 << 18):
    """``shingle_sets`` (of strings, bytes or nulls) over slices of a bounded size."""
    encoded = [(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")) if t else b"" for t in texts]
    i = 0
    while i < len(encoded):
        if len(encoded[i]) > most_bytes:
            yield long_set(encoded[i], k, most_bytes)
            i += 1
            continue
        j, size = i, 0
        while j < len(encoded) and size + len(encoded[j]) <= most_bytes:
            size += len(encoded[j])
            j += 1
        yield from shingle_sets(encoded[i:j], k)
        i = j


def set_key(values: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
