"""Word and shingle hashes of whole Arrow batches, without a Python loop over words."""
from __future__ import annotations

import numpy as np

#: bytes that separate words in shingle operators
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(0x5EED)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word (A-Z folded), and the bounds of each text's words in that row."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
    word = ~BLANK[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = np.flatnonzero(word)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    hashed = np.add.reduceat(_BYTE[FOLD[raw[inside]]] * powers(int(sizes.max()))[place], first)
    return mixed(hashed + sizes.astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; of fewer words, the whole sequence as one."""
    words, bounds = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled += words[j:j + len(rolled)] * _PLACE[j % 64]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed((words[a:b] * _PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
