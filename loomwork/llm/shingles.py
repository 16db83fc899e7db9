"""Sets of word shingles as sorted 64-bit hashes, straight from Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomwork.llm.common import text_bytes
from loomwork.llm.suffix_dedup import BYTE_VALUE, powers

WORDS = 5
#: Bytes of text hashed at a time.
PIECE = 1 << 19

_lower = np.arange(256)
_lower[65:91] += 32
#: ASCII letters count in lower case.
FOLDED = BYTE_VALUE[_lower]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PLACES = BYTE_VALUE[:64] | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(d: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``d``; no word runs across a position in ``firsts``."""
    word = ~SPACE[d]
    cut = np.zeros(len(d) + 1, bool)
    cut[firsts[firsts < len(d)]] = True
    cut[0] = cut[-1] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | cut[:-1]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = powers(max(1, len(d)))
    h = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(FOLDED[d] * up[: len(d)], out=h[1:])
    return start, mixed((h[end] - h[start]) * down[start])


def _long_word_hashes(d: np.ndarray) -> np.ndarray:
    """Of one long text, cut at white space."""
    out, at = [], 0
    while at < len(d):
        to = min(len(d), at + PIECE)
        while to < len(d) and not SPACE[d[to]]:
            gap = np.flatnonzero(SPACE[d[at:to]])
            to = at + int(gap[-1]) + 1 if len(gap) else min(len(d), to + PIECE)
            if len(gap):
                break
        out.append(_word_hashes(d[at:to], np.zeros(0, np.int64))[1])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    s = w[: len(w) - k + 1] * PLACES[0]
    for j in range(1, k):
        s = s + w[j : len(w) - k + 1 + j] * PLACES[j]
    return mixed(s)


def _short(w: np.ndarray) -> np.ndarray:
    """Fewer words than a shingle has: all of them as one."""
    return mixed((w * PLACES[: len(w)]).sum(keepdims=True) + np.uint64(len(w)) * PLACES[20:21]) if len(w) else w[:0]


def shingle_sets(text: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """A sorted array of distinct shingle hashes for every text of an Arrow string array."""
    ends, data = text_bytes(text)
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and ends[j + 1] - ends[i] <= PIECE:
            j += 1
        lo, hi = int(ends[i]), int(ends[j])
        if hi - lo > PIECE:
            w = _long_word_hashes(data[lo:hi])
            yield np.unique(_shingle_hashes(w, k)) if len(w) >= k else _short(w)
        else:
            start, w = _word_hashes(data[lo:hi], ends[i:j] - lo)
            s = _shingle_hashes(w, k) if len(w) >= k else w[:0]
            at = np.searchsorted(start, ends[i : j + 1] - lo).tolist()
            for a, b in zip(at, at[1:]):
                yield np.unique(s[a : b - k + 1]) if b - a >= k else _short(w[a:b])
        i = j
