"""Word and shingle functions over whole Arrow columns (numpy inside, no per-word JVM round trips)."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_CACHE_LIMIT = 500_000


class WordHasher:
    """64-bit word hashes with a bounded memo; equal words give equal hashes in every process."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self._memo
        try:
            return np.array([memo[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(memo) > _CACHE_LIMIT:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            return np.array([memo[w] for w in words], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive word hashes; empty if there are fewer words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


def fingerprint(words: list[str]) -> bytes:
    """16-byte identity of a word sequence."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
