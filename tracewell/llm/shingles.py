"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from tracewell.llm.common import GOLD, mix


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased and nothing else."""
    return text.lower().split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def shingle_set(tokens: list[bytes], n: int) -> np.ndarray:
    """Distinct hashes, sorted, of all n consecutive tokens; fewer tokens are one shingle, none is the empty set."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = hashes(tokens)
    width = min(n, len(h))
    out = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = mix(out * GOLD + h[k : len(h) - width + 1 + k])
    return np.unique(mix(out))
