"""Hashes of all runs of words of a text, from one pass over its words."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)  # modulo 2**64


class RunHasher:
    """Hashes of runs of words: sums of word hashes times powers of an odd base, modulo 2**64, then mixed."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def load(self, words: list[bytes]) -> None:
        n = len(words) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * self.up[: n - 1])))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))
