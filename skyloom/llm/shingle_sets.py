"""Word shingles of texts as hashes, and names of their sets."""

from __future__ import annotations

import numpy as np
import xxhash


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle, repeats included; none for a text without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - shingle + 1)
    last = ends[min(shingle, len(parts)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def set_name(own: np.ndarray) -> int:
    """The hash of a set of shingles (signed, sorted, without repeats), as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), 42)).astype(np.int64))
