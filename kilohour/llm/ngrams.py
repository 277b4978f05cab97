"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def laid_out(texts: list[str], pad: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each with a blank before and behind, and where each begins (and the end)."""
    lower = [f"{pad}{t.lower()}{pad}" for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)


def buckets(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the n-gram that starts at each position (the last n - 1 positions have none)."""
    grams = codes.astype(np.uint64)
    for n in range(1, max(orders) + 1):
        if n > 1:
            grams = grams[:-1] * _BASE + codes[n - 1 :]
        if n in orders:
            yield n, (((grams + np.uint64(n)) * _MIX) >> np.uint64(64 - bits)).astype(np.int32)
