"""p-values and intervals that need more than sums."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np


def signed_rank_p(x: np.ndarray) -> float:
    """Two-sided signed-rank p: exact for up to 50 values without ties, else normal with the
    tie term. Zeros are dropped; without any other value p is 1."""
    x = x[x != 0]
    n = len(x)
    if not n:
        return 1.0
    a = np.abs(x)
    values, where, counts = np.unique(a, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[where]
    plus = float(ranks[x > 0].sum())
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[:int(low) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return float(erfc(abs(low - n * (n + 1) / 4) / sqrt(var) / sqrt(2)))


def block_bootstrap(sums: np.ndarray, counts: np.ndarray, draws: int = 5000, seed: int = 2026) -> tuple[float, float]:
    """Interval of a mean when whole blocks are drawn again: how often each block comes up is
    multinomial, and a draw's mean is its weighted sum over its weighted count."""
    blocks = len(sums)
    times = np.random.default_rng(seed).multinomial(blocks, np.full(blocks, 1 / blocks), draws)
    low, high = np.quantile((times @ sums) / (times @ counts), (0.025, 0.975))
    return float(low), float(high)
