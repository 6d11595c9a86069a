"""P(similarity >= t | m of k values match) under a uniform prior, by numeric integration."""

import numpy as np


def posterior(m, k, t):
    s = np.linspace(0, 1, 200_001)
    density = s**m * (1 - s) ** (k - m)
    return density[s >= t].sum() / density.sum()
