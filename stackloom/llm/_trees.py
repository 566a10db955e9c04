"""Spanning trees of links inside one task."""

from __future__ import annotations

import numpy as np


def joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (smallest member of each row's tree) after linking rows u and v."""
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
