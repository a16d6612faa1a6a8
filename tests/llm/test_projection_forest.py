"""Recall of the forest at production settings, on tables with one dense cluster."""

from __future__ import annotations

import numpy as np
import pytest

from fieldcast.llm import projection_forest as pf


def clustered(random, n: int, spread: float, dimensions: int = 64) -> np.ndarray:
    """A third of the rows around one centre, with pairs around a cosine of 1 / (1 + spread ** 2); the others anywhere."""
    x = random.normal(size=(n, dimensions))
    centre = random.normal(size=dimensions)
    x[: n // 3] = centre * np.sqrt(dimensions) / np.linalg.norm(centre) + spread * x[: n // 3]
    return pf.scaled(x[random.permutation(n)])


@pytest.mark.parametrize("n", [20_000, 100_000, 1_000_000])
@pytest.mark.parametrize("spread", [0.31, 0.34, 0.4])
def test_linked_pairs_meet_at_every_size(n, spread):
    # What the forest sees of a larger table is its sample and its size; vectors outside the sample stand for the rest.
    x = clustered(np.random.default_rng(4), pf.SAMPLE + 2500, spread)
    pairs, found = pf.meeting(pf.grow(x[: pf.SAMPLE], n), x[pf.SAMPLE :], pf.COSINE)
    assert pairs > 1000 and found >= 0.9 * pairs, found / pairs
