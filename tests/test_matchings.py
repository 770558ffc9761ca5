"""Matchings over near pairs against those of a grid of all pairs."""

import numpy as np
import pandas as pd
import pytest

from quillspark.operators import biblio, matchings


@pytest.mark.parametrize(("held", "cells", "steps"), [(10**9, 2_000_000, 10), (0, 50, 10), (10**9, 70, 0)])
def test_matchings_as_in_a_grid_of_all_pairs(monkeypatch, held, cells, steps):
    for name, value in (("HELD", held), ("CELLS", cells), ("STEPS", steps)):
        monkeypatch.setattr(matchings, name, value)
    rng = np.random.default_rng(3)
    some = 0
    for n, m, limit in [(30, 30, 0.8), (45, 20, 0.8), (20, 47, 0.6), (40, 12, 0.45), (25, 25, 0.3), (5, 9, 0.01), (1, 1, 0.9)] * 4:
        x, y = rng.normal(size=(n, 8)), rng.normal(size=(m, 8))
        y[: m // 4] = x[: m // 4] if n >= m // 4 else y[: m // 4]
        x[n // 2 : n // 2 + 3] = x[0]  # equal rows
        x, y = biblio._unit(pd.Series(list(x))), biblio._unit(pd.Series(list(y)))
        same = np.where(np.arange(n) < min(3, m), np.arange(n), -1)
        grid = biblio._distances(x, y)
        grid[np.flatnonzero(same >= 0), same[same >= 0]] = 1.0
        near = matchings.NearRows(x, y, same, limit, biblio._distances)
        assert near.any() == (grid < limit).any()
        got, want = biblio.matching(near, limit), biblio.matching(grid, limit)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9
        some += got[1] > 0
        got, want = biblio.repeated_matching(near, limit), biblio.repeated_matching(grid, limit)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-6
    assert some > 15


def test_a_pair_of_authors_holds_near_pairs_alone():
    """3,000 articles each: a grid of all pairs has 72 MB, and so has each of its copies."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x, y = (biblio._unit(pd.Series(list(rng.normal(size=(3000, 64))))) for _ in "xy")
    tracemalloc.start()
    near = matchings.NearRows(x, y, np.full(3000, -1), 0.7, biblio._distances)
    value, n = biblio.matching(near, 0.7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 2900 and value > 0.3 * n
    assert most < 100e6
