import numpy as np
import pandas as pd

from keepsake.operators import coverage


def test_similarities_come_in_strips():
    """A pair of blocks never holds all its similarities at once."""
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(600, 8)), rng.normal(size=(500, 8))
    whole = np.zeros((600, 500))
    for own, sims in coverage.strips(pd.Series(list(a)), pd.Series(list(b))):
        assert len(sims) <= coverage.STRIP < 600
        whole[own] = sims
    assert np.allclose(whole, a @ b.T)
