"""The cheapest path in blocks against all paths."""

import itertools

import numpy as np
import pandas as pd
import pytest

from wavelathe.operators import paths
from wavelathe.operators.blocks import Blocks
from wavelathe.operators.paths import Prices, cheapest_path


def price(path, rows, p):
    """Of a path of candidates (None: unvoiced) of rows of (f0, voicing)."""
    total, was, change = 0.0, None, 0.0
    for c, row in zip(path, rows):
        f = row[c][0] if c is not None else 0.0
        q = row[c][1] if c is not None else 1 - max([v for _, v in row], default=0.0)
        total += -p.local * np.log(min(max(q, 1e-6), 1.0))
        if f > 0:
            total += (q < p.cutoff) + p.range_ * (f < 100 or f > 350)
        if was is not None:
            if f > 0 and was > 0:
                now = np.log(f / was)
                total += p.vv * abs(now) + p.vvd * abs(now - change)
                change = now
            else:
                total += p.uu if f == 0 and was == 0 else p.vuv
                change = 0.0
        was = f
    return total


@pytest.mark.parametrize("prices", [Prices(), Prices(vvd=30.0, vuv=1.0), Prices(vvd=0.0, uu=2.0, vuv=0.5)])
def test_cheapest_of_all_paths(spark, prices):
    rng = np.random.default_rng(3)
    data = {}
    for k in range(12):
        n = int(rng.integers(1, 8))
        data[k] = [[(float(rng.choice([0.0, 90, 120, 150, 200, 240, 400])) * float(rng.uniform(0.9, 1.1)), float(rng.uniform(0, 1))) for _ in range(int(rng.integers(0, 3)))] for _ in range(n)]
    rows = [(k, i, [f for f, _ in r], [v for _, v in r]) for k, x in data.items() for i, r in enumerate(x)]
    level = spark.createDataFrame(rows, "k int, vidx long, f array<double>, v array<double>")
    best = {k: min(price(p, x, prices) for p in itertools.product(*[[None, *range(len(r))] for r in x])) for k, x in data.items()}
    for size in (2, 3, 100):
        got = {}
        for r in cheapest_path(level, Blocks(("k",), size), "f", "v", 2, prices).collect():
            got.setdefault(r["k"], {})[r["vidx"]] = r["f0final"]
        for k, x in data.items():
            path = [got[k][i] for i in range(len(x))]
            # A value may be that of several candidates; the price of the best of them counts.
            options = [[None] * (f == 0) + [c for c, (v, _) in enumerate(r) if v == f] for f, r in zip(path, x)]
            assert min(price(p, x, prices) for p in itertools.product(*options)) == pytest.approx(best[k], rel=1e-9, abs=1e-9)
    assert cheapest_path(level.limit(0), Blocks(("k",), 2), "f", "v").count() == 0


def test_steps_are_priced_many_rows_at_once(monkeypatch):
    """The prices of a block's steps are one array; cut into parts it gives the same, from a series' start and within it."""
    rng = np.random.default_rng(7)
    f = [rng.uniform(60, 400, rng.integers(0, 4)) for _ in range(20)]
    for first in (0, 20):
        part = pd.DataFrame({"vidx": np.arange(20) + first, "_f": f, "_v": [rng.uniform(0, 1, 3) for _ in f], "_f1": [None, *f[:-1]], "_f2": [None, None, *f[:-2]]})
        r = paths._Rows(part, 3, paths.Prices())
        assert r.steps(0, 20).shape == (20, 4, 4, 4)
        whole = [d for d, _ in r.forward(np.zeros((4, 4)))]
        monkeypatch.setattr(paths, "_PART", 3)
        assert np.array_equal(whole, [d for d, _ in r.forward(np.zeros((4, 4)))])
        monkeypatch.undo()
