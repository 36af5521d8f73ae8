"""Kendall's tau against all pairs of rows."""

import random

import numpy as np
import pytest

from sedge.operators.concordance import sign_sum
from sedge.operators.stats import kendall


def test_sign_sum():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 200):
        for most in (1, 3, 1000):
            x, y = draw.integers(0, most, n), draw.integers(0, most, n)
            want = sum(np.sign(x[i] - x[:i]) @ np.sign(y[i] - y[:i]) for i in range(n))
            assert sign_sum(x, y) == want


@pytest.mark.parametrize("blocks", [1, 7, 512])
def test_kendall_with_ties_and_nulls(spark, blocks):
    random.seed(blocks)
    kinds = {
        "a": lambda: random.random(),
        "b": lambda: random.choice([0.0, 0.0, 0.0, random.random()]),  # one value holds most rows
        "c": lambda: random.choice([None, 1.0, 2.0, random.random()]),
        "d": lambda: 4.0,
    }
    table = [{f: draw() for f, draw in kinds.items()} for _ in range(150)]
    rows = spark.createDataFrame([(i, f, v) for i, t in enumerate(table) for f, v in t.items()], "id int, feature string, value double")
    got = {(r.f1, r.f2): r.tau for r in kendall(rows, blocks=blocks).collect()}
    assert len(got) == 6
    for (f, g), tau in got.items():
        both = np.array([(t[f], t[g]) for t in table if t[f] is not None and t[g] is not None])
        x, y = (np.sign(c[:, None] - c[None, :]) for c in both.T)
        below = np.sqrt((x * x).sum() * (y * y).sum())
        assert tau is None if below == 0 else abs(tau - (x * y).sum() / below) < 1e-9
    assert kendall(rows.limit(0)).count() == 0
