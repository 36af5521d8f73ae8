"""Tails, exact U, nearest-neighbour information and Shapiro-Wilk against closed forms, brute force and known values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions.numbers import digamma, exact_u, f_tail
from sedge.operators.information import SHORTER, neighbour_information
from sedge.operators.normality import shapiro_wilk

EULER = 0.57721566490153286


def test_tail_of_f(spark):
    cases = [(f, d1, d2) for f in (0.0, 1e-3, 0.5, 1.0, 3.0, 40.0, 1e4) for d1, d2 in ((2, 1), (2, 7), (2, 1000), (5, 2), (400, 2))]
    df = spark.createDataFrame([(i, float(f), d1, d2) for i, (f, d1, d2) in enumerate(cases)], "i int, f double, d1 int, d2 int")
    got = [r.p for r in df.select("i", f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("p")).orderBy("i").collect()]
    for p, (f, d1, d2) in zip(got, cases, strict=True):
        want = (1 + d1 * f / d2) ** (-d2 / 2) if d1 == 2 else 1 - (d1 * f / (d1 * f + 2)) ** (d1 / 2)
        assert p == pytest.approx(want, abs=1e-11) and (want < 1e-8 or p == pytest.approx(want, rel=1e-9))
    known = [(4.964602744, 1, 10, 0.05), (3.325834530, 5, 10, 0.05), (2.347877567, 10, 20, 0.05), (161.4476387975881, 1, 1, 0.05)]
    df = spark.createDataFrame([(f, d1, d2, p) for f, d1, d2, p in known], "f double, d1 int, d2 int, p double")
    rows = df.select(f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("got"), "p").collect()
    assert all(r.got == pytest.approx(r.p, rel=1e-3) for r in rows) and rows[3].got == pytest.approx(0.05, abs=1e-12)


def test_digamma(spark):
    rows = spark.range(1, 40).select("id", digamma(F.col("id").cast("double")).alias("d")).collect()
    assert all(r.d == pytest.approx(sum(1 / i for i in range(1, r.id)) - EULER, abs=1e-12) for r in rows)


def test_exact_u(spark):
    cases = []
    for n1, n2 in ((1, 1), (2, 3), (4, 4), (3, 6)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            far = sum(x >= max(u, n1 * n2 - u) for x in us)
            cases.append((float(u), n1, n2, min(1.0, 2 * far / len(us))))
    df = spark.createDataFrame(cases, "u double, a int, b int, p double")
    assert all(r.got == pytest.approx(r.p, abs=1e-12) for r in df.select("p", exact_u(F.col("u"), F.col("a"), F.col("b")).alias("got")).collect())


def brute_mi(rows, k):
    groups = {g for _, g in rows}
    own = {g: [v for v, x in rows if x == g] for g in groups}
    kept = [(v, g) for v, g in rows if len(own[g]) > 1]
    values = np.array([v for v, _ in kept])
    psi = lambda n: sum(1 / i for i in range(1, n)) - EULER
    parts = []
    for v, g in kept:
        near = sorted(abs(x - v) for x in own[g])[1:]
        kk = min(k, len(near))
        parts.append(psi(kk) - psi(len(own[g])) - psi(int((np.abs(values - v) <= near[kk - 1] * SHORTER).sum())))
    return max(0.0, psi(len(kept)) + float(np.mean(parts)))


def test_neighbour_information(spark):
    rng = np.random.default_rng(5)
    kinds = {
        "tells": [(float(v), int(v > 0.2)) for v in rng.normal(size=300)],
        "nothing": [(float(v), int(g)) for v, g in zip(rng.normal(size=300), rng.integers(0, 3, 300), strict=True)],
        "ties": [(float(v), int(g)) for v, g in zip(rng.integers(0, 9, 200), rng.integers(0, 2, 200), strict=True)],
        "grid": [(i / 10, i // 7 % 2) for i in range(120)],
        "rare": [(float(v), 0) for v in rng.normal(size=60)] + [(0.5, 1), (0.1, 2), (0.3, 2)],
        "equal": [(1.0, i % 2) for i in range(10)],
    }
    rows = [(f, v, g) for f, own in kinds.items() for v, g in own]
    df = spark.createDataFrame(rows, "feature string, value double, grp int")
    for k in (3, 5):
        got = {r.feature: r.mi for r in neighbour_information(df, ["feature"], k).collect()}
        for f, own in kinds.items():
            assert got[f] == pytest.approx(brute_mi(own, k), abs=1e-9), (f, k)
    assert neighbour_information(df.limit(0), ["feature"]).count() == 0


def brute_w(x):
    """W by its definition, with Royston's weights."""
    from statistics import NormalDist

    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = n**-0.5, m / np.sqrt(m @ m)
    a = np.empty(n)
    a[-1] = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a[-2] = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / np.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def test_shapiro_wilk(spark):
    rng = np.random.default_rng(6)
    # weights of eleven men: W = 0.79 and p below 0.01 in the paper that brought the test
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    kinds = {
        "men": men, "normal": rng.normal(size=400).round(2), "exponential": rng.exponential(size=80), "ties": rng.integers(0, 4, 50),
        "seven": rng.normal(size=7), "three": [1.0, 2.0, 5.0], "two": [1.0, 2.0], "equal": [3.0] * 20, "large": rng.normal(size=70_000).round(1),
    }
    rows = [(f, float(v)) for f, own in kinds.items() for v in own] + [("men", None)]
    got = {r.feature: r for r in shapiro_wilk(spark.createDataFrame(rows, "feature string, value double"), ["feature"]).collect()}
    assert got["men"].n == 11 and got["men"].w == pytest.approx(0.79, abs=0.005) and 0.004 < got["men"].p_value < 0.01
    for f in ("men", "normal", "exponential", "ties", "seven", "large"):
        assert got[f].w == pytest.approx(brute_w(np.array(kinds[f], dtype=float)), abs=1e-9), f
        assert 0 <= got[f].p_value <= 1
    assert got["normal"].p_value > 0.01 > got["exponential"].p_value
    assert got["three"].w == pytest.approx((0.5**0.5 * 4) ** 2 / 8.666666666666666) and got["three"].p_value == pytest.approx(
        6 / math.pi * (math.asin(got["three"].w ** 0.5) - math.asin(0.75**0.5))
    )
    assert got["two"].w is None and got["equal"].w is None and got["equal"].p_value is None
