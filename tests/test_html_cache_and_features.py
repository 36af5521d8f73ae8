"""HTML tables, the keyed cache, Yeo-Johnson's lambda, and bootstraps against what resampling rows gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators.features import yeo_johnson
from sedge.operators.uncertainty import bootstrap_accuracy
from sedge.sources.cache import Cache, id_digest
from sedge.sources.html import tables_of

PAGE = """<table class="a"><tr><th>x<th colspan=2>y &amp; z</tr><tr><td rowspan="2">1<td>2<td>3<br/>4</tr><tr><td>5
<td rowspan=x>6 <script>var t = "<td>";</script></tr></table><td>outside</td>
<table><tr><td>in<table class='b c'><tr><td rowspan=3>n</td></tr></table> side</td><td></td></tr><tr></tr>"""


def test_html_tables():
    first, second, inner = tables_of(PAGE)
    assert first == ("a", [(["x", "y & z", "y & z"], True), (["1", "2", "3 4"], False), (["1", "5", "6"], False)])
    assert second == ("", [(["in side", ""], False), ([], False)])
    assert inner == ("b c", [(["n"], False)])
    assert tables_of("") == [] and tables_of("<table><td colspan=2000>w")[0][1][0][0] == ["w"] * 1000
    spans = tables_of("<table><tr><td>a<td rowspan=2>b<td>c</tr><tr><td>d<td>e</tr><tr><td>f</tr></table>")
    assert [cells for cells, _ in spans[0][1]] == [["a", "b", "c"], ["d", "b", "e"], ["f"]]


def test_cache(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    rows = spark.range(50).withColumn("v", F.col("id") * 2)
    assert cache.entries() == [] and cache.load("t", {"a": 1}) is None
    first, there = cache.get("t", {"a": 1, "b": [2]}, rows, lambda: rows)
    again, found = cache.get("t", {"b": [2], "a": 1}, rows.orderBy(F.desc("id")).repartition(3), lambda: 1 / 0)
    assert (there, found) == (False, True) and again.count() == 50
    other, found = cache.get("t", {"a": 1, "b": [2]}, rows.where("id < 9"), lambda: rows.where("id < 9"))
    assert not found and other.count() == 9 and first.count() == 50  # the version before can still be read
    with pytest.raises(ZeroDivisionError):
        cache.get("t", {"a": 1, "b": [2]}, rows, lambda: 1 / 0, anew=True)
    assert cache.load("t", {"a": 1, "b": [2]}, rows.where("id < 9")).count() == 9 and len(cache.entries()) == 1
    assert cache.drop("t", {"a": 1, "b": [2]}) and cache.about("t", {"a": 1, "b": [2]}) is None
    assert id_digest(rows.unionByName(rows), "id") != id_digest(rows, "id") == id_digest(rows.repartition(7), "id")


def test_lambdas_have_the_largest_likelihood(spark):
    rng = np.random.default_rng(7)
    kinds = {"normal": rng.normal(size=300), "exponential": rng.exponential(size=300), "left": -rng.exponential(size=300), "steep": np.exp(rng.normal(size=200) * 3) * 1e-4, "equal": np.full(10, 2.0)}
    rows = [(f, float(v)) for f, own in kinds.items() for v in own] + [("normal", None)]
    got = {r["feature"]: r["lambda"] for r in yeo_johnson(spark.createDataFrame(rows, "feature string, value double")).select("feature", "lambda").distinct().collect()}

    def fit(x, l):
        p, n = x >= 0, x < 0
        t = np.empty_like(x)
        t[p] = np.log1p(x[p]) if abs(l) < 1e-12 else ((x[p] + 1) ** l - 1) / l
        t[n] = -np.log1p(-x[n]) if abs(l - 2) < 1e-12 else -((1 - x[n]) ** (2 - l) - 1) / (2 - l)
        return -len(x) / 2 * np.log(t.var()) + (l - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for f, x in kinds.items():
        if f == "equal":
            assert got[f] == 1
            continue
        grid = np.arange(got[f] - 4, got[f] + 4, 0.01)
        assert fit(x, got[f]) >= max(fit(x, l) for l in grid) - 1e-6
    assert got["steep"] < -2


def test_bootstrap_is_that_of_rows(spark):
    rng = np.random.default_rng(8)
    real, called, bins = rng.random(400) < 0.4, rng.random(400) < 0.5, rng.integers(0, 3, 400)
    called |= real & (bins == 2)
    data = [(int(b), bool(r), bool(c)) for b, r, c in zip(bins, real, called, strict=True)]
    df = spark.createDataFrame([*data, (9, True, True), (None, False, False)], "bin int, real boolean, called boolean")
    got = {r.bin: r for r in bootstrap_accuracy(df, "bin", "real", "called", n_boot=2000).collect()}
    b, r, c = np.append(bins, [9, -1]), np.append(real, [True, False]), np.append(called, [True, False])
    want = {k: [] for k in (0, 1, 2, 9, -1)}
    for _ in range(2000):
        at = rng.integers(0, 402, 402)
        for k, out in want.items():
            own = at[b[at] == k]
            if len(own):
                out.append(np.mean([np.mean(c[own][r[own] == y] == y) for y in (True, False) if (r[own] == y).any()]))
    for k, out in want.items():
        mine = got[None if k < 0 else k]
        assert abs(mine.mean - np.mean(out)) < 0.01
        assert np.abs(np.array([mine.low, mine.high]) - np.percentile(out, [2.5, 97.5])).max() < 0.03
    assert got[9].mean == 1 and bootstrap_accuracy(df.limit(0), "bin", "real", "called").count() == 0
