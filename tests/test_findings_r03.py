"""What a reviewer found at larger and odder sizes."""

import os

import pytest
from pyspark.sql import functions as F

from compare import TABLES, assert_same
from conftest import DATA
from sedge.plans import catalogue


def _tables(spark, path, **other):
    """A folder with the test tables, of which some are others."""
    for t in TABLES:
        if t in other:
            other[t].coalesce(1).write.parquet(f"{path}/{t}.spark")
            part = next(n for n in os.listdir(f"{path}/{t}.spark") if n.endswith(".parquet"))
            os.symlink(f"{path}/{t}.spark/{part}", f"{path}/{t}.parquet")
        else:
            os.symlink(f"{DATA}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


def _as_sql(spark, name, data=DATA):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], data)


@pytest.mark.parametrize("n", [0, 7, 10, 93])
def test_rows_left_over_are_in_no_slice(spark, tmp_path, n):
    """93 rows are ten slices of nine, seven rows ten empty ones."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").limit(n)
    _as_sql(spark, "contiguous_folds", _tables(spark, tmp_path, embeddings=e))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def seen(monkeypatch):
    """Plans of what is aggregated or collected on the way to a result."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect

    def noted(self):
        rows = collect(self)
        plans.append(_plan(self))
        return rows

    monkeypatch.setattr(DataFrame, "collect", noted)
    return plans


def test_rows_of_importance_are_not_broadcast(spark, seen):
    """rows meet their new values in a merge of as many parts as there are cores."""
    from sedge.operators import ml

    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b")).localCheckpoint()
    model = ml.fit_forest(rows, ["a", "b"], "y", trees=2, depth=2)
    before = len(seen)
    assert len(ml.permutation_importance(model, rows, ["a", "b"], "id", "y", repeats=2).collect()) == 2
    own = seen[before:][-1].split("Initial Plan")[0]
    assert any("SortMergeJoin [place" in line for line in own.splitlines()), own
    assert not any("BroadcastHashJoin [place" in line for line in own.splitlines())
    assert ml.dealt_out(rows.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_fits_do_not_depend_on_files(spark):
    """a fit is the same whether its rows come in one part or in many."""
    from sedge.operators import ml

    rows = spark.range(300).select("id", (F.col("id") % 3 > 0).cast("int").alias("y"), *((F.hash("id", F.lit(c)) % 97 / 97).alias(c) for c in "ab"))
    one, many = (ml.fit_forest(r, ["a", "b"], "y", trees=3, depth=3) for r in (rows.coalesce(1), rows.repartition(7)))
    assert one.toDebugString.splitlines()[1:] == many.toDebugString.splitlines()[1:]


def test_midranks_are_windows_over_counts(spark):
    """no window holds a row for each value."""
    _as_sql(spark, "midranks")
    from sedge.operators.ranks import tied_ranks

    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 1, 1, 2, 2, 2, 7])] + [("b", 0, 5)], "f string, v int, n long")
    got = {(r.f, r.n): (r["rank"], r.rank_down, r.share, r.share_min) for r in tied_ranks(rows, ["f"], "n").collect()}
    assert got == {
        ("a", 1): (1.5, 6.5, 1.5 / 7, 1 / 7), ("a", 2): (4, 4, 4 / 7, 3 / 7), ("a", 3): (6, 2, 6 / 7, 6 / 7), ("a", 7): (7, 1, 1, 1), ("b", 5): (1, 1, 1, 1),
    }
    plan = _plan(tied_ranks(rows, ["f"], "n"))
    after = plan[plan.index("Window") :]
    assert "HashAggregate" in after and plan.count("Window") <= 4


def test_release_pages_are_read_once(spark):
    """one task reads a page, and nothing is joined."""
    _as_sql(spark, "release_pages")
    plan = _plan(catalogue.QUERIES["release_pages"](spark, DATA))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and plan.count("Exchange") == 1  # orders, before pages are made of them


def test_plain_tags_are_read_like_all_others():
    """tags without attributes go a shorter way to the same rows."""
    from html.parser import HTMLParser

    from sedge.sources import html

    class Long(html._Reader):
        parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos

    pages = [
        "<table><tr><td>a<td>b</td></tr><TR ><td >c</td ><th>d</th></tr></table>", "<script>'<td>'</script><table><tr><td>x<br>y<p>z",
        "<!-- <table><tr><td> --><table class=a><tr><td>1<table><tr><td>2</td></tr></table>3</td></tr></table>", "<td>no</td><table><td>a&lt;b</td", "<table><tr><td>a<",
        "<style><tr></style><table><tr><td><b>q</b></td></tr></tbody></table><tr>", "<table><tr><td title='>'>v</td></tr></table>",
    ]
    for page in pages:
        reader = Long()
        reader.feed(page)
        reader.close()
        for t in reader.open:
            t.end_cell()
        assert html.tables_of(page) == [(t.kind, [(c, h and bool(c)) for c, h in t.rows]) for t in reader.tables], page


def test_patterns_of_leaves_take_little_room():
    """what each worker holds of the background rows is a few bytes for each pattern of a leaf."""
    import pickle

    import numpy as np

    from sedge.operators.tree_shap import Explainer, leaves_of

    rng = np.random.default_rng(7)
    n = 2**10 - 1  # nodes of a full tree of depth 9, each level with a feature of its own
    node = np.arange(n)
    inner = node < n // 2
    left, right = np.where(inner, 2 * node + 1, -1), np.where(inner, 2 * node + 2, -1)
    level = np.floor(np.log2(node + 1)).astype(int)
    trees = [leaves_of(left, right, level, rng.uniform(0.3, 0.7, n), rng.uniform(0.1, 0.9, n)) for _ in range(3)]
    background, x = rng.uniform(size=(500, 9)), rng.uniform(size=(40, 9))
    explainer = Explainer(trees, background)
    leaf_of = lambda tree, r: next(leaf.value for leaf in tree if leaf.met(r[None]).all())
    want = np.array([np.mean([leaf_of(t, r) for t in trees]) for r in x])
    assert np.allclose(explainer.explain(x).sum(axis=1) + explainer.base, want)
    assert len(pickle.dumps(explainer)) < 3000 * len(explainer.leaves)


def test_values_of_yeo_johnson_are_not_broadcast(spark, tmp_path, seen):
    """F8: small tables of lambdas go to the tasks; values stay where they are."""
    from sedge.operators.features import yeo_johnson

    rows = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("feature"), F.exp(F.rand(3)).alias("value"))
    rows.write.parquet(f"{tmp_path}/values")
    df = yeo_johnson(spark.read.parquet(f"{tmp_path}/values"))
    df.collect()
    joins = [p.split("Initial Plan")[0] for p in seen if "BroadcastExchange" in p]
    assert joins
    for plan in joins:
        sent = plan[plan.index("BroadcastExchange") :].split("FileScan")[0] if "FileScan" in plan[: plan.index("BroadcastExchange")] else plan[plan.index("BroadcastExchange") :]
        assert "FileScan" not in sent.split("+- ")[1]
        assert "BuildRight" in plan and "BuildLeft" not in plan
