"""Every query with SQL gives what DuckDB gives; those without give rows that hold what must hold."""

import pytest

from compare import assert_same
from conftest import DATA
from sedge.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_all_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def q(spark, name):
    return catalogue.QUERIES[name](spark, DATA).toPandas()


def test_p_values(spark):
    m = q(spark, "mwu_pvalues")
    assert ((m.p_value >= 0) & (m.p_value <= 1) & (m.adj_p >= m.p_value - 1e-9)).all()
    c = q(spark, "chi2_pvalues")
    assert c.p_value.between(0, 1).all()


def test_shapley_adds_up(spark):
    s = q(spark, "shapley_values")
    assert s.groupby("id").shap.sum().between(-1, 1).all()


def test_models(spark):
    r = q(spark, "rf_fold")
    assert ((r.y_pred_proba_class_0 + r.y_pred_proba_class_1 - 1).abs() < 1e-5).all()
    assert len(q(spark, "pca")) == 500
    assert q(spark, "logit").y_pred.isin([0, 1]).all()


def test_near_duplicates_represent_themselves(spark):
    n = q(spark, "near_duplicate_clusters")
    assert set(n.representative) <= set(n.p_partkey)


def test_ward_clusters_refine(spark):
    w = q(spark, "ward_clusters")
    counts = w.groupby("threshold").cluster.nunique().sort_index()
    assert (counts.diff().dropna() <= 0).all()
    first, last = w[w.threshold == w.threshold.min()], w[w.threshold == w.threshold.max()]
    both = first.merge(last, on="feature")
    assert (both.groupby("cluster_x").cluster_y.nunique() == 1).all()


def test_bootstrap(spark):
    b = q(spark, "bootstrap_accuracy").dropna()
    assert ((b.low <= b["mean"] + 1e-9) & (b["mean"] <= b.high + 1e-9)).all()
