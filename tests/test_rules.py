"""Hand-computed cases of rules with thresholds, nulls and corrections."""

import math

import numpy as np
import pytest

from sedge.operators import releases, stats, uncertainty


def test_agreement_of_tools(spark):
    rows = [
        (1, 0.1, 0.15, 0.9, 0.95),  # two strong on either side
        (2, 0.1, 0.15, 0.5, 0.6),  # two on one side, none on the other
        (3, 0.1, 0.15, 0.05, 0.9),  # three of four on one side, one on the other
        (4, 0.5, None, 0.2, 0.8),  # edges are moderate, a null is neither
        (5, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1, 0.0, 0.0, 0.0) for r in rows], "id int, a double, b double, c double, d double, coding_class int, H_pred double, H_exp double, I_bald double")
    got = {r.id: r for r in uncertainty.tool_agreement(df, list("abcd"), carried=("id",)).collect()}
    flags = {i: (r.extreme_disagreement, r.extreme_agreement, r.majority_agreement) for i, r in got.items()}
    assert flags == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True), 4: (False, False, False), 5: (False, False, False)}
    assert (got[4].n_strong_lnc, got[4].n_strong_coding, got[4].n_moderate) == (0, 0, 3) and got[4].mean_prob == pytest.approx(0.5)
    assert got[4].variance == pytest.approx(0.09) and got[4].range == pytest.approx(0.6) and got[4].ensemble_pred == 0
    assert got[5].mean_prob is None and got[5].variance is None and got[5].ensemble_pred == 0
    assert got[1].n_moderate == 0 and got[1].true_label == 1


def test_release_flags(spark):
    old = [("a", "a.1", "1", "x", "pc"), ("b", "b.1", "1", "x", "NA"), ("c", "c.1", "1", "x", "lncRNA"), ("d", "d.1", "1", "x", None), ("f", "f.1", "1", "x", "pc")]
    new = [("a", "a.2", "2", "x", "lncRNA"), ("b", "b.1", "1", "y", "pc"), ("d", "d.1", "1", "x", "NA"), ("e", "e.1", "1", "x", "lncRNA"), ("f", "f.1", "1", "x", "pc"), ("g", "g.1", "1", "x", None)]
    side = lambda rows, s: spark.createDataFrame(rows, ", ".join(["clean_id string", *(f"{s}_{c} string" for c in ("full_id", "id_version", "biotype", "class"))]))
    compared = releases.compare(side(old, "old"), side(new, "new"))
    assert len(releases.FLAGS) == 21
    got = {r.clean_id: {f for f in releases.FLAGS if r[f]} for r in compared.collect()}
    gone = {"version_changed", "biotype_changed"}
    assert got == {
        "a": {"is_common", "version_changed", "both_have_class", "class_changed", "common_class_change", "pc_to_lncRNA"},
        "b": {"is_common", "biotype_changed", "class_added"},
        "c": {"transcript_removed", "removed_with_class", "removed_lncRNA", *gone},
        "d": {"is_common", "no_class"},
        "e": {"transcript_added", "added_with_class", "added_lncRNA", *gone},
        "f": {"is_common", "both_have_class", "same_class", "common_same_class"},
        "g": {"transcript_added", "no_class", *gone},
    }
    assert {r.clean_id: r.category for r in releases.categories(compared).collect()} == {
        "a": "common_class_change", "d": "no_class", "e": "added_with_class", "f": "common_same_class", "g": "no_class",
    }


def test_contrasts(spark):
    # f: 3 and 4 values without ties, so p is exact; one is null. g: all values alike.
    rows = [("f", "x", v) for v in (1.0, 2.0, 5.0, None)] + [("f", "y", v) for v in (3.0, 4.0, 6.0, 7.0)]
    rows += [("g", "x", 1.0)] * 3 + [("g", "y", 1.0)] * 4 + [("h", "x", 1.0)] * 2 + [("h", "y", 2.0)] * 4
    df = spark.createDataFrame(rows, "feature string, label string, value double")
    contrasts = spark.createDataFrame([("x vs y", "x", "y")], "name string, g1 string, g2 string")
    got = {r.feature: r for r in stats.contrast_tests(df, contrasts, more_than=2).collect()}
    assert set(got) == {"f", "g"}  # h has two values in x
    f, g = got["f"], got["g"]
    # ranks of x: 1, 2, 5, so U is 8 - 6; of 35 orders 1 has U of 0, 1 of 1 and 2 of 2, and as many lie on the other side
    assert (f.n1, f.n2, f.u_stat) == (3, 4, 2) and f.vda == pytest.approx(2 / 12) and f.p_value == pytest.approx(8 / 35)
    assert f.cliffs_delta == pytest.approx(-(2 * 8 / 21 - 1)) and (f.median_g1, f.median_g2, f.median_diff) == (2, 5, -3)
    assert f.p_fdr == pytest.approx(8 / 35) and f.logp_score == pytest.approx(-math.log10(8 / 35)) and not f.sig_fdr05
    assert g.p_value is None and g.vda == 0.5 and g.cliffs_delta == 0
    sd = np.std([-3, 0], ddof=1)
    assert f.norm_diff == pytest.approx(3 / sd) and g.norm_diff == 0
    assert f.meta_rank == pytest.approx(1) and g.meta_rank == pytest.approx(0.5)


def test_element_statistics(spark):
    rows = [("t", 1, v, c) for v, c in ((0.0, None), (2.0, 1.0), (3.0, 4.0), (None, None))] + [("t", 0, v, c) for v, c in ((0.0, 2.0), (0.0, 3.0), (1.0, None))]
    rows += [("only", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "feature string, grp int, value double, cov double")
    got = {r.feature: r for r in stats.element_statistics(df, ["feature"], coverage="cov").collect()}
    t = got["t"]
    assert t.mean_1 == pytest.approx(5 / 3) and t.percent_1 == pytest.approx(200 / 3) and t.percent_0 == pytest.approx(100 / 3)
    # above 0 and 0, with the halves: coding 2.5 and 1.5, other 1.5 and 2.5; of eight
    assert t.odds_ratio == pytest.approx(25 / 9) and t.chi2 == pytest.approx(0.5) and t.phi == pytest.approx(math.sqrt(0.5 / 6))
    assert t.p_chi2 == pytest.approx(math.erfc(0.5)) and t.statistic == 7 and t.vda == pytest.approx(7 / 9)
    assert t.statistic_coverage == 2 and t.p_value_coverage == pytest.approx(1) and t.mean_coverage_0 == 2.5
    only = got["only"]
    assert only.chi2 is None and only.p_chi2 is None and only.statistic is None and only.mean_1 == 1


def test_corrections_with_nulls_and_ties(spark):
    ps = [0.01, 0.04, 0.04, None, 0.5, 0.01]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")
    want = {
        "fdr_bh": [0.025, 0.05, 0.05, None, 0.5, 0.025], "holm": [0.05, 0.12, 0.12, None, 0.5, 0.05],
        "bonferroni": [0.05, 0.2, 0.2, None, 1.0, 0.05], "fdr_by": [0.025 * 137 / 60, 0.05 * 137 / 60, 0.05 * 137 / 60, None, 1.0, 0.025 * 137 / 60],
    }
    for method, adj in want.items():
        got = {r.i: r.adj_p for r in stats.adjusted(df, method=method).collect()}
        assert [got[i] if a is None else pytest.approx(a) == got[i] for i, a in enumerate(adj)] == [None if a is None else True for a in adj], method
    assert stats.adjusted(df.limit(0)).count() == 0


def test_large_tables_of_chi_square(spark):
    cells = [("f", v, g) for v in range(5) for g in range(3) for _ in range(v * g + v + 2)] + [("f", None, 0)] * 4 + [("one", 1, 0), ("one", 1, 1)]
    counts = stats.contingency(spark.createDataFrame(cells, "feature string, value int, grp int"), ["feature"])
    (r,) = stats.chi_square(counts, ["feature"]).collect()
    o = np.array([[v * g + v + 2 + 4 * (v == 0 and g == 0) for g in range(3)] for v in range(5)], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert r.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and r.dof == 8 and r.n == o.sum()
