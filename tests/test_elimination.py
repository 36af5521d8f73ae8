"""Elimination of features against data of which the telling features are known."""

import numpy as np
import pytest

from sedge.operators import ml


@pytest.fixture(scope="module")
def eliminated(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 4)).round(3)
    y = (x[:, 1] + x[:, 3] > 0).astype(int)
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, n0 double, a double, n1 double, b double, y int")
    return ml.cross_validated_elimination(
        df, ["n0", "a", "n1", "b"], "id", "y", folds=2, cv_repeats=2, step=1, trees=8, depth=4, repeats=2, parallelism=4
    )


def test_telling_features_are_left(eliminated):
    s = eliminated.selection.toPandas().set_index("feature")
    assert s["rank"].loc[["a", "b"]].tolist() == [1, 1] and s.loc[["a", "b"], "selected_by_max"].all()
    assert s.loc[s.selected, "cluster"].sort_values().tolist() == list(range(1, s.selected.sum() + 1))
    assert (s.loc[~s.selected, "cluster"] == 0).all()


def test_scores_and_steps(eliminated):
    scores, steps = eliminated.scores.toPandas(), eliminated.steps.toPandas().sort_values("step")
    assert len(scores) == 2 * 2 * 4 and set(map(tuple, scores[["repeat", "fold"]].values)) == {(r, k) for r in (0, 1) for k in (1, 2)}
    for _, own in scores.groupby(["repeat", "fold"]):
        sets = own.sort_values("step", ascending=False).features.tolist()
        assert all(set(b) < set(a) and len(a) - len(b) == 1 for a, b in zip(sets, sets[1:], strict=False))
    assert np.allclose(steps["mean"], scores.groupby("step").score.mean()) and np.allclose(steps["std"], scores.groupby("step").score.std(ddof=0))
    best = steps[steps.chosen_by_max].iloc[0]
    assert best["mean"] == steps["mean"].max() and best.step >= 2
    bound = best["mean"] - best["std"] / 2**0.5
    assert steps[steps.chosen_by_error].step.item() == steps[steps["mean"] >= bound].step.min()
