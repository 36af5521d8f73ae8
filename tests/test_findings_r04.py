"""What a reviewer found at larger sizes, in the fourth round."""

import pytest
from pyspark.sql import functions as F

from sedge.operators import ml
from sedge.operators.permuted import permuted_calls
from sedge.operators.sampling import with_place


def _rows(spark, n):
    value = lambda c: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(97)) / 97
    rows = spark.range(n).select("id", *(value(c).alias(c) for c in "abc"))
    return rows.withColumn("y", (F.col("a") + F.col("b") / 2 > 0.7).cast("int")).localCheckpoint()


def test_rows_meet_new_values_once_for_all_sets(spark, monkeypatch):
    """each set of features dealt all rows out anew, in windows and joins of their own."""
    calls = []
    monkeypatch.setattr(ml, "with_place", lambda *a: calls.append(a) or with_place(*a))
    rows = _rows(spark, 200)
    found = ml.recursive_elimination(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), ["a", "b", "c"], "id", "y", trees=3, depth=3, repeats=2)
    assert sorted(len(r.features) for r in found.collect()) == [1, 2, 3]
    assert len(calls) == 3  # the given order and one for each repeat


@pytest.mark.parametrize("depth", [0, 6])
def test_calls_of_permuted_rows_are_those_of_the_model(spark, depth):
    """F1: the model scored each row again for each feature and repeat, which took most of the time from 0.1 GB."""
    columns = ["a", "b", "c"]
    rows = _rows(spark, 300).withColumn("b", F.when(F.col("id") % 50 == 7, F.lit(float("nan"))).when(F.col("id") % 50 > 0, F.col("b")))
    model = ml.fit_forest(rows, columns, "y", trees=9, depth=depth)
    met = ml.dealt_anew(rows, columns, "id", "y", repeats=2).localCheckpoint()
    found = permuted_calls(model, met, columns).groupBy("__f", "__y").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    own = {(r[0], r[1]): (r[2], r[3]) for r in found.collect()}
    for i, changed in enumerate([*columns, None]):
        each = met.select("__y", *((F.col("__new")[c] if c == changed else F.col(c)).alias(c) for c in columns))
        called = model.transform(ml.assembled(each, columns)).groupBy("__y").agg(F.count("prediction"), F.count_if(F.col("prediction") == F.col("__y")))
        assert {(i if changed else -1, r[0]): (r[1], r[2]) for r in called.collect()}.items() <= own.items()
    assert len(own) == 8
