import random

from sedge.operators.ranks import pair_sums, quantiles, quantiles_of, ranked, running
from sedge.plans import catalogue
from conftest import DATA
from pyspark.sql import functions as F


def test_running_sums_and_ranks(spark):
    random.seed(3)
    rows = [(random.choice("ab"), random.choice([None, 1.0, 2.5, 7.0, 9.0]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {r.i: r.rank for r in ranked(df, ["g"], "v").collect()}
    key = lambda v: (v is not None, v or 0)
    for g, v, i in rows:
        own = [key(x) for h, x, _ in rows if h == g]
        below, same = sum(x < key(v) for x in own), own.count(key(v))
        assert got[i] == below + (same + 1) / 2
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    down = {(r.g, r.v): r.before_n for r in running(counts, ["g"], "v", ["n"], descending=True).collect()}
    for g, v in down:
        assert down[g, v] == sum(h == g and key(x) > key(v) for h, x, _ in rows)
    shares = sorted(r.s for r in ranked(df.where("v IS NOT NULL"), [], "v", "s", share=True).collect())
    assert 0 < shares[0] and shares[-1] <= 1


def test_quantiles(spark):
    import numpy as np

    random.seed(5)
    rows = [(random.choice(["a", "b", None]), random.choice([None, 0.1, 0.1, random.random()])) for _ in range(400)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q1": 0.1, "q2": 0.5, "q3": 0.777, "q4": 1.0}
    got = {r.g: tuple(r)[1:] for r in quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None}
    for g, values in got.items():
        assert np.allclose(values, np.quantile([v for h, v in rows if h == g and v is not None], list(shares.values())), atol=1e-12)
    whole = quantiles(df, [], "v", shares).first()
    assert np.allclose(whole, np.quantile([v for _, v in rows if v is not None], list(shares.values())), atol=1e-12)
    assert tuple(quantiles(df.limit(0), [], "v", {"m": 0.5}).first()) == (None,)


def test_pair_sums_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (3.0, None, 5.0), (2.0, 4.0, 1.0)], "a double, b double, c double")
    got = {(r.f1, r.f2): tuple(r)[2:] for r in pair_sums(df, ["c", "a", "b"]).collect()}
    assert got[("a", "b")] == (2.0, 3.0, 6.0, 5.0, 20.0, 10.0) and got[("b", "c")] == (1.0, 4.0, 1.0, 16.0, 1.0, 4.0)
    assert pair_sums(df.limit(0), ["a", "b"]).count() == 0


def test_precision_and_recall(spark):
    p = catalogue.QUERIES["precision_recall"](spark, DATA).toPandas()
    assert p.precision.between(0, 1).all() and (p.groupby("tool").recall.max() == 1).all()


def test_elimination_and_importance(spark):
    e = catalogue.QUERIES["recursive_elimination"](spark, DATA).toPandas()
    assert e.step.tolist() == list(range(16, 0, -1)) and e.score.between(0, 1).all()
    assert all(set(b) < set(a) for a, b in zip(e.features, e.features[1:], strict=False))
    i = catalogue.QUERIES["permutation_importance"](spark, DATA).toPandas()
    assert len(i) == 16 and i.importance.between(0, 1).all()


def test_yeo_johnson_is_nearer_to_normal(spark):
    rows = spark.range(1, 400).select(F.lit("f").alias("feature"), F.exp(F.col("id") / 100).alias("value"))
    from sedge.operators.features import yeo_johnson

    r = yeo_johnson(rows).agg(F.skewness("value").alias("a"), F.skewness("transformed").alias("b"), F.max("lambda").alias("l")).first()
    assert abs(r.b) < abs(r.a) / 2 and -2 <= r.l <= 2


def test_quantiles_of_large_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = {"even": rng.normal(size=60_001), "ties": rng.integers(0, 7, 30_000).astype(float), "skewed": np.exp(rng.normal(size=20_001) * 4), "small": rng.normal(size=10)}
    df = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own] + [("even", None)], "g string, v double")
    shares = {"a": 0.0, "b": 0.00002, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.99997, "h": 1.0}
    for r in quantiles(df, ["g"], "v", shares).collect():
        want = np.quantile(groups[r.g], list(shares.values()))
        assert np.allclose(tuple(r)[1:], want, rtol=1e-12, atol=0), r.g
    both = quantiles_of(df.withColumn("w", -F.col("v")), ["g"], {"v": {"v5": 0.5, "v9": 0.9}, "w": {"w1": 0.1}})
    assert all(abs(r.v9 + r.w1) < 1e-9 for r in both.collect())
