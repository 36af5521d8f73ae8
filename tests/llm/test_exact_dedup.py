import hashlib

from pyspark.sql import functions as F

from sedge.llm import exact_dedup
from sedge.llm.common import written


def lower(t):
    return (t or "").encode().lower()


def brute(rows):
    out = []
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        done = False
        for i in ids:
            kept = i == keep and not done
            done = done or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "Ab c"), (2, "aB C"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (7, "y"), (None, "x"), (None, "q"), (8, "Z" * 100_000)]


def decided(index, df):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in index.ingest(df).collect()), key=repr
    )


def test_batch_and_later_batch(spark):
    index = exact_dedup.new_index(spark, 4)
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert decided(index, df) == brute(ROWS)
    again = spark.createDataFrame([(9, "AB c"), (10, "new"), (1, "ab c")], "doc_id bigint, text string")
    later = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(again).collect()}
    assert later == {9: (2, False), 1: (2, False), 10: (10, True)}
    assert index.frame().count() == len({lower(t) for _, t in ROWS}) + 1
    assert index.compact().frame().count() == index.frame().count()


def test_a_batch_may_come_again(spark):
    index = exact_dedup.new_index(spark, 4)
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.kept) for r in index.ingest(df.where("doc_id < 6"), "a").collect() if r.kept)
    first = sorted(map(repr, index.ingest(df, "b").collect()))
    assert first == sorted(map(repr, index.ingest(df, "b").collect())) and index.frame().count() == len({lower(t) for _, t in ROWS})
    assert not any(r.kept for r in index.ingest(df, "c").collect())
    index.forget()
    assert not spark.catalog.tableExists(index.table)


def test_the_index_is_neither_shuffled_nor_sorted(spark):
    index = exact_dedup.new_index(spark, 4)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id bigint, text string")
    index.ingest(df)
    groups = written(df.select(exact_dedup.digest(F.col("text")).alias("digest")), "groups")
    with exact_dedup._sorted_buckets(spark):
        fresh = index.fresh(groups)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    side = plan[: plan.index(index.table.split(".")[-1])].splitlines()[-3:]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan
    assert not any("Sort [" in line or "Exchange" in line for line in side), plan
    assert fresh.count() == 0 and spark.conf.get(exact_dedup.SORTED_BUCKETS) == "false"


def test_many_repeats_of_one_row(spark):
    df = spark.range(10_000).selectExpr("cast(null as bigint) as doc_id", "'' as text").unionByName(
        spark.createDataFrame([(5, "a"), (5, "A")], "doc_id bigint, text string")
    )
    rows = exact_dedup.new_index(spark, 2).ingest(df).collect()
    assert len(rows) == 10_002 and sum(r.kept for r in rows) == 2 and {r.group_size for r in rows} == {10_000, 2}
    assert exact_dedup.exact_dedup(df).count() == 2


def test_stage_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(i, t, "d", "k") for i, t in ROWS], "doc_id bigint, text string, digest string, __digest2 string")
    kept = exact_dedup.exact_dedup(df, exact_dedup.new_index(spark, 4))
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len({lower(t) for _, t in ROWS}) and (2, "aB C") in rows and (4, "") in rows


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.new_index(spark, 2).ingest(df).count() == 0
    assert exact_dedup.exact_dedup(df, exact_dedup.new_index(spark, 2)).count() == 0
