"""The registered query keeps sequences up to the operator's own 100,000 characters."""

from sedge.plans import catalogue


def test_long_sequences_stay(spark, tmp_path):
    d = str(tmp_path)
    texts = ["A" * n for n in (3000, 3001, 100_000, 100_001)] + ["A" * 5000 + "N"]
    docs = [(i, "s", "en", t, len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, source string, lang string, text string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 0.5)], "doc_id bigint, quality double").write.parquet(f"{d}/labels.parquet")
    got = catalogue.QUERIES["sequence_filters_100k"](spark, d).collect()
    assert sorted((r.transcript_id, r.trimmed) for r in got) == [(0, 3000), (1, 3001), (2, 100_000)]
