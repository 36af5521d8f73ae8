"""Small cases with answers worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from sedge.functions import ids
from sedge.functions.dates import partial_date
from sedge.functions.numbers import binary_entropy, chi_square_tail, midrank, share_rank, two_sided_normal
from sedge.operators import attribution, features, linkage, sampling, scores, sequences, stats, tables, uncertainty
from sedge.sources import files, html


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_entropy(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,), (None,)], "p double").select(binary_entropy(F.col("p")).alias("h"))
    assert [None if h is None else round(h, 6) for (h,) in values(df, "h")] == [0, 0.811278, 1, 0, None]
    u = uncertainty.uncertainty_metrics(spark.createDataFrame([(0.0, 1.0)], "a double, b double"), ["a", "b"])
    assert values(u, "H_exp", "H_pred", "I_bald") == [(0, 1, 1)]


def test_high_wins_over_low(spark):
    df = spark.createDataFrame([(i, 0.5, 0.5) for i in range(4)], "id int, H_pred double, I_bald double")
    assert {g for (g,) in values(uncertainty.entropy_groups(df), "entropy_group")} == {"high"}
    with pytest.raises(ValueError):
        uncertainty.entropy_groups(df, "other")


def test_mann_whitney(spark):
    rows = spark.createDataFrame([("f", 0, 1.0), ("f", 0, 2.0), ("f", 0, 2.0), ("f", 1, 2.0), ("f", 1, 3.0)], "feature string, grp int, value double")
    ((u, a, d),) = values(stats.mann_whitney(rows, ["feature"]), "statistic", "vda", "abs_vda")
    assert (u, round(a, 6), round(d, 6)) == (5, 0.833333, 0.333333)


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 2, 3)], "v int").withColumn("g", F.lit(0))
    out = df.select(midrank("v", ["g"]).alias("r"), share_rank("v", ["g"]).alias("a"), share_rank("v", ["g"], "min").alias("m"))
    assert sorted(values(out, "r", "a", "m")) == [(1, 0.2, 0.2), (3, 0.6, 0.4), (3, 0.6, 0.4), (3, 0.6, 0.4), (5, 1, 1)]


def test_chi_square(spark):
    cells = [("f", a, b) for a, b, n in ((0, 0, 10), (0, 1, 20), (1, 0, 30), (1, 1, 40)) for _ in range(n)]
    counts = stats.contingency(spark.createDataFrame(cells, "feature string, value int, grp int"), ["feature"])
    ((c, v, o),) = values(stats.chi_square(counts, ["feature"]), "statistic", "cramers_v", "odds_ratio")
    assert (round(c, 6), round(v, 6), round(o, 6)) == (0.446429, 0.066815, 0.680128)


def test_tails(spark):
    df = spark.createDataFrame([(1.959963985, 3.841458821, 1.0), (0.0, 18.307038053, 10.0)], "z double, x double, k double")
    out = df.select(two_sided_normal(F.col("z")).alias("n"), chi_square_tail(F.col("x"), F.col("k")).alias("c"))
    assert [(round(a, 6), round(b, 6)) for a, b in values(out, "n", "c")] == [(0.05, 0.05), (1, 0.05)]


def test_fdr(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005, 0.5))], "i int, p_value double")
    got = {i: round(a, 6) for i, a in values(stats.adjusted(df), "i", "adj_p")}
    assert got == {0: 0.025, 1: 0.05, 2: 0.05, 3: 0.025, 4: 0.5}


def test_macro_scores(spark):
    df = spark.createDataFrame([(True, True), (True, True), (False, False), (False, True)], "t boolean, real boolean")
    df = spark.createDataFrame([(True, True), (False, True), (False, False), (False, False)], "t boolean, real boolean")
    ((a, b, p, r, f),) = values(scores.classification_scores(df, ["t"], average="macro"), *scores.MEASURES)
    assert [round(x, 6) for x in (a, b, p, r, f)] == [0.75, 0.75, 0.833333, 0.75, 0.733333]


def test_ids(spark):
    df = spark.createDataFrame([("ENST1.2|ENSG3.4|x|lncRNA|",)], "s string")
    c = F.col("s")
    forms = (ids.simple_id, ids.clean_id, ids.id_version, ids.biotype, ids.join_key)
    assert df.select(*(f(c) for f in forms)).first() == ("ENST1.2", "ENST1", "2", "lncRNA", "ENST1.2")


def test_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("07.2024", "2024-07", "2024", "x", "13.2024")], "s string")
    day = datetime.date
    got = [d for (d,) in values(df.select(partial_date(F.col("s")).alias("d")), "d")]
    assert got == [day(2024, 7, 15), day(2024, 7, 15), day(2024, 6, 15), None, None]


def test_checkpoints(spark):
    df = spark.createDataFrame([("b", 1, 0.9), ("a", 2, 0.1), ("b", 3, 0.8)], "dataset string, run int, acc double")
    assert values(attribution.best_checkpoints(df, 1), "dataset") == [("b",)]
    assert values(attribution.best_checkpoints(df, 1, "as_coded"), "dataset") == [("a",)]


def test_balanced_split_and_folds(spark):
    df = spark.createDataFrame([(i, "pc") for i in range(10)] + [(10 + i, "lnc") for i in range(4)], "id int, label string")
    train = sampling.balanced_split(df, "id", "label").where("part = 'train'").groupBy("label").count()
    assert sorted(values(train, "label", "count")) == [("lnc", 3), ("pc", 3)]
    folds = sampling.contiguous_folds(spark.range(23), "id").groupBy("fold").count()
    assert {f: n for f, n in values(folds, "fold", "count")} == {**{i: 2 for i in range(10)}, None: 3}


def test_percentile_and_silhouette(spark):
    pairs = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.9)], "f1 string, f2 string, distance double")
    clusters = linkage.flat_clusters(linkage.ward(pairs), [0.05, 0.5, 2.0])
    assert {t: n for t, n in values(clusters.groupBy("threshold").agg(F.count_distinct("cluster").alias("n")), "threshold", "n")} == {0.05: 3, 0.5: 2, 2.0: 1}
    s = {t: x for t, x in values(features.silhouette(pairs, clusters), "threshold", "silhouette")}
    assert s[0.05] is None and s[2.0] is None and round(s[0.5], 6) == round(2 * (0.8 / 0.9) / 3, 6)


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">ENST1.1|ENSG1.1|d1|d2|lncRNA|\nACGT\nAC\n>ENST2.1|ENSG2.1|d|e|protein_coding|\nGG\n")
    rows = files.transcript_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(values(rows, "transcript_id", "gene_id", "description", "biotype", "sequence")) == [
        ("ENST1.1", "ENSG1.1", "d1|d2", "lncRNA", "ACGTAC"), ("ENST2.1", "ENSG2.1", "d|e", "protein_coding", "GG"),
    ]
    files.write_fasta(rows, str(tmp_path / "out"), width=4)
    assert sorted(values(files.fasta(spark, str(tmp_path / "out")), "sequence")) == [("ACGTAC",), ("GG",)]
    (tmp_path / "a.gtf").write_text('#x\n1\th\ttranscript\t1\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1";\n1\th\texon\t1\t9\t.\t+\t.\tgene_id "G1";\n')
    assert values(files.gtf_transcripts(spark, str(tmp_path / "a.gtf")), "gene_id", "transcript_id", "transcript_type") == [("G1", "T1", None)]
    (tmp_path / "a.clstr").write_text(">Cluster 0\n0\t9nt, >T1... *\n1\t8nt, >T2... at +/95%\n")
    assert values(files.cluster_representatives(spark, str(tmp_path / "a.clstr")), "id") == [("T1",)]
    (tmp_path / "p.json").write_text('{"_comment": "x", "low": ["a", "b"]}')
    assert values(files.picks(spark.read.text(str(tmp_path / "p.json"), wholetext=True)), "group", "id") == [("low", "a"), ("low", "b")]
    (tmp_path / "m.txt").write_text("ACC: 0.9\nLOSS: 0.1\nAUC: 0.95\n[[5 1]\n [2 7]]\n")
    assert values(files.metrics_directory(spark, str(tmp_path / "m.txt")), "acc", "tn", "fp", "fn", "tp") == [(0.9, 5, 1, 2, 7)]
    (tmp_path / "r.out").write_text("  SW perc\nscore div\n\n 12 1.0 0.0 0.0 chr1 1 9 (5) + AluY SINE/Alu 1 9 (3) 7\nbad line\n")
    assert values(files.repeat_annotation(spark, str(tmp_path / "r.out")), "query", "repeat", "id") == [("chr1", "AluY", "7")]
    with pytest.raises(ValueError):
        files.by_suffix(spark, "a.xyz")
    registry = files.TableRegistry(spark, {"t": str(tmp_path / "{dataset}.tsv")})
    assert registry.optional("none", "t") is None
    with pytest.raises(ValueError):
        registry.load("x", ["u"])


def test_html(spark):
    pages = spark.createDataFrame([("<table><tr><td>1</td><td><b>x</b></td></tr><tr><th>2</th></tr></table>",)], "html string")
    assert values(html.table_rows(pages), "cells") == [(["1", "x"],), (["2"],)]


def test_sequences(spark):
    df = spark.createDataFrame([("NNACGNT",)], "s string")
    assert df.select(sequences.without_n_ends(F.col("s"))).first()[0] == "ACGNT"
    line = spark.createDataFrame([("ACGU(..)-1.5",), ("x",)], "s string").select(sequences.structure(F.col("s")).alias("r")).select("r.*")
    assert values(line, "rna", "ss", "mfe") == [("ACGU", "(..)", -1.5), (None, None, None)]


def test_tables(spark):
    a = spark.createDataFrame([("T1.1|ENSG1", 0.2), ("T2.1|ENSG1", 0.9)], "seq_ID string, coding_prob double")
    n = tables.normalise(a, tables.specs()["mrnn"])
    assert sorted(values(n, "seq_ID", "label_mrnn")) == [("T1.1|ENSG1", "noncoding"), ("T2.1|ENSG1", "coding")]
    with pytest.raises(ValueError):
        tables.normalise(a.drop("seq_ID"), tables.specs()["mrnn"])


def test_votes(spark):
    rows = spark.createDataFrame([(1, "a", 1, True), (2, "a", 2, True)], "fold int, feature string, rank int, selected boolean")
    ((n, s, m),) = values(attribution.votes(rows, [1, 2, 3]), "vote_count", "selected", "rfecv_rank_mean")
    assert (n, s, m) == (2, False, 334)


def test_stream_windows(spark, tmp_path):
    from sedge.streaming import folds

    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h), "a") for h in range(6)], "ts timestamp, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = folds.windowed_counts(folds.fold_stream(spark, str(tmp_path / "in"), rows.schema), "ts", ["kind"], late="1 hour")
    folds.write_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() >= 4 and {n for (n,) in values(out, "n")} == {1}
