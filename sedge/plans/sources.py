"""Queries over readers and writers: a table is written to the shared folder as a file of some kind, and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import releases as R
from sedge.operators import stats as S
from sedge.plans.uncertainty import rounded
from sedge.plans.stats import _LONG, _long, _u
from sedge.plans.tables import _COMPARED
from sedge.plans.views import CATEGORIES, TOOL_PROBS, categories, release, table, tool_probs
from sedge.sources import files as I
from sedge.sources.scratch import scratch_path


def _lines(spark, rows, name, **options):
    """Text lines in a file of their own in the shared folder."""
    path = scratch_path(spark, name)
    rows.write.options(**options).text(path)
    return path


def _part_fasta(spark, d):
    p = table(spark, d, "part")
    title = F.concat_ws("|", F.concat(F.lit("T"), "p_partkey", F.lit(".1")), F.concat(F.lit("G"), F.col("p_size")), "p_type", "p_brand", F.lit("lncRNA"), F.lit(""))
    s = F.upper(F.regexp_replace(F.repeat("p_name", 5), "[^a-z]", ""))
    return p.select("p_partkey", title.alias("full_id"), s.alias("sequence"))


def fasta_round_trip(spark, d):
    path = scratch_path(spark, "records.fa")
    I.write_fasta(_part_fasta(spark, d), path, width=60)
    return I.unique_fasta(I.transcript_fasta(spark, path))


def fasta_ids_gz(spark, d):
    """Ids of two gzipped files of which one holds part of the other."""
    rows = _part_fasta(spark, d)
    paths = []
    for some in (rows, rows.where("p_partkey % 3 = 0")):
        text = some.select(F.concat(F.lit(">"), "full_id", F.lit("\n"), "sequence").alias("value"))
        paths.append(_lines(spark, text, "ids.fa", compression="gzip"))
    return I.fasta_ids(spark, paths)


def reference_ids(spark, d):
    """Ids of two reference files, told apart by the file they are in."""
    rows = _part_fasta(spark, d)
    sets = []
    for name, where in (("pc", "p_partkey % 2 = 0"), ("lnc", "p_partkey % 2 = 1")):
        path = scratch_path(spark, f"{name}.fa")
        I.write_fasta(rows.where(where), path)
        sets.append(I.fasta_ids(spark, [path]).withColumn("kind", F.lit(name)))
    return sets[0].unionByName(sets[1])


def _gtf_path(spark, d):
    l = table(spark, d, "lineitem")
    a = F.format_string('gene_id "G%d"; transcript_id "T%d.%d"; transcript_type "%s";', "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    kind = F.when(F.col("l_linenumber") % 2 == 1, "transcript").otherwise("exon")
    row = F.concat_ws("\t", F.lit("chr1"), F.lit("S"), kind, F.col("l_orderkey"), F.col("l_orderkey") + 9, F.lit("."), F.lit("+"), F.lit("."), a)
    head = spark.createDataFrame([("##format: gtf",)], "value string")
    return _lines(spark, l.select(row.alias("value")).unionByName(head), "annotation.gtf")


def gtf_rows(spark, d):
    return I.gtf(spark, _gtf_path(spark, d)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.max("end").alias("last"))


def gtf_transcripts(spark, d):
    return I.gtf_transcripts(spark, _gtf_path(spark, d)).select("transcript_id", "gene_id", "transcript_type", "start", "end")


def cluster_representatives(spark, d):
    o = table(spark, d, "orders")
    line = F.concat(F.col("o_orderkey") % 5, F.lit("\t99nt, >"), F.concat(F.lit("T"), "o_orderkey"), F.lit("... "), F.when(F.col("o_orderkey") % 4 == 0, "*").otherwise("at 95%"))
    title = o.select(F.concat(F.lit(">Cluster "), F.col("o_custkey")).alias("value"))
    return I.cluster_representatives(spark, _lines(spark, o.select(line.alias("value")).unionByName(title), "clusters.clstr"))


def registry_tables(spark, d):
    """Tables written under names, as text and as Parquet, and read by a registry; one is not there."""
    root = scratch_path(spark, "registry")
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name")
    I.write_tables({"nation": n}, f"{root}/v1", text=True)
    I.write_tables({"region": r}, f"{root}/v1")
    registry = I.TableRegistry(spark, {"nation": f"{root}/{{dataset}}/nation.tsv", "region": f"{root}/{{dataset}}/region.parquet", "none": f"{root}/{{dataset}}/none.csv"})
    found = registry.load("v1", ["nation", "region"])
    rows = found["nation"].select(F.lit("nation").alias("name"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")).unionByName(
        found["region"].select(F.lit("region").alias("name"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("v"))
    )
    return rows.withColumn("none_is_there", F.lit(registry.optional("v1", "none") is not None))


def dataset_bundle(spark, d):
    """Probabilities (some of them null) and labels from two files, of rows with all probabilities."""
    p = tool_probs(spark, d)
    root = scratch_path(spark, "bundle")
    probs = p.select("id", F.when(F.col("id") % 9 != 0, F.col("p0")).alias("p0"), "p1")
    I.write_tables({"probs": probs, "labels": p.select("id", "coding_class").where("id % 2 = 0")}, root)
    both = (spark.read.parquet(f"{root}/{n}.parquet") for n in ("probs", "labels"))
    return rounded(I.with_complete_probabilities(*both, "id", ["p0", "p1"]))


def full_dataset(spark, d):
    """The four frames of a data set whose binary table and full table have gaps, a row for each of their rows."""
    p = tool_probs(spark, d)
    binary = p.select("id", F.when(F.col("id") % 5 != 0, F.col("coding_class") == 1).alias("real"), (F.col("p0") > 0.5).alias("tool"))
    full = p.select("id", F.when(F.col("id") % 9 != 0, F.col("p0")).alias("p0"), "p1", F.col("p2").alias("length")).where("id % 2 = 0")
    frames = I.dataset(binary, full, "id", ["p0", "p1"], ["p1"])
    value = {"probs": F.col("p0") + F.col("p1"), "labels": F.col("coding_class") * 10 + F.length("biotype"), "features": F.col("p1") + F.col("length"), "binary": F.col("real").cast("int")}
    parts = [f.select(F.lit(n).alias("frame"), "id", value[n].cast("double").alias("value")) for n, f in frames.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


def found_feature_sets(spark, d):
    root = scratch_path(spark, "sets")
    I.write_tables({"te": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("te_count"))}, root)
    found = I.feature_sets(spark, {"te": f"{root}/te.parquet", "nonb": f"{root}/nonb.parquet"})
    return found["te"].withColumn("n_sets", F.lit(len(found)).cast("long"))


def headless_table(spark, d):
    """Text without a header, with title lines of which the second names the columns."""
    n = table(spark, d, "nation")
    line = n.select(F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    titles = spark.createDataFrame([("# made by hand",), ("key\tname\tregion",)], "value string")
    path = _lines(spark, line.unionByName(titles), "predictions.tsv")
    return I.delimited(spark, path, "key BIGINT, name STRING, region BIGINT", titles=("# ", "key\t"))


def repeat_annotation(spark, d):
    p = table(spark, d, "part")
    row = F.concat(F.lit("  "), F.concat_ws("   ", F.col("p_size"), F.lit("1.5"), F.lit("0.0"), F.lit("0.0"), F.concat(F.lit("T"), "p_partkey"), F.lit("1"), F.col("p_size") + 1, F.lit("(0)"), F.lit("+"), F.regexp_replace("p_brand", " ", ""), F.regexp_replace("p_type", " ", "_"), F.lit("1"), F.lit("9"), F.lit("(0)"), F.col("p_partkey")))
    heads = spark.createDataFrame([("   SW   perc perc perc  query  position",), ("score   div. del. ins.  sequence  begin",), ("",)], "value string")
    rows = I.repeat_annotation(spark, _lines(spark, p.select(row.alias("value")).unionByName(heads), "repeats.out"))
    return rows.select("query", F.col("score").cast("long").alias("score"), F.col("end").cast("long").alias("end"), "repeat", "family")


def bed_overlap_columns(spark, d):
    l = table(spark, d, "lineitem").where("l_linenumber = 1")
    row = F.concat_ws("\t", F.lit("chr2"), F.col("l_orderkey"), F.col("l_orderkey") + 5, F.concat(F.lit("T"), "l_partkey"), F.lit("0"), F.lit("+"), F.col("l_returnflag"))
    rows = I.bed_overlaps(spark, _lines(spark, l.select(row.alias("value")), "overlap.bed"), {3: "transcript", 1: "begin", 6: "element"})
    return rows.select("transcript", F.col("begin").cast("long").alias("begin"), "element")


def json_concat(spark, d):
    """Two files that hold an array of records each."""
    n = table(spark, d, "nation")
    paths = []
    for k in (0, 1):
        some = n.where(F.col("n_nationkey") % 2 == k).agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
        paths.append(_lines(spark, some.coalesce(1), "families.json"))
    return I.json_records(spark, paths).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def training_metrics(spark, d):
    """A text for each run, with three numbers and a matrix of counts."""
    r = table(spark, d, "region")
    k = F.col("r_regionkey").cast("int")
    text = F.format_string("ACC: 0.%d\nLOSS = 1.%d\nauc: 0.5\n[[%d 2]\n [3 4]]\n", k, k, k)
    root = scratch_path(spark, "runs")
    r.select(text.alias("value"), k.alias("run")).write.partitionBy("run").option("lineSep", "\n").text(root)
    runs = I.metrics_directory(spark, f"{root}/run=*")
    return rounded(runs.select(F.regexp_extract("file", r"run=(\d+)", 1).cast("long").alias("run"), "acc", "loss", "auc", "tn", "fp", "fn", "tp"))


def structure_cache(spark, d):
    p = table(spark, d, "part")
    body = F.when(F.col("p_partkey") % 5 == 0, "no structure").otherwise(F.concat(F.lit("acgu(..)-"), F.col("p_size"), F.lit(".5")))
    text = p.select(F.concat(F.lit(">T"), "p_partkey", F.lit("\n"), body).alias("value"))
    return I.structure_cache(spark, _lines(spark, text, "structures.fa"))


def fold_artefacts(spark, d):
    """Tables of three folds of which one was never written."""
    root = scratch_path(spark, "folds")
    for k in (1, 3):
        tool_probs(spark, d).where(F.col("id") % 5 == k).select("id", "coding_class").write.parquet(f"{root}/fold{k}/report.parquet")
    return I.fold_tables(spark, f"{root}/{{fold}}/report.parquet", ["fold1", "fold2", "fold3"])


def saved_groups(spark, d):
    path = scratch_path(spark, "groups.tsv")
    p = tool_probs(spark, d)
    p.where("p0 > 0.6").select("id", F.when(F.col("p1") > 0.5, "high").otherwise("low").alias("entropy_group")).write.csv(path, sep="\t", header=True)
    return I.with_saved_groups(p.select("id"), I.delimited(spark, path).select(F.col("id").cast("long").alias("id"), "entropy_group"), "id")


def exported_categories(spark, d):
    """Sequences of the categories of a comparison of two releases, written as FASTA files and read back."""
    compared = R.compare(release(spark, d, "old"), release(spark, d, "new"))
    sequences = release(spark, d, "new").select(
        F.col("new_full_id").alias("full_id"), F.translate(F.md5("clean_id"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("sequence")
    )
    root = scratch_path(spark, "categories")
    I.write_categories(compared, sequences, root, R.CATEGORIES)
    parts = [I.fasta(spark, f"{root}/{c}_transcripts.fa").withColumn("category", F.lit(c)) for c in R.CATEGORIES]
    return reduce(DataFrame.unionByName, parts)


def json_and_scalar(spark, d):
    """A list of names as JSON and one number as text, written and read back."""
    root = scratch_path(spark, "chosen")
    I.json_list(table(spark, d, "nation"), "n_name").coalesce(1).write.text(f"{root}/features.json")
    I.write_scalar(table(spark, d, "nation").agg(F.max("n_nationkey").alias("m")), f"{root}/threshold.txt")
    names = spark.read.text(f"{root}/features.json").select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "name"))
    return names.crossJoin(spark.read.text(f"{root}/threshold.txt").select(F.col("value").cast("long").alias("threshold")))  # one row


def pairwise_results(spark, d):
    """The combined run over two groups, its three tables written and read back; p-values are left to the tests."""
    root = scratch_path(spark, "pairwise")
    I.write_pairwise(S.pairwise_results(_long(spark, d), categories(spark, d)), root, "a_b")
    u = spark.read.parquet(f"{root}/a_b_mannwhitney.parquet").select("feature", F.lit("u").alias("kind"), F.col("statistic").alias("x"), F.col("vda").alias("y"))
    f = spark.read.parquet(f"{root}/a_b_cat_freq.parquet").select("feature", F.lit("percent").alias("kind"), F.col("group1").alias("x"), F.col("group2").alias("y"))
    return rounded(u.unionByName(f))


def joint_fdr(spark, d):
    """One family of p-values over two tables."""
    o = table(spark, d, "orders")
    p = lambda m: (F.pmod(F.col("o_totalprice").cast("decimal(18,2)") * 100, F.lit(m)).cast("double") / m).alias("p_value")
    both = S.jointly_adjusted({"a": o.where("o_orderkey % 2 = 0").select("o_orderkey", p(9973)), "b": o.where("o_orderkey % 2 = 1").select("o_orderkey", p(9941))})
    return rounded(both.select("family", "o_orderkey", "adj_p", "significant"), 9)


def pearson_matrix(spark, d):
    return rounded(S.pearson(tool_probs(spark, d).unpivot(["id"], ["p0", "p1", "p2", "p3"], "feature", "value")))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_round_trip, fasta_ids_gz, reference_ids, gtf_rows, gtf_transcripts, cluster_representatives, registry_tables, dataset_bundle, full_dataset,
        found_feature_sets, headless_table, repeat_annotation, bed_overlap_columns, json_concat, training_metrics, structure_cache,
        fold_artefacts, saved_groups, exported_categories, json_and_scalar, pairwise_results, joint_fdr, pearson_matrix,
    )
}
_FASTA = (
    "f AS (SELECT p_partkey, 'T' || p_partkey || '.1' AS transcript_id, 'G' || p_size AS gene_id, p_type || '|' || p_brand AS description, 'lncRNA' AS biotype, "
    "upper(regexp_replace(repeat(p_name, 5), '[^a-z]', '', 'g')) AS sequence FROM part), g AS (SELECT *, transcript_id || '|' || gene_id || '|' || "
    "description || '|lncRNA|' AS full_id FROM f)"
)
_GTF = (
    "g AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'transcript' ELSE 'exon' END AS feature, l_orderkey AS start, l_orderkey + 9 AS \"end\", "
    "'G' || l_partkey AS gene_id, 'T' || l_orderkey || '.' || l_linenumber AS transcript_id, l_returnflag AS transcript_type FROM lineitem)"
)
ORACLE_SQL = {
    "fasta_round_trip": f"WITH {_FASTA} SELECT * EXCLUDE (p_partkey) FROM g",
    "fasta_ids_gz": f"WITH {_FASTA} SELECT DISTINCT transcript_id AS id FROM g",
    "reference_ids": f"WITH {_FASTA} SELECT transcript_id AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pc' ELSE 'lnc' END AS kind FROM g",
    "gtf_rows": f'WITH {_GTF} SELECT feature, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, max("end") AS last FROM g GROUP BY feature',
    "gtf_transcripts": f"WITH {_GTF} SELECT * EXCLUDE (feature) FROM g WHERE feature = 'transcript'",
    "cluster_representatives": "SELECT 'T' || o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0",
    "registry_tables": "SELECT 'nation' AS name, CAST(n_nationkey AS BIGINT) AS k, n_name AS v, FALSE AS none_is_there FROM nation UNION ALL SELECT 'region', "
    "r_regionkey, r_name, FALSE FROM region",
    "dataset_bundle": f"WITH {TOOL_PROBS} SELECT id, round(p0, 6) AS p0, round(p1, 6) AS p1, coding_class FROM tool_probs WHERE id % 9 <> 0 AND id % 2 = 0",
    "full_dataset": f"WITH {TOOL_PROBS}, k AS (SELECT * FROM tool_probs WHERE id % 2 = 0 AND id % 5 <> 0 AND id % 9 <> 0) SELECT 'probs' AS frame, id, round(p0 + 1 - "
    "p1, 6) AS value FROM k UNION ALL SELECT 'labels', id, CASE WHEN coding_class = 1 THEN 16::DOUBLE ELSE 6 END FROM k UNION ALL SELECT 'features', id, round(p1 + p2, 6) "
    "FROM k UNION ALL SELECT 'binary', id, CASE WHEN id % 5 <> 0 THEN CAST(coding_class AS DOUBLE) END FROM tool_probs",
    "found_feature_sets": "SELECT p_partkey AS id, p_size AS te_count, CAST(1 AS BIGINT) AS n_sets FROM part",
    "headless_table": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation",
    "repeat_annotation": "SELECT 'T' || p_partkey AS query, CAST(p_size AS BIGINT) AS score, CAST(p_size + 1 AS BIGINT) AS \"end\", replace(p_brand, ' ', '') "
    "AS repeat, replace(p_type, ' ', '_') AS family FROM part",
    "bed_overlap_columns": "SELECT 'T' || l_partkey AS transcript, CAST(l_orderkey AS BIGINT) AS begin, l_returnflag AS element FROM lineitem WHERE l_linenumber = 1",
    "json_concat": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "training_metrics": "SELECT CAST(r_regionkey AS BIGINT) AS run, CAST('0.' || r_regionkey AS DOUBLE) AS acc, CAST('1.' || r_regionkey AS DOUBLE) AS loss, "
    "CAST(0.5 AS DOUBLE) AS auc, CAST(r_regionkey AS BIGINT) AS tn, CAST(2 AS BIGINT) AS fp, CAST(3 AS BIGINT) AS fn, CAST(4 AS BIGINT) AS tp FROM region",
    "structure_cache": "SELECT 'T' || p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'acgu' END AS rna, CASE WHEN p_partkey % 5 <> 0 THEN '(..)' END AS ss, "
    "CASE WHEN p_partkey % 5 <> 0 THEN -(p_size + 0.5)::DOUBLE END AS mfe FROM part",
    "fold_artefacts": f"WITH {TOOL_PROBS} SELECT id, coding_class, 'fold' || (id % 5) AS fold FROM tool_probs WHERE id % 5 IN (1, 3)",
    "saved_groups": f"WITH {TOOL_PROBS} SELECT id, CASE WHEN p0 > 0.6 THEN CASE WHEN p1 > 0.5 THEN 'high' ELSE 'low' END END AS entropy_group FROM tool_probs",
    "exported_categories": f"{_COMPARED}, s AS (SELECT x.*, translate(md5(clean_id), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM x) "
    + " UNION ALL ".join(f"SELECT new_full_id AS full_id, sequence, '{c}' AS category FROM s WHERE {c}" for c in R.CATEGORIES),
    "json_and_scalar": "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS place, n_name AS name, CAST((SELECT max(n_nationkey) FROM nation) AS "
    "BIGINT) AS threshold FROM nation",
    "pairwise_results": f"WITH {_LONG}, {_u('l')}, {CATEGORIES} SELECT feature, 'u' AS kind, round(CAST(statistic AS DOUBLE), 6) AS x, round(vda, 6) AS y FROM u "
    "UNION ALL SELECT feature, 'percent', round(100 * avg(value) FILTER (grp = 0), 6), round(100 * avg(value) FILTER (grp = 1), 6) FROM categories GROUP BY feature",
    "joint_fdr": "WITH t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS family, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN "
    "CAST((CAST(o_totalprice AS DECIMAL(18, 2)) * 100) % 9973 AS DOUBLE) / 9973 ELSE CAST((CAST(o_totalprice AS DECIMAL(18, 2)) * 100) % 9941 AS DOUBLE) / 9941 "
    "END AS p FROM orders), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM t), j AS (SELECT *, least(min(p * n / k) OVER "
    "(ORDER BY k DESC), 1) AS q FROM k) SELECT family, o_orderkey, round(q, 9) AS adj_p, q < 0.01 AS significant FROM j",
    "pearson_matrix": f"WITH {TOOL_PROBS}, x AS (UNPIVOT (SELECT id, p0, p1, p2, p3 FROM tool_probs) ON p0, p1, p2, p3 INTO NAME feature VALUE value) SELECT "
    "a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r FROM x a JOIN x b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL",
}
