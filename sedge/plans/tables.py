"""Queries about tables of predictions, releases and scores, each with SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import ids
from sedge.functions.dates import partial_date
from sedge.operators import releases as R
from sedge.operators import scores as C
from sedge.operators import tables as T
from sedge.plans.uncertainty import MEAN, rounded
from sedge.plans.views import (
    RELEASES, TOOL_LABELS, TOOL_PROBS, TOOLS, TRANSCRIPTS, release, table, tool_labels, tool_probs, transcripts,
)


def _seq_id(c):
    return F.concat(F.lit("ENST"), c, F.lit("."), c % 7, F.lit("|ENSG"), c % 40, F.lit(".1|x|"), F.when(c % 3 == 0, "lncRNA").otherwise("protein_coding"), F.lit("|"))


_SEQ_ID = "'ENST' || {0} || '.' || ({0} % 7) || '|ENSG' || ({0} % 40) || '.1|x|' || CASE WHEN {0} % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END || '|'"


def _predictions(spark, d):
    """Three tools' tables with columns of their own, over different rows."""
    p = tool_probs(spark, d).withColumn("s", _seq_id(F.col("id")))
    feelnc = p.where("id % 5 <> 0").select(F.col("s").alias("name"), (F.col("p0") > 0.5).cast("int").alias("label"), F.round("p0", 6).alias("coding_potential"))
    cpat = p.where("id % 7 <> 0").select(
        F.col("s").alias("seq_ID"), F.col("s").alias("ID"), (F.col("id") * 3 + 300).alias("mRNA"), (F.col("id") % 50).alias("ORF_start"),
        (F.col("id") % 50 + F.col("id") + 99).alias("ORF_end"), F.round("p1", 6).alias("Coding_prob"),
    )
    lncdc = p.where("id % 3 <> 0").select(
        F.col("s").alias("Description"), F.round(1 - F.col("p2"), 6).alias("Noncoding_prob"), F.when(F.col("p2") > 0.5, "mrna").otherwise("lncrna").alias("predict")
    )
    return feelnc, cpat, lncdc


def _full(spark, d):
    s = T.specs()
    return T.merge_tools([T.normalise(t, s[n]) for t, n in zip(_predictions(spark, d), ("feelnc", "cpat", "lncdc"), strict=True)])


def tool_outer_merge(spark, d):
    return rounded(T.with_metadata(_full(spark, d)))


def two_mode_merge(spark, d):
    p = tool_probs(spark, d)
    a = p.where("id % 3 <> 0").select("id", F.round("p0", 6).alias("score"), "coding_class")
    b = p.where("id % 4 <> 0").select("id", F.round("p1", 6).alias("score"), F.round("p2", 6).alias("extra"))
    return T.two_modes(a, b, "id", ("_full", "_partial"))


def _id_sets(spark, d):
    p = tool_probs(spark, d).select(_seq_id(F.col("id")).alias("seq_ID"), "coding_class", "id")
    return p.where("coding_class = 1 AND id % 11 <> 0").select("seq_ID"), p.where("coding_class = 0 OR id % 13 = 0").select("seq_ID")


def _simple(spark, d):
    pc, lnc = _id_sets(spark, d)
    return T.simple_table(T.class_table(T.with_metadata(_full(spark, d))), "seq_ID", pc, lnc)


def class_table(spark, d):
    return T.class_table(T.with_metadata(_full(spark, d)))


def simple_table(spark, d):
    return _simple(spark, d)


def unclassified_table(spark, d):
    return T.unclassified_table(_simple(spark, d))


def binary_table(spark, d):
    return T.binary_table(_simple(spark, d))


def classify_transcripts(spark, d):
    t, l = transcripts(spark, d), table(spark, d, "labels")
    pc, lnc = l.where("quality = 1").select("doc_id"), l.where("toxic = 1").select("doc_id")
    return T.with_real_class(t.select("transcript_id", "biotype"), "transcript_id", pc, lnc, other="other")


def fold_union(spark, d):
    l = table(spark, d, "lineitem")
    parts = [l.where(F.col("l_linenumber") == i).select("l_orderkey", *(["l_quantity"] if i > 1 else []), "l_tax") for i in (1, 2, 3)]
    merged = T.merge_folds(parts)
    return rounded(merged.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"), F.count_if(F.col("l_quantity").isNull()).alias("n_null")))


def beside_frames(spark, d):
    p = tool_probs(spark, d)
    a = p.where("id < 300").select("id", F.round("p0", 6).alias("x"), F.round("p1", 6).alias("y"))
    b = p.where("id > 200").select("id", F.round("p2", 6).alias("y"), F.round("p3", 6).alias("z"))
    return T.beside([a, b], "id")


def aligned_rows(spark, d):
    p = tool_probs(spark, d)
    return T.aligned(p.select("id"), p.where("id % 2 = 0").select("id", F.round("p0", 6).alias("x")), "id")


def aligned_on_cut_keys(spark, d):
    """Rows whose keys carry more after a bar, by ids that do not."""
    p = tool_probs(spark, d).select("id", "p0", _seq_id(F.col("id")).alias("s"))
    rows = p.where("id % 3 <> 0").select(F.col("s").alias("key"), F.round("p0", 6).alias("x"))
    return T.aligned(p.select(F.split_part("s", F.lit("|"), F.lit(1)).alias("key")), rows, "key", None, cut=True)


def ordered_lookup(spark, d):
    c = table(spark, d, "customer")
    order = c.where("c_acctbal > 0").select("c_custkey", (1000000 - F.col("c_custkey")).alias("position"))
    return T.ordered_lookup(order, c.select("c_custkey", "c_name"), "c_custkey")


def subsets(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    kinds = [("class", ["BUILDING", "MACHINERY"]), ("contains", ["UILD", "OUSE"]), ("startswith", ["AUTO"]), ("all", [])]
    parts = [T.subset(c, k, "c_mktsegment", v).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, v in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def semi_anti_joins(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    with_orders = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", F.lit("with").alias("side"))
    without = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", F.lit("without").alias("side"))
    return with_orders.unionByName(without)


def id_set_ops(spark, d):
    l = table(spark, d, "lineitem")
    a, b = l.where("l_returnflag = 'A'").select("l_partkey"), l.where("l_returnflag = 'R'").select("l_partkey")
    tag = lambda df, n: df.withColumn("op", F.lit(n))
    return (
        tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.subtract(b), "except"))
    )


def _events_dates(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MM.yyyy")).when(F.col("event_id") % 7 == 0, "soon").when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy")).otherwise(F.date_format("ts", "yyyy-MM"))
    return e.select("event_id", "event_type", text.alias("text"))


def timeline_dates(spark, d):
    tools = _events_dates(spark, d).where("event_type <> 'click'").select(F.col("event_type").alias("tool"), "event_id", partial_date(F.col("text")).alias("date"))
    rel = _events_dates(spark, d).where("event_type = 'click'").select(F.col("text").alias("version"), "event_id", partial_date(F.col("text")).alias("date"))
    return tools.unionByName(rel, allowMissingColumns=True).where("date IS NOT NULL").orderBy("date", "event_id").withColumn("date", F.col("date").cast("string"))


def nearest_release(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    rel = o.groupBy(F.trunc("day", "month").alias("day")).agg(F.min("o_orderkey").alias("version"))
    return T.nearest(o, rel, "day", "day", "version").withColumn("day", F.col("day").cast("string"))


def id_normal_forms(spark, d):
    e = tool_probs(spark, d).select("id", _seq_id(F.col("id")).alias("s"))
    c = F.col("s")
    return e.select("id", ids.simple_id(c).alias("simple_id"), ids.clean_id(c).alias("clean_id"), ids.id_version(c).alias("id_version"),
        ids.biotype(c).alias("biotype"), ids.join_key(c).alias("join_key"), ids.dotted_id(c).alias("dotted_id"), ids.without_version(ids.simple_id(c)).alias("bare"))


def _compared(spark, d):
    return R.compare(release(spark, d, "old"), release(spark, d, "new"))


def release_flags(spark, d):
    return _compared(spark, d)


def release_flag_totals(spark, d):
    return _compared(spark, d).agg(*(F.count_if(f).alias(f) for f in R.FLAGS)).unpivot([], R.FLAGS, "flag", "n")


def release_flow(spark, d):
    return R.flow(_compared(spark, d))


def release_flow_totals(spark, d):
    return R.flow_totals(R.flow(_compared(spark, d)))


def release_categories(spark, d):
    return R.categories(_compared(spark, d))


def cv_scores_binary(spark, d):
    return rounded(C.classification_scores(tool_labels(spark, d), TOOLS, by=["fold"]))


def cv_scores_macro(spark, d):
    return rounded(C.classification_scores(tool_labels(spark, d), TOOLS, by=["fold"], average="macro"))


def _summary(spark, d):
    return C.over_folds(C.classification_scores(tool_labels(spark, d), TOOLS, by=["fold"]))


def cv_summary(spark, d):
    return rounded(_summary(spark, d))


def cv_rows_with_totals(spark, d):
    return rounded(C.with_totals(C.classification_scores(tool_labels(spark, d), TOOLS, by=["fold"]), ["f1", "accuracy"]))


def best_variant(spark, d):
    named = _summary(spark, d).withColumn("tool", F.concat("tool", F.lit("_m"), F.substring("tool", 2, 1).cast("int") % 3))
    return rounded(C.best_variant(named).select("base", "tool", "f1_mean"))


def stability(spark, d):
    return rounded(C.stability(_summary(spark, d)))


def consensus_counts(spark, d):
    return C.consensus_counts(tool_labels(spark, d), TOOLS)


def consensus_pct(spark, d):
    return rounded(C.consensus_shares(tool_labels(spark, d), TOOLS))


def combination_counts(spark, d):
    return C.combinations(tool_labels(spark, d), TOOLS)


def combination_top(spark, d):
    return C.combinations(tool_labels(spark, d), TOOLS[:4], top=5)


def set_totals(spark, d):
    return C.set_totals(tool_labels(spark, d), TOOLS)


def vote_histogram(spark, d):
    labels = tool_labels(spark, d).join(tool_probs(spark, d).select("id", sum_mean().alias("mean_prob")), "id")
    return rounded(C.vote_histogram(labels, TOOLS, "mean_prob"))


def sum_mean():
    from sedge.operators.uncertainty import row_mean

    return row_mean(TOOLS)


def length_summary(spark, d):
    return rounded(C.length_summary(transcripts(spark, d), "biotype"))


def value_shares(spark, d):
    return rounded(C.value_shares(transcripts(spark, d), "quality"))


def null_counts(spark, d):
    return C.null_counts(transcripts(spark, d))


def constant_columns(spark, d):
    rows = tool_probs(spark, d).select("p0", "coding_class", F.lit(1).alias("one"), F.when(F.lit(False), 1).alias("nothing"))
    return C.constant_columns(rows, rows.columns)


QUERIES = {
    f.__name__: f
    for f in (
        tool_outer_merge, two_mode_merge, class_table, simple_table, unclassified_table, binary_table, classify_transcripts,
        fold_union, beside_frames, aligned_rows, aligned_on_cut_keys, ordered_lookup, subsets, semi_anti_joins, id_set_ops, timeline_dates,
        nearest_release, id_normal_forms, release_flags, release_flag_totals, release_flow, release_flow_totals,
        release_categories, cv_scores_binary, cv_scores_macro, cv_summary, cv_rows_with_totals, best_variant, stability,
        consensus_counts, consensus_pct, combination_counts, combination_top, set_totals, vote_histogram, length_summary,
        value_shares, null_counts, constant_columns,
    )
}

_FULL = (
    f"{TOOL_PROBS}, s AS (SELECT *, {_SEQ_ID.format('id')} AS s, 'ENST' || id || '.' || (id % 7) AS key FROM tool_probs), "
    "a AS (SELECT key, s AS seq_ID, CASE WHEN p0 > 0.5 THEN 'coding' ELSE 'noncoding' END AS label_feelnc, round(p0, 6) AS "
    "coding_potential_feelnc FROM s WHERE id % 5 <> 0), b AS (SELECT key, CASE WHEN round(p1, 6) < 0.364 THEN 'noncoding' ELSE "
    "'coding' END AS label_cpat, id * 3 + 300 AS mRNA_cpat, id % 50 AS ORF_start_cpat, id % 50 + id + 99 AS ORF_end_cpat, "
    "round(p1, 6) AS Coding_prob_cpat, round((id + 100)::DOUBLE / (id * 3 + 300), 6) AS orf_coverage_cpat FROM s WHERE id % 7 <> 0), "
    "c AS (SELECT key, CASE WHEN p2 > 0.5 THEN 'coding' ELSE 'noncoding' END AS label_lncdc, round(1 - p2, 6) AS "
    "Noncoding_prob_lncdc FROM s WHERE id % 3 <> 0), f AS (SELECT * FROM a FULL JOIN b USING (key) FULL JOIN c USING (key)), "
    "m AS (SELECT *, split_part(seq_ID, '|', 1) AS metadata, split_part(seq_ID, '|', -2) AS biotype FROM f)"
)
_SIMPLE = (
    f"{_FULL}, pc AS (SELECT s AS seq_ID FROM s WHERE coding_class = 1 AND id % 11 <> 0), lnc AS (SELECT s AS seq_ID FROM s WHERE "
    "coding_class = 0 OR id % 13 = 0), cl AS (SELECT seq_ID, label_feelnc, label_cpat, label_lncdc, biotype FROM m), si AS (SELECT "
    "*, CASE WHEN seq_ID IN (SELECT seq_ID FROM lnc) THEN 'noncoding' WHEN seq_ID IN (SELECT seq_ID FROM pc) THEN 'coding' END AS "
    "label_real FROM cl), si2 AS (SELECT * FROM si WHERE label_real IS NOT NULL)"
)
_EVENT_TEXT = (
    "e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%m.%Y') WHEN event_id % 7 = 0 THEN 'soon' "
    "WHEN event_id % 5 = 0 THEN strftime(ts, '%Y') ELSE strftime(ts, '%Y-%m') END AS text FROM events), "
    "p AS (SELECT *, CASE WHEN regexp_matches(text, '^\\d{2}\\.\\d{4}$') THEN CAST(text[4:] || '-' || text[1:2] || '-15' AS DATE) "
    "WHEN regexp_matches(text, '^\\d{4}-\\d{2}$') THEN CAST(text || '-15' AS DATE) WHEN regexp_matches(text, '^\\d{4}$') THEN "
    "CAST(text || '-06-15' AS DATE) END AS date FROM e)"
)
_COMPARED = (
    f"WITH {RELEASES}, j AS (SELECT *, old_full_id IS NOT NULL AND new_full_id IS NOT NULL AS co, old_full_id IS NULL AS ad, new_full_id "
    "IS NULL AS re, coalesce(old_class, 'NA') AS oc, coalesce(new_class, 'NA') AS nc FROM old_release FULL JOIN new_release USING "
    "(clean_id)), x AS (SELECT clean_id, old_full_id, old_id_version, old_biotype, old_class, new_full_id, new_id_version, new_biotype, "
    "new_class, co AS is_common, ad AS transcript_added, re AS transcript_removed, old_id_version IS DISTINCT FROM new_id_version AS "
    "version_changed, old_biotype IS DISTINCT FROM new_biotype AS biotype_changed, co AND oc <> 'NA' AND nc <> 'NA' AS both_have_class, "
    "both_have_class AND oc = nc AS same_class, both_have_class AND oc <> nc AS class_changed, co AND oc = 'NA' AND nc <> 'NA' AS "
    "class_added, co AND oc <> 'NA' AND nc = 'NA' AS class_removed, co AND same_class AS common_same_class, co AND class_changed AS "
    "common_class_change, common_class_change AND oc = 'pc' AND nc = 'lncRNA' AS \"pc_to_lncRNA\", common_class_change AND oc = 'lncRNA' "
    "AND nc = 'pc' AS \"lncRNA_to_pc\", ad AND nc <> 'NA' AS added_with_class, added_with_class AND nc = 'pc' AS added_pc, "
    "added_with_class AND nc = 'lncRNA' AS \"added_lncRNA\", re AND oc <> 'NA' AS removed_with_class, removed_with_class AND oc = 'pc' AS "
    "removed_pc, removed_with_class AND oc = 'lncRNA' AS \"removed_lncRNA\", NOT re AND nc = 'NA' AS no_class FROM j)"
)
_CODE = "CASE WHEN {0}_class = 'pc' THEN 0 WHEN {0}_class = 'lncRNA' THEN 1 WHEN {0}_full_id IS NOT NULL THEN 2 ELSE 3 END"
_FLOW = f"{_COMPARED}, fl AS (SELECT {_CODE.format('old')} AS source, {_CODE.format('new')} AS target, count(*) AS n FROM x GROUP BY ALL)"
_LONG = (
    f"WITH {TOOL_LABELS}, l AS (UNPIVOT tool_labels ON {', '.join(TOOLS)} INTO NAME tool VALUE call), c AS (SELECT fold, tool, "
    "count(*) FILTER (real AND call)::DOUBLE AS tp, count(*) FILTER (NOT real AND call)::DOUBLE AS fp, count(*) FILTER (NOT real AND "
    "NOT call)::DOUBLE AS tn, count(*) FILTER (real AND NOT call)::DOUBLE AS fn FROM l GROUP BY ALL), "
    "q AS (SELECT fold, tool, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / "
    "nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, "
    "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM c), "
    "b AS (SELECT fold, tool, accuracy, (r1 + r0) / 2 AS balanced_accuracy, p1 AS precision, r1 AS recall, f1 FROM q)"
)
_SUMMARY = (
    f"{_LONG}, v AS (SELECT tool, "
    + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in C.MEASURES)
    + " FROM b GROUP BY tool)"
)
_CORRECT = "(" + " + ".join(f"CAST({t} = real AS INT)" for t in TOOLS) + ")"
_VOTES = "(" + " + ".join(f"CAST({t} AS INT)" for t in TOOLS) + ")"
ORACLE_SQL = {
    "tool_outer_merge": f"WITH {_FULL} SELECT * FROM m",
    "two_mode_merge": f"WITH {TOOL_PROBS}, a AS (SELECT id, round(p0, 6) AS score_full, coding_class FROM tool_probs WHERE id % 3 <> 0), "
    "b AS (SELECT id, round(p1, 6) AS score_partial, round(p2, 6) AS extra FROM tool_probs WHERE id % 4 <> 0) SELECT * FROM a FULL JOIN "
    "b USING (id)",
    "class_table": f"WITH {_SIMPLE} SELECT * FROM cl",
    "simple_table": f"WITH {_SIMPLE} SELECT * FROM si2",
    "unclassified_table": f"WITH {_SIMPLE} SELECT * FROM si2 WHERE label_feelnc IS NULL OR label_cpat IS NULL OR label_lncdc IS NULL",
    "binary_table": f"WITH {_SIMPLE} SELECT seq_ID, label_feelnc = 'coding' AS feelnc, label_cpat = 'coding' AS cpat, label_lncdc = "
    "'coding' AS lncdc, label_real = 'coding' AS real FROM si2 WHERE label_feelnc IS NOT NULL AND label_cpat IS NOT NULL AND "
    "label_lncdc IS NOT NULL",
    "classify_transcripts": f"WITH {TRANSCRIPTS} SELECT transcript_id, biotype, CASE WHEN transcript_id IN (SELECT doc_id FROM labels "
    "WHERE toxic = 1) THEN 'noncoding' WHEN transcript_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'coding' ELSE 'other' "
    "END AS label_real FROM transcripts",
    "fold_union": "SELECT 'fold' || l_linenumber AS fold, count(*) AS n, round(CAST(sum(CASE WHEN l_linenumber > 1 THEN l_quantity END) AS "
    "DOUBLE), 6) AS quantity, count(*) FILTER (l_linenumber = 1) AS n_null FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_linenumber",
    "beside_frames": f"WITH {TOOL_PROBS} SELECT id, a.x, a.y, b.z FROM (SELECT id, round(p0, 6) AS x, round(p1, 6) AS y FROM tool_probs "
    "WHERE id < 300) a FULL JOIN (SELECT id, round(p3, 6) AS z FROM tool_probs WHERE id > 200) b USING (id)",
    "aligned_rows": f"WITH {TOOL_PROBS} SELECT id, CASE WHEN id % 2 = 0 THEN round(p0, 6) ELSE 0 END AS x FROM tool_probs",
    "aligned_on_cut_keys": f"WITH {TOOL_PROBS} SELECT 'ENST' || id || '.' || (id % 7) AS key, CASE WHEN id % 3 <> 0 THEN round(p0, 6) END AS x FROM tool_probs",
    "ordered_lookup": "SELECT c_custkey, c_name, 1000000 - c_custkey AS position FROM customer WHERE c_acctbal > 0 ORDER BY position",
    "subsets": "SELECT c_mktsegment, count(*) AS n, kind FROM customer, (VALUES ('class', '^(BUILDING|MACHINERY)$'), ('contains', "
    "'UILD|OUSE'), ('startswith', '^AUTO'), ('all', '')) k(kind, pattern) WHERE regexp_matches(c_mktsegment, pattern) GROUP BY ALL",
    "semi_anti_joins": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS side "
    "FROM customer",
    "id_set_ops": "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM "
    "lineitem WHERE l_returnflag = 'R') SELECT l_partkey, 'union' AS op FROM (FROM a UNION FROM b) UNION ALL SELECT l_partkey, "
    "'intersect' FROM a WHERE l_partkey IN (FROM b) UNION ALL SELECT l_partkey, 'except' FROM a WHERE l_partkey NOT IN (FROM b)",
    "timeline_dates": f"WITH {_EVENT_TEXT} SELECT CASE WHEN event_type <> 'click' THEN event_type END AS tool, event_id, CAST(date AS VARCHAR) AS date, CASE WHEN "
    "event_type = 'click' THEN text END AS version FROM p WHERE date IS NOT NULL ORDER BY date, event_id",
    "nearest_release": "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT CAST(date_trunc('month', day) AS DATE) AS d, "
    "min(o_orderkey) AS version FROM o GROUP BY d) SELECT o_orderkey, CAST(day AS VARCHAR) AS day, version FROM o, r QUALIFY "
    "row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(day - d), d) = 1",
    "id_normal_forms": f"WITH {TOOL_PROBS}, s AS (SELECT id, {_SEQ_ID.format('id')} AS s FROM tool_probs) SELECT id, split_part(s, '|', 1) "
    "AS simple_id, 'ENST' || id AS clean_id, CAST(id % 7 AS VARCHAR) AS id_version, split_part(s, '|', -2) AS biotype, split_part(s, "
    "'|', 1) AS join_key, replace(replace(s, '|', '.'), '-', '.') AS dotted_id, 'ENST' || id AS bare FROM s",
    "release_flags": f"{_COMPARED} SELECT * FROM x",
    "release_flag_totals": f"{_COMPARED}, t AS (SELECT {', '.join(f'count(*) FILTER ({f}) AS {f}' for f in R.FLAGS)} FROM x) UNPIVOT t ON "
    f"{', '.join(R.FLAGS)} INTO NAME flag VALUE n",
    "release_flow": f"{_FLOW} SELECT * FROM fl",
    "release_flow_totals": f"{_FLOW} SELECT 'old' AS side, source AS class, CAST(sum(n) AS BIGINT) AS n FROM fl GROUP BY source UNION "
    "ALL SELECT 'new', target, CAST(sum(n) AS BIGINT) FROM fl GROUP BY target",
    "release_categories": f"{_COMPARED} "
    + " UNION ALL ".join(f"SELECT clean_id, '{c}' AS category FROM x WHERE {c}" for c in R.CATEGORIES),
    "cv_scores_binary": f"{_LONG} SELECT fold, tool, {', '.join(f'round({m}, 6) AS {m}' for m in C.MEASURES)} FROM b",
    "cv_scores_macro": f"{_LONG} SELECT fold, tool, round(accuracy, 6) AS accuracy, round((r1 + r0) / 2, 6) AS balanced_accuracy, "
    "round((p1 + p0) / 2, 6) AS precision, round((r1 + r0) / 2, 6) AS recall, round((f1 + f0) / 2, 6) AS f1 FROM q",
    "cv_summary": f"{_SUMMARY} SELECT tool, {', '.join(f'round({m}_{x}, 6) AS {m}_{x}' for m in C.MEASURES for x in ('mean', 'std'))} FROM v",
    "cv_rows_with_totals": f"{_LONG} SELECT tool, fold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM b UNION ALL SELECT tool, "
    "'mean', round(avg(f1), 6), round(avg(accuracy), 6) FROM b GROUP BY tool UNION ALL SELECT tool, 'std', round(stddev_samp(f1), 6), "
    "round(stddev_samp(accuracy), 6) FROM b GROUP BY tool",
    "best_variant": f"{_SUMMARY}, n AS (SELECT 'm' || (CAST(tool[2:2] AS INT) % 3) AS base, tool || '_m' || (CAST(tool[2:2] AS INT) % 3) AS "
    "tool, f1_mean FROM v) SELECT base, tool, round(f1_mean, 6) AS f1_mean FROM n QUALIFY row_number() OVER (PARTITION BY base ORDER BY "
    "n.f1_mean DESC, tool) = 1",
    "stability": f"{_SUMMARY} SELECT tool, round(f1_std / f1_mean, 6) AS f1_cv, CAST(rank() OVER (ORDER BY f1_mean DESC) AS INT) AS f1_rank "
    "FROM v",
    "consensus_counts": f"WITH {TOOL_LABELS} SELECT {_CORRECT} AS n_correct, count(*) FILTER (real) AS coding, count(*) FILTER (NOT real) "
    "AS noncoding FROM tool_labels GROUP BY ALL",
    "consensus_pct": f"WITH {TOOL_LABELS}, c AS (SELECT real, CASE {_CORRECT} WHEN 8 THEN 'All' WHEN 0 THEN 'None' ELSE 'Ambiguous' END AS "
    "consensus, count(*) AS n FROM tool_labels GROUP BY ALL) SELECT *, round(CAST(100.0 * n / sum(n) OVER (PARTITION BY real) AS DOUBLE), "
    "6) AS percent FROM c",
    "combination_counts": f"WITH {TOOL_LABELS} SELECT {', '.join(TOOLS)}, count(*) AS n FROM tool_labels GROUP BY ALL",
    "combination_top": f"WITH {TOOL_LABELS} SELECT p0, p1, p2, p3, count(*) AS n FROM tool_labels GROUP BY ALL ORDER BY n DESC, p0, p1, p2, "
    "p3 LIMIT 5",
    "set_totals": f"WITH {TOOL_LABELS}, t AS (SELECT {', '.join(f'count(*) FILTER ({t}) AS {t}' for t in TOOLS)} FROM tool_labels) UNPIVOT "
    f"t ON {', '.join(TOOLS)} INTO NAME tool VALUE n",
    "vote_histogram": f"WITH {TOOL_LABELS}, m AS (SELECT id, {MEAN} AS m FROM tool_probs) SELECT {_VOTES} AS n_votes, count(*) FILTER "
    "(real) AS coding, count(*) FILTER (NOT real) AS noncoding, round(avg(m), 6) AS mean_prob FROM tool_labels JOIN m USING (id) GROUP BY "
    "ALL",
    "length_summary": f"WITH {TRANSCRIPTS} SELECT biotype, count(length) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) "
    "AS sd, round(quantile_cont(length, 0.5), 6) AS median, round(quantile_cont(length, 0.25), 6) AS q1, round(quantile_cont(length, "
    "0.75), 6) AS q3 FROM transcripts GROUP BY ALL",
    "value_shares": f"WITH {TRANSCRIPTS}, c AS (SELECT quality, count(*) AS n FROM transcripts WHERE quality IS NOT NULL GROUP BY ALL) "
    "SELECT *, round(CAST(100.0 * n / sum(n) OVER () AS DOUBLE), 6) AS percent FROM c",
    "null_counts": f"WITH {TRANSCRIPTS}, t AS (SELECT "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("transcript_id", "gene_id", "biotype", "sequence", "length", "quality"))
    + ' FROM transcripts) UNPIVOT t ON transcript_id, gene_id, biotype, sequence, length, quality INTO NAME "column" VALUE n_null',
    "constant_columns": "SELECT * FROM (VALUES ('p0', FALSE), ('coding_class', FALSE), ('one', TRUE), ('nothing', TRUE)) "
    't("column", constant)',
}
