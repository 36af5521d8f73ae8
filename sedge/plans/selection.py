"""Queries about attributions, feature selection, clusters and sequences, each with SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.operators import attribution as A
from sedge.operators import features as X
from sedge.operators import linkage
from sedge.operators import sequences as Q
from sedge.operators import stats as S
from sedge.plans.uncertainty import rounded
from sedge.plans.views import (
    ATTRIBUTIONS, FEATURES_LONG, TRANSCRIPTS, attributions, features_long, table, transcripts,
)


def shap_aggregate(spark, d):
    return rounded(A.over_folds(A.mean_absolute(attributions(spark, d))))


def shap_cumulative(spark, d):
    return rounded(A.cumulative(A.over_folds(A.mean_absolute(attributions(spark, d)))))


def _per_id(spark, d):
    return attributions(spark, d).groupBy("id", "feature").agg(F.round(F.sum("value"), 6).alias("value"))


def shap_topk(spark, d):
    return A.top_per_row(_per_id(spark, d), ["id"], 2)


def latest_fold(spark, d):
    return A.latest_fold(attributions(spark, d).select("fold", "id", "feature", F.round("value", 6).alias("value")), "id")


def one_se(spark, d):
    o = table(spark, d, "orders")
    scores = o.select((F.col("o_orderkey") % 12 + 1).alias("step"), (F.col("o_custkey") % 5).alias("fold"), F.col("o_totalprice").cast("double").alias("s"))
    return rounded(A.one_standard_error(scores.groupBy("step", "fold").agg(F.avg("s").alias("score"))))


def rfecv_votes(spark, d):
    p = table(spark, d, "part")
    rows = p.select((F.col("p_partkey") % 5 + 1).alias("fold"), F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 9)).alias("feature"), F.col("p_size").alias("rank"))
    rows = rows.groupBy("fold", "feature").agg(F.min("rank").alias("rank")).withColumn("selected", F.col("rank") <= 25)
    return rounded(A.votes(rows, [1, 2, 3, 4, 5]))


def _members(spark, d):
    return table(spark, d, "part").select(
        (F.col("p_partkey") % 20).alias("cluster"), F.concat(F.lit("f"), "p_partkey").alias("feature"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"),
        F.when(F.col("p_partkey") % 4 != 0, F.round(F.col("p_retailprice").cast("double"), 2)).alias("shap"),
    )


def cluster_names(spark, d):
    return A.name_clusters(_members(spark, d))


def cluster_shap(spark, d):
    return rounded(A.rank_clusters(_members(spark, d)))


def cluster_origins(spark, d):
    return A.origins(_members(spark, d))


def significant_clusters(spark, d):
    m = _members(spark, d)
    return A.significant_clusters([m.withColumn("significant", F.col("shap") > 1200), m.withColumn("significant", F.col("cluster") < 3)])


def cluster_search(spark, d):
    m = _members(spark, d).select("cluster", "feature")
    parts = [Q.cluster_search(m, q, h).withColumn("how", F.lit(h)) for q, h in (("F29", "partial"), ("f7", "exact"), ("^f1[01]$", "regex"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_after_clustering(spark, d):
    m = _members(spark, d).select("feature", F.when(F.col("cluster") != 5, F.col("cluster")).alias("cluster"))
    tests = m.select("feature", (F.substring("feature", 2, 9).cast("int") * 37 % 101 / 100).alias("vda"))
    return rounded(A.top_after_clustering(tests, m, 10, "f7"))


def nearest_threshold(spark, d):
    m = _members(spark, d).select("feature", (F.col("cluster") % 4 * 0.1 + 0.1).alias("threshold"), "cluster")
    return rounded(A.nearest_threshold(m, 0.27))


def family_top20(spark, d):
    l = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("class"), "l_partkey", "l_orderkey")
    hits = l.groupBy("class", (F.col("l_partkey") % 60).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(A.family_top(hits, l.groupBy("class").agg(F.count_distinct("l_orderkey").alias("transcripts"))))


def _runs(spark, d):
    return table(spark, d, "orders").select(
        F.concat(F.lit("set"), F.col("o_custkey") % 12).alias("dataset"), F.col("o_orderkey").alias("run"), F.round(F.col("o_totalprice").cast("double"), 2).alias("acc")
    )


def best_checkpoints(spark, d):
    return A.best_checkpoints(_runs(spark, d), 4)


def best_checkpoints_as_coded(spark, d):
    return A.best_checkpoints(_runs(spark, d), 4, "as_coded")


def standardised(spark, d):
    return rounded(X.standardised(features_long(spark, d)).select("id", "feature", "z"))


def residuals(spark, d):
    rows = features_long(spark, d).select("id", "feature", "value", (F.col("id") % 97 + 100).alias("length"))
    return rounded(X.residuals(rows).select("id", "feature", "residual"), 6)


def colours(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.abs(F.col("c_acctbal").cast("double")).alias("v"))
    parts = [X.colour(t, "v", h).select("c_custkey", "colour", F.lit(h).alias("how")) for h in ("log", "sqrt", "percentile")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def to_numbers(spark, d):
    t = table(spark, d, "events")
    text = F.when(F.col("event_id") % 4 == 0, "True").when(F.col("event_id") % 4 == 1, "false").when(F.col("event_id") % 4 == 2, "n/a").otherwise(F.col("event_id").cast("string"))
    return X.to_numbers(t.select("event_id", text.alias("x")), ["x"])


def feature_distances(spark, d):
    return rounded(X.distances(S.spearman(features_long(spark, d))))


def _fixed_clusters(spark, d):
    f = features_long(spark, d).select("feature").distinct()
    i = F.substring("feature", 2, 3).cast("int")
    return f.select("feature", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))).alias("threshold")).withColumn(
        "cluster", F.when(F.col("threshold") == 0.5, i % 7).when(F.col("threshold") == 1.0, i % 3).otherwise(1)
    )


def silhouette(spark, d):
    return rounded(X.silhouette(X.distances(S.spearman(features_long(spark, d))), _fixed_clusters(spark, d)))


def best_silhouette(spark, d):
    return X.best_threshold(X.silhouette(X.distances(S.spearman(features_long(spark, d))), _fixed_clusters(spark, d)))


def correlated_representatives(spark, d):
    return X.representatives(_fixed_clusters(spark, d))


def ward_clusters(spark, d):
    tree = linkage.ward(X.distances(S.spearman(features_long(spark, d))))
    return linkage.flat_clusters(tree, [round(0.05 * i, 2) for i in range(1, 32)])


def top_variance(spark, d):
    return rounded(X.top_variance(features_long(spark, d)), 9)


def yeo_johnson(spark, d):
    return rounded(X.yeo_johnson(features_long(spark, d)).select("id", "feature", "lambda", "transformed"))


def sequence_filters_100k(spark, d):
    t = transcripts(spark, d)
    return Q.usable(t).select("transcript_id", F.length(Q.without_n_ends(F.col("sequence"))).cast("long").alias("trimmed"), "length")


def legal_sequences(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.translate(F.upper("p_name"), "BDEFHIJKLMNOPQRSVWXYZ ", "ACGTACGTACGTACGTACGTA").alias("sequence"))
    return rounded(Q.legal(p).select("p_partkey", Q.gc_share(F.col("sequence")).alias("gc"), Q.orf_slice(F.col("sequence"), F.lit(2), F.lit(2)).alias("orf")))


def kmer_counts(spark, d):
    return Q.kmer_counts(transcripts(spark, d), 3, by=["biotype"])


FEATURE_NAMES = (
    "GC_skew", "te_count", "ORF.Max.Len_lncfinder", "Hexamer_score_cpat", "x_MFE",
    "gq_hit_count", "any_nonb_present", "AAA_plncpro", "motif_diversity", "pseudo_count",
    "kmerScore_12mer_feelnc", "Signal.Peak", "lctr_", "q",
)


def category_rules(spark, d):
    names = F.array(*map(F.lit, FEATURE_NAMES))
    p = table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % len(FEATURE_NAMES) + 1).cast("int")).alias("name"))
    return p.select("p_partkey", "name", Q.category(F.col("name")).alias("category"))


def keyword_tags(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    words = [("STEEL", "metal"), ("plated", "coated"), ("standard", "plain"), ("small", "small")]
    return p.select("p_partkey", Q.keyword_tag(F.col("p_type"), words).alias("tag"))


QUERIES = {
    f.__name__: f
    for f in (
        shap_aggregate, shap_cumulative, shap_topk, latest_fold, one_se, rfecv_votes, cluster_names, cluster_shap,
        cluster_origins, significant_clusters, cluster_search, top_after_clustering, nearest_threshold, family_top20,
        best_checkpoints, best_checkpoints_as_coded, standardised, residuals, colours, to_numbers, feature_distances,
        silhouette, best_silhouette, correlated_representatives, ward_clusters, top_variance, yeo_johnson,
        sequence_filters_100k, legal_sequences, kmer_counts, category_rules, keyword_tags,
    )
}

_SHAP = (
    f"WITH {ATTRIBUTIONS}, pf AS (SELECT fold, feature, avg(abs(value)) AS m FROM attributions GROUP BY ALL), g AS (SELECT f.fold, "
    "t.feature, coalesce(m, 0) AS m FROM (SELECT DISTINCT fold FROM pf) f CROSS JOIN (SELECT DISTINCT feature FROM pf) t LEFT JOIN pf "
    "USING (fold, feature)), a AS (SELECT feature, avg(m) AS mean, stddev_samp(m) AS sd FROM g GROUP BY feature)"
)
_MEMBERS = (
    "WITH m AS (SELECT p_partkey % 20 AS cluster, 'f' || p_partkey AS feature, split_part(p_type, ' ', 1) AS category, CASE WHEN "
    "p_partkey % 4 <> 0 THEN round(CAST(p_retailprice AS DOUBLE), 2) END AS shap FROM part)"
)
_RUNS = (
    "WITH r AS (SELECT 'set' || (o_custkey % 12) AS dataset, o_orderkey AS run, round(CAST(o_totalprice AS DOUBLE), 2) AS acc FROM "
    "orders), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, run) = 1)"
)
_FIXED = (
    "cl AS (SELECT feature, threshold, CASE threshold WHEN 0.5 THEN i % 7 WHEN 1.0 THEN i % 3 ELSE 1 END AS cluster FROM (SELECT "
    "DISTINCT feature, CAST(feature[2:] AS INT) AS i FROM features_long), (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) t(threshold))"
)
_SIL = (
    f"WITH {FEATURES_LONG}, k AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY "
    "feature, value) - 1) / 2 AS r FROM features_long), p AS (SELECT a.feature AS f, b.feature AS g, 1 - abs(corr(a.r, b.r)) AS d FROM k a "
    f"JOIN k b ON a.id = b.id AND a.feature <> b.feature GROUP BY ALL), {_FIXED}, me AS (SELECT x.threshold, f, x.cluster AS cf, y.cluster "
    "AS cg, avg(d) AS d FROM p JOIN cl x ON x.feature = f JOIN cl y ON y.feature = g AND y.threshold = x.threshold GROUP BY ALL), e AS "
    "(SELECT threshold, f, max(d) FILTER (cf = cg) AS a, min(d) FILTER (cf <> cg) AS b FROM me GROUP BY ALL), s AS (SELECT threshold, "
    "avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FILTER (b IS NOT NULL) AS s FROM e GROUP BY ALL), o AS (SELECT threshold, count(DISTINCT cluster) "
    "AS n_clusters, count(*) AS n FROM cl GROUP BY ALL), si AS (SELECT threshold, n_clusters, CASE WHEN n_clusters > 1 AND n_clusters < n "
    "THEN s END AS silhouette FROM o LEFT JOIN s USING (threshold))"
)
_NAMES = str(list(FEATURE_NAMES))
ORACLE_SQL = {
    "shap_aggregate": f"{_SHAP} SELECT feature, round(mean, 6) AS mean_abs_shap, round(sd, 6) AS std_abs_shap, round(sd / mean, 6) AS "
    "cv_abs_shap FROM a",
    "shap_cumulative": f"{_SHAP} SELECT feature, round(mean, 6) AS mean_abs_shap, CAST(row_number() OVER w AS INT) AS place, "
    "round(sum(mean) OVER w, 6) AS running, round(100 * sum(mean) OVER w / sum(mean) OVER (), 6) AS running_percent FROM a WINDOW w AS "
    "(ORDER BY mean DESC, feature ROWS UNBOUNDED PRECEDING)",
    "shap_topk": f"WITH {ATTRIBUTIONS}, i AS (SELECT id, feature, round(sum(value), 6) AS value FROM attributions GROUP BY ALL) SELECT *, "
    "CAST(row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS INT) AS place FROM i QUALIFY place <= 2",
    "latest_fold": f"WITH {ATTRIBUTIONS} SELECT fold, id, feature, round(value, 6) AS value FROM attributions QUALIFY fold = max(fold) OVER "
    "(PARTITION BY id)",
    "one_se": "WITH s AS (SELECT o_orderkey % 12 + 1 AS step, o_custkey % 5 AS fold, avg(CAST(o_totalprice AS DOUBLE)) AS score FROM orders "
    "GROUP BY ALL), t AS (SELECT step, avg(score) AS m, stddev_samp(score) / sqrt(count(*)) AS se FROM s GROUP BY step), b AS (SELECT "
    "step AS best_step, m - se AS lim FROM t ORDER BY m DESC, step LIMIT 1) SELECT min(step) AS step, max(best_step) AS best_step, "
    "round(max(lim), 6) AS \"limit\" FROM t, b WHERE m >= lim",
    "rfecv_votes": "WITH r AS (SELECT p_partkey % 5 + 1 AS fold, 'f' || CAST(floor(p_partkey / 9) AS BIGINT) AS feature, min(p_size) AS rank "
    "FROM part GROUP BY ALL), g AS (SELECT f.fold, t.feature, coalesce(rank, 999)::DOUBLE AS rank, coalesce(rank <= "
    "25, FALSE) AS sel FROM (SELECT DISTINCT fold FROM r) f CROSS JOIN (SELECT DISTINCT feature FROM r) t LEFT JOIN r USING (fold, feature)) "
    "SELECT feature, count(*) FILTER (sel) AS vote_count, count(*) FILTER (sel) >= 3 AS selected, round(avg(rank), 6) AS rfecv_rank_mean, "
    "round(stddev_pop(rank), 6) AS rfecv_rank_std, coalesce(string_agg(fold, ',' ORDER BY fold) FILTER (sel), '') AS selected_in_folds FROM "
    "g GROUP BY feature",
    "cluster_names": f"{_MEMBERS}, c AS (SELECT cluster, category, count(*) AS n FROM m GROUP BY ALL), j AS (SELECT cluster, category FROM c "
    "QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category DESC) = 1), t AS (SELECT cluster, arg_max(feature, "
    "{'s': coalesce(shap, 0), 'f': feature}) AS top_feature, count(*) AS size, string_agg(feature, ',' ORDER BY feature) AS members FROM m "
    "GROUP BY ALL) SELECT *, category || ' / ' || top_feature AS name FROM j JOIN t USING (cluster)",
    "cluster_shap": f"{_MEMBERS}, s AS (SELECT cluster, coalesce(sum(shap), 0) AS s, count(*) AS size, count(shap) AS n_valued FROM m GROUP "
    "BY ALL) SELECT cluster, round(s, 6) AS shap_sum, size, n_valued, round(s / size, 6) AS per_member, round(n_valued / size, 6) AS "
    "coverage, CAST(row_number() OVER (ORDER BY s DESC, cluster) AS INT) AS place FROM s",
    "cluster_origins": f"{_MEMBERS} SELECT n_origins, count(*) AS n_clusters FROM (SELECT cluster, count(DISTINCT category) AS n_origins FROM "
    "m GROUP BY ALL) GROUP BY ALL",
    "significant_clusters": f"{_MEMBERS} SELECT count(DISTINCT cluster) FILTER (shap > 1200 OR cluster < 3) AS n_significant, count(DISTINCT "
    "cluster) AS n_clusters FROM m",
    "cluster_search": f"{_MEMBERS} "
    + " UNION ALL ".join(
        f"SELECT cluster, feature, '{h}' AS how FROM m WHERE cluster IN (SELECT cluster FROM m WHERE {c})"
        for h, c in (("partial", "contains(feature, 'f29')"), ("exact", "feature = 'f7'"), ("regex", "regexp_matches(feature, '^f1[01]$')"))
    ),
    "top_after_clustering": f"{_MEMBERS}, t AS (SELECT feature, CASE WHEN cluster <> 5 THEN cluster END AS cluster, (CAST(feature[2:] AS "
    "INT) * 37 % 101) / 100 AS vda FROM m), u AS (SELECT *, abs(vda - 0.5) AS distance FROM t WHERE cluster IS NOT NULL AND (cluster <> 7 OR "
    "feature = 'f7')), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, feature) = 1) SELECT "
    "feature, round(vda, 6) AS vda, cluster, round(distance, 6) AS distance FROM b ORDER BY b.distance DESC, feature LIMIT 10",
    "nearest_threshold": f"{_MEMBERS} SELECT feature, round(cluster % 4 * 0.1 + 0.1::DOUBLE, 6) AS threshold, cluster FROM m WHERE cluster % "
    "4 = 2",
    "family_top20": "WITH l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS k, l_partkey % 60 AS family, l_orderkey FROM lineitem "
    "WHERE l_returnflag IN ('A', 'R')), s AS (SELECT k, count(DISTINCT l_orderkey)::DOUBLE AS n FROM l GROUP BY k), w AS (SELECT family, "
    "count(*) FILTER (k = 0) / (SELECT n FROM s WHERE k = 0) AS a, count(*) FILTER (k = 1) / (SELECT n FROM s WHERE k = 1) AS b FROM l GROUP "
    "BY family) SELECT family, round(a, 6) AS mean_0, round(b, 6) AS mean_1, round(log2((b + 1e-6) / (a + 1e-6)), 6) AS log2_ratio FROM w "
    "ORDER BY round(a + b, 9) DESC, family LIMIT 20",
    "best_checkpoints": f"{_RUNS} SELECT * FROM b ORDER BY acc DESC, dataset LIMIT 4",
    "best_checkpoints_as_coded": f"{_RUNS} SELECT * FROM b ORDER BY dataset LIMIT 4",
    "standardised": f"WITH {FEATURES_LONG} SELECT id, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM "
    "features_long WINDOW w AS (PARTITION BY feature)",
    "residuals": f"WITH {FEATURES_LONG}, l AS (SELECT id, feature, value, id % 97 + 100 AS x FROM features_long), f AS (SELECT feature, "
    "regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM l GROUP BY ALL) SELECT id, feature, round(value - a - b * x, 6) AS residual "
    "FROM l JOIN f USING (feature)",
    "colours": "WITH t AS (SELECT c_custkey, abs(CAST(c_acctbal AS DOUBLE)) AS v FROM customer) SELECT c_custkey, "
    "round(log10(v + 1), 6) AS colour, 'log' AS how FROM t UNION ALL SELECT c_custkey, round(sqrt(v), 6), 'sqrt' FROM t UNION ALL SELECT "
    "c_custkey, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER (), 6), 'percentile' FROM t",
    "to_numbers": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 3 THEN event_id END::DOUBLE AS x FROM events",
    "feature_distances": f"WITH {FEATURES_LONG}, k AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER "
    "(PARTITION BY feature, value) - 1) / 2 AS r FROM features_long), c AS (SELECT a.feature AS f1, b.feature AS f2, corr(a.r, b.r) AS rho "
    "FROM k a JOIN k b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL) SELECT f1, f2, round(rho, 6) AS rho, round(1 - abs(rho), 6) "
    "AS distance FROM c",
    "silhouette": f"{_SIL} SELECT threshold, n_clusters, round(silhouette, 6) AS silhouette FROM si",
    "best_silhouette": f"{_SIL} SELECT threshold FROM si WHERE silhouette IS NOT NULL ORDER BY round(silhouette, 9) DESC, threshold LIMIT 1",
    "correlated_representatives": f"WITH {FEATURES_LONG}, {_FIXED} SELECT threshold, cluster, min(feature) AS feature FROM cl GROUP BY ALL",
    "top_variance": f"WITH {FEATURES_LONG} SELECT feature, round(var_samp(value), 9) AS variance FROM features_long GROUP BY feature ORDER BY "
    "round(var_samp(value), 12) DESC, feature LIMIT 6",
    "sequence_filters_100k": f"WITH {TRANSCRIPTS} SELECT transcript_id, CAST(length(regexp_replace(regexp_replace(sequence, '^N+', ''), 'N+$', '')) AS "
    "BIGINT) AS trimmed, length FROM transcripts WHERE NOT contains(sequence, 'N') AND length(sequence) <= 100000",
    "legal_sequences": "WITH p AS (SELECT p_partkey, translate(upper(p_name), 'BDEFHIJKLMNOPQRSVWXYZ ', 'ACGTACGTACGTACGTACGTA') AS s FROM part) "
    "SELECT p_partkey, round(length(regexp_replace(s, '[^GCgc]', '', 'g')) / nullif(length(s), 0), 6) AS gc, s[2:7] AS orf FROM p WHERE NOT "
    "regexp_matches(s, '[^ACGTUacgtu]')",
    "kmer_counts": f"WITH {TRANSCRIPTS}, s AS (SELECT biotype, sequence AS s FROM transcripts), k AS (SELECT biotype, substr(s, i, 3) AS "
    "kmer FROM (SELECT biotype, s, unnest(range(1, length(s) - 1)) AS i FROM s)) SELECT biotype, kmer, count(*) AS n FROM k GROUP BY ALL",
    "category_rules": f"WITH p AS (SELECT p_partkey, {_NAMES}[p_partkey % {len(FEATURE_NAMES)} + 1] AS name FROM part) SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{c}'" for c, p in Q.CATEGORY_RULES)
    + " ELSE 'Other' END AS category FROM p",
    "keyword_tags": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'small') THEN 'small' WHEN contains(lower(p_type), 'standard') THEN "
    "'plain' WHEN contains(lower(p_type), 'plated') THEN 'coated' WHEN contains(lower(p_type), 'steel') THEN 'metal' END AS tag FROM part",
}
