"""Further queries: profiles of picked ids, pooled corrections, summaries, samples of genes and rules about columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import features as X
from sedge.operators import sampling as P
from sedge.operators import scores as C
from sedge.operators import stats as S
from sedge.operators import tables as T
from sedge.operators import uncertainty as U
from sedge.plans.uncertainty import METRICS_SQL, _groups_sql, _metrics, rounded
from sedge.sources import files as I
from sedge.sources.scratch import scratch_path
from sedge.plans.views import TOOL_PROBS, TOOLS, table, tool_probs, transcripts


def pick_profiles(spark, d):
    picks = tool_probs(spark, d).where("p0 > 0.9").select("id")
    metrics = _metrics(spark, d).select("id", "H_pred", "I_bald")
    scores = tool_probs(spark, d).where("coding_class = 1").select("id", "p0", "p1")
    return rounded(T.profiles(picks, {"entropy": metrics, "score": scores, "te": None}, "id"))


def pooled_fdr(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", *((F.pmod(F.col("o_totalprice").cast("decimal(18,2)") * 100, F.lit(m)).cast("double") / m).alias(c) for c, m in (("a", 9973), ("b", 9941)))
    )
    return rounded(S.pooled_adjusted(o, "o_orderkey", ["a", "b"]), 9)


def number_summary(spark, d):
    return rounded(T.summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def group_sides(spark, d):
    low, high = U.low_and_high(U.entropy_groups(_metrics(spark, d), "class_separated"))
    return low.select("id", F.lit("low").alias("side")).unionByName(high.select("id", F.lit("high").alias("side")))


def clear_genes(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("gene"), F.col("l_linestatus").alias("label"))
    s = P.disjoint_classes(t, "id", "gene", "label", 100)
    return s.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gene").alias("n_genes"))


def gene_sample(spark, d):
    return P.some_groups(transcripts(spark, d), "transcript_id", "gene_id", 7).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gene_id").alias("n_genes"))


def feature_rules(spark, d):
    """The columns that count as features by name and type, whether they are categorical, and what their rows hold."""
    t = table(spark, d, "lineitem").withColumns(
        {"te_has_line": (F.col("l_linenumber") == 1).cast("int"), "motif_types_present": F.col("l_tax") * 2, "l_note_key": F.lit("text"), "ok_price": F.lit(True)}
    )
    found = X.feature_columns(t.schema, ["price", "tax", "discount", "key", "_line", "_present"], ["l_orderkey"], ["l_discount"], ["l_suppkey"])
    kinds = dict(zip(("categorical", "continuous"), X.categorical_and_continuous(found), strict=True))
    kind = {c: k for k, cs in kinds.items() for c in cs}
    sums = t.agg(*(F.struct(F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("mean")).alias(c) for c in found))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(kind[c]).alias("kind"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean")) for c in found))
    return rounded(sums.select(F.explode(rows).alias("r")).select("r.*"), 4)


#: Of each tool: how its table gives the id, and its other columns, from a probability p of coding.
_TOOL_TABLES = {
    "cpc2": ("#ID", {"label": "CASE WHEN p > 0.5 THEN 'coding' ELSE 'noncoding' END"}),
    "feelnc": ("name", {"label": "CASE WHEN p > 0.5 THEN 1 ELSE 0 END"}),
    "cpat": ("seq_ID", {"ID": "'x'", "mRNA": "300 + id", "ORF_start": "id % 50", "ORF_end": "id % 50 + 99", "Coding_prob": "p"}),
    "lncdc": ("Description", {"predict": "CASE WHEN p > 0.5 THEN 'mrna' WHEN p > 0.1 THEN 'lncrna' ELSE 'other' END"}),
    "mrnn": ("seq_ID", {"coding_prob": "p"}),
    "rnasamba": ("sequence_name", {"classification": "CASE WHEN p > 0.5 THEN 'coding' ELSE 'noncoding' END"}),
    "lncrnabert": ("id", {"class": "CASE WHEN p > 0.5 THEN 'pcRNA' ELSE 'ncRNA' END"}),
    "plncpro": ("transcript_id", {"prediction": "CASE WHEN p > 0.5 THEN 1 ELSE 0 END", "Label": "0"}),
    "lncadeep": ("ID", {"Index": "CASE WHEN p > 0.5 THEN 'Coding' ELSE 'Noncoding' END"}),
    "lncfinder": ("ID", {"Pred": "CASE WHEN p > 0.5 THEN 'Coding' ELSE 'NonCoding' END"}),
    "lncrnanet": ("ID", {"coding_prob": "p"}),
}


def all_tool_labels(spark, d):
    """The labels of all tools that are known, each from a table of its own form."""
    probs, parts = tool_probs(spark, d), []
    for i, (name, (key, columns)) in enumerate(_TOOL_TABLES.items()):
        own = probs.select("id", F.col(TOOLS[i % len(TOOLS)]).alias("p"))
        given = own.select(F.concat(F.lit("T"), "id").alias(key), *(F.expr(e).alias(c) for c, e in columns.items()))
        done = T.normalise(given, T.specs()[name])
        extra = F.col("orf_coverage_cpat") if name == "cpat" else F.lit(None).cast("double")
        parts.append(done.select("seq_ID", F.lit(name).alias("tool"), F.col(f"label_{name}").alias("label"), extra.alias("orf_coverage")))
    return rounded(reduce(DataFrame.unionByName, parts))


def gene_parts(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gene"), (F.col("o_custkey") % 3).alias("label"))
    s = P.gene_split(t, "id", "gene", "label")
    return s.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


def classification_report(spark, d):
    p = tool_probs(spark, d).select(F.col("coding_class").alias("y_true"), (F.col("p0") > 0.45).cast("int").alias("y_pred"))
    return rounded(C.classification_report(p))


def tool_bibliography(spark, d):
    """An exported bibliography, written and read back."""
    p = table(spark, d, "part").select(
        F.concat(F.lit('On "'), F.element_at(F.array(*map(F.lit, ("CPAT", "an rnasamba", "CPC2", "nothing"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit('",\nno. '), "p_partkey").alias("Title"),
        F.when(F.col("p_partkey") % 3 == 0, "2019-05").when(F.col("p_partkey") % 3 == 1, "2020-02-03").otherwise("soon").alias("Date"),
    )
    path = scratch_path(spark, "bibliography")
    p.write.csv(path, header=True, quoteAll=True, escape='"')
    return I.bibliography(spark, path).withColumn("date", F.col("date").cast("string"))


def inverted_probabilities(spark, d):
    return rounded(X.probabilities(tool_probs(spark, d), TOOLS, ["p3"]).select("id", "p2", "p3"))


def source_files(spark, d):
    from sedge.sources.files import provenance

    return provenance(table(spark, d, "nation")).select("n_nationkey", "source_file")


QUERIES = {
    f.__name__: f
    for f in (
        pick_profiles, pooled_fdr, number_summary, group_sides, clear_genes, gene_sample, feature_rules, inverted_probabilities, source_files,
        all_tool_labels, gene_parts, classification_report, tool_bibliography,
    )
}
_TOOL_LABELS = {
    "cpat": "CASE WHEN {p} < 0.364 THEN 'noncoding' ELSE 'coding' END",
    "lncdc": "CASE WHEN {p} > 0.5 THEN 'coding' WHEN {p} > 0.1 THEN 'noncoding' END",
    "mrnn": "CASE WHEN {p} < 0.5 THEN 'noncoding' ELSE 'coding' END",
    "lncrnanet": "CASE WHEN {p} > 0.5 THEN 'noncoding' ELSE 'coding' END",
}
_PM = "CAST((CAST(o_totalprice AS DECIMAL(18, 2)) * 100) % {0} AS DOUBLE) / {0}"
ORACLE_SQL = {
    "pick_profiles": f"WITH {METRICS_SQL} SELECT id, round(H_pred, 6) AS entropy_H_pred, round(I_bald, 6) AS entropy_I_bald, CASE WHEN "
    "coding_class = 1 THEN round(p0, 6) END AS score_p0, CASE WHEN coding_class = 1 THEN round(p1, 6) END AS score_p1 FROM u WHERE p0 > 0.9",
    "pooled_fdr": f"WITH o AS (SELECT o_orderkey, {_PM.format(9973)} AS a, {_PM.format(9941)} AS b FROM orders), l AS (UNPIVOT o ON a, b INTO "
    "NAME c VALUE p), k AS (SELECT *, row_number() OVER (ORDER BY p, c, o_orderkey) AS k, count(*) OVER () AS n FROM l), j AS (SELECT *, "
    "least(min(p * n / k) OVER (ORDER BY k DESC), 1) AS q FROM k) SELECT o_orderkey, round(max(q) FILTER (c = 'a'), 9) AS a_adj, round(max(q) "
    "FILTER (c = 'b'), 9) AS b_adj FROM j GROUP BY o_orderkey",
    "number_summary": "WITH w AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, "
    "CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem), l AS (UNPIVOT w ON l_quantity, l_extendedprice, l_discount INTO NAME \"column\" "
    'VALUE v) SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, '
    "round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, "
    "round(max(v), 6) AS max FROM l GROUP BY ALL",
    "group_sides": f"WITH {_groups_sql(True)} SELECT id, split_part(entropy_group, '_', 1) AS side FROM g WHERE entropy_group <> 'middle'",
    "clear_genes": "WITH g AS (SELECT l_orderkey, min(l_linestatus) AS label FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linestatus) "
    "= 1), c AS (SELECT label, least(count(*), 100) AS n FROM g GROUP BY ALL) SELECT label, 'train' AS part, least(n, 50) AS n, least(n, 50) "
    "AS n_genes FROM c UNION ALL SELECT label, 'test', n - 50, n - 50 FROM c WHERE n > 50",
    "gene_sample": "SELECT CAST(7 AS BIGINT) AS n, CAST(7 AS BIGINT) AS n_genes",
    "feature_rules": "SELECT 'te_has_line' AS name, 'categorical' AS kind, count(*) AS n, round(avg(CAST(l_linenumber = 1 AS INT)), 4) AS mean FROM "
    "lineitem UNION ALL SELECT 'motif_types_present', 'continuous', count(*), round(avg(CAST(l_tax AS DOUBLE) * 2), 4) FROM lineitem UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', 'continuous', count({c}), round(avg(CAST({c} AS DOUBLE)), 4) FROM lineitem" for c in ("l_extendedprice", "l_partkey", "l_tax")),
    "all_tool_labels": f"WITH {TOOL_PROBS} "
    + " UNION ALL ".join(
        f"SELECT 'T' || id AS seq_ID, '{name}' AS tool, {label.format(p=TOOLS[i % 8])} AS label, {cover} AS orf_coverage FROM tool_probs"
        for i, (name, label, cover) in enumerate(
            (n, _TOOL_LABELS.get(n, "CASE WHEN {p} > 0.5 THEN 'coding' ELSE 'noncoding' END"), "round(100::DOUBLE / (300 + id), 6)" if n == "cpat" else "CAST(NULL AS DOUBLE)")
            for n in _TOOL_TABLES
        )
    ),
    "gene_parts": "WITH g AS (SELECT o_custkey % 3 AS label, count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders GROUP BY ALL), p AS (SELECT label, "
    "n, k, CAST(floor(k * 0.2) AS BIGINT) AS t FROM g) SELECT label, 'test' AS part, t AS n FROM p UNION ALL SELECT label, 'train', k - t FROM p UNION ALL "
    "SELECT label, 'leftover', n - k FROM p WHERE n > k",
    "classification_report": f"WITH {TOOL_PROBS}, c AS (SELECT count(*) FILTER (coding_class = 1 AND p0 > 0.45)::DOUBLE AS tp, count(*) FILTER (coding_class = 0 AND "
    "p0 > 0.45)::DOUBLE AS fp, count(*) FILTER (coding_class = 0 AND p0 <= 0.45)::DOUBLE AS tn, count(*) FILTER (coding_class = 1 AND p0 <= 0.45)::DOUBLE AS fn FROM "
    "tool_probs), r AS (SELECT '0' AS name, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM c UNION ALL SELECT '1', tp / (tp + "
    "fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c), a AS (SELECT * FROM r UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (tp + tn + fp + fn), tp + "
    "tn + fp + fn FROM c UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM r UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f "
    "* s) / sum(s), sum(s) FROM r) SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, CAST(s AS BIGINT) AS support FROM a",
    "tool_bibliography": "SELECT 'On \"' || ['CPAT', 'an rnasamba', 'CPC2'][p_partkey % 4 + 1] || '\",' || chr(10) || 'no. ' || p_partkey AS title, CASE p_partkey % 3 WHEN 0 THEN "
    "'2019-05-15' WHEN 1 THEN '2020-02-03' END AS date, ['CPAT', 'RNAsamba', 'CPC2'][p_partkey % 4 + 1] AS tool FROM part WHERE p_partkey % 4 < 3",
    "inverted_probabilities": f"WITH {TOOL_PROBS} SELECT id, round(p2, 6) AS p2, round(1 - p3, 6) AS p3 FROM tool_probs",
    "source_files": "SELECT n_nationkey, 'nation' AS source_file FROM nation",
}
