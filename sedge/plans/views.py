"""Views over the star-schema tables that stand for the engine's inputs, each with the SQL that defines the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = [f"p{j}" for j in range(8)]
FEATURES = [f"f{j}" for j in range(8, 24)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, coding_class (0/1) and the probability of coding by eight tools."""
    e = table(spark, sf_dir, "embeddings")
    p = [(1 / (1 + F.exp(F.col("embedding")[j].cast("double") * -8))).alias(t) for j, t in enumerate(TOOLS)]
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("coding_class"), *p)


TOOL_PROBS = (
    "tool_probs AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS coding_class, "
    + ", ".join(f"1 / (1 + exp(CAST(embedding[{j + 1}] AS DOUBLE) * -8)) AS {t}" for j, t in enumerate(TOOLS))
    + " FROM embeddings)"
)


def tool_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fold, the tools' boolean calls and `real`."""
    return tool_probs(spark, sf_dir).select(
        "id",
        F.concat(F.lit("fold"), F.col("id") % 5 + 1).alias("fold"),
        *((F.col(t) > 0.5).alias(t) for t in TOOLS),
        (F.col("coding_class") == 1).alias("real"),
    )


TOOL_LABELS = (
    f"{TOOL_PROBS}, tool_labels AS (SELECT id, 'fold' || (id % 5 + 1) AS fold, "
    + ", ".join(f"{t} > 0.5 AS {t}" for t in TOOLS)
    + ", coding_class = 1 AS real FROM tool_probs)"
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, coding_class and sixteen numeric features, wide."""
    e = table(spark, sf_dir, "embeddings")
    f = [F.round(F.col("embedding")[j].cast("double"), 3).alias(n) for j, n in zip(range(8, 24), FEATURES, strict=True)]
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("coding_class"), *f)


FEATURES_SQL = (
    "features AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS coding_class, "
    + ", ".join(
        f"round(CAST(embedding[{j + 1}] AS DOUBLE), 3) AS {n}" for j, n in zip(range(8, 24), FEATURES, strict=True)
    )
    + " FROM embeddings)"
)


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, coding_class, feature, value."""
    return features(spark, sf_dir).unpivot(["id", "coding_class"], FEATURES, "feature", "value")


FEATURES_LONG = (
    f"{FEATURES_SQL}, features_long AS (UNPIVOT features ON {', '.join(FEATURES)} INTO NAME feature VALUE value)"
)


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of order lines and their numbers, long: grp, feature, value. For scale."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("grp"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_tax").cast("double").alias("tax"),
        F.col("l_extendedprice").cast("double").alias("price"),
    ).unpivot(["grp"], ["quantity", "discount", "tax", "price"], "feature", "value")


LINE_FEATURES = (
    "wide AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS grp, CAST(l_quantity AS DOUBLE) AS quantity, "
    "CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, CAST(l_extendedprice AS DOUBLE) AS price "
    "FROM lineitem WHERE l_returnflag IN ('A', 'R')), "
    "line_features AS (UNPIVOT wide ON quantity, discount, tax, price INTO NAME feature VALUE value)"
)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes-or-no features of the same two groups, long: grp, feature, value (0/1, null in some of odd_line)."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    flags = {
        "bulk": F.col("l_quantity") > 25,
        "cheap": F.col("l_extendedprice") < 20000,
        "discounted": F.col("l_discount") > 0.05,
        "taxed": F.col("l_tax") > 0.04,
        "odd_line": F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") % 2 == 1),
    }
    return lines.select(
        (F.col("l_returnflag") == "R").cast("int").alias("grp"), *(c.cast("int").alias(n) for n, c in flags.items())
    ).unpivot(["grp"], list(flags), "feature", "value")


CATEGORIES = (
    "flags AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS grp, CAST(l_quantity > 25 AS INT) AS bulk, "
    "CAST(l_extendedprice < 20000 AS INT) AS cheap, CAST(l_discount > 0.05 AS INT) AS discounted, "
    "CAST(l_tax > 0.04 AS INT) AS taxed, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber % 2 = 1 AS INT) END AS odd_line "
    "FROM lineitem WHERE l_returnflag IN ('A', 'R')), "
    "categories AS (FROM flags UNPIVOT INCLUDE NULLS (value FOR feature IN (bulk, cheap, discounted, taxed, odd_line)))"
)


def release(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One side of a release comparison: clean_id, full_id, id_version, biotype and class, `side` before the others."""
    o = table(spark, sf_dir, "orders")
    moved = F.col("o_orderkey") % 13 == 0
    if side == "old":
        rows, version, status = o.where(F.col("o_orderkey") % 10 != 0), F.lit("1"), F.col("o_orderstatus")
    else:
        rows = o.where(F.col("o_orderkey") % 7 != 0)
        version = F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("1")
        status = F.when(moved, F.translate("o_orderstatus", "FOP", "OPF")).otherwise(F.col("o_orderstatus"))
    kind = F.when(status == "F", "pc").when(status == "O", "lncRNA").otherwise("NA")
    clean = F.concat(F.lit("T"), F.col("o_orderkey"))
    return rows.select(
        clean.alias("clean_id"),
        F.concat(clean, F.lit("."), version).alias(f"{side}_full_id"),
        version.alias(f"{side}_id_version"),
        F.col("o_orderpriority").alias(f"{side}_biotype"),
        kind.alias(f"{side}_class"),
    )


def _release_sql(side: str) -> str:
    where, version, status = {
        "old": ("o_orderkey % 10 <> 0", "'1'", "o_orderstatus"),
        "new": (
            "o_orderkey % 7 <> 0",
            "CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END",
            "CASE WHEN o_orderkey % 13 = 0 THEN translate(o_orderstatus, 'FOP', 'OPF') ELSE o_orderstatus END",
        ),
    }[side]
    return (
        f"{side}_release AS (SELECT 'T' || o_orderkey AS clean_id, 'T' || o_orderkey || '.' || {version} AS {side}_full_id, "
        f"{version} AS {side}_id_version, o_orderpriority AS {side}_biotype, CASE {status} WHEN 'F' THEN 'pc' "
        f"WHEN 'O' THEN 'lncRNA' ELSE 'NA' END AS {side}_class FROM orders WHERE {where})"
    )


RELEASES = f"{_release_sql('old')}, {_release_sql('new')}"


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, feature, id and an attribution value, long."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("fold"),
        F.concat("l_returnflag", "l_linestatus", F.lit("_"), F.col("l_partkey") % 8).alias("feature"),
        F.col("l_orderkey").alias("id"),
        (F.col("l_discount").cast("double") - F.col("l_tax").cast("double")).alias("value"),
    )


ATTRIBUTIONS = (
    "attributions AS (SELECT CAST(l_linenumber AS INT) AS fold, l_returnflag || l_linestatus || '_' || (l_partkey % 8) "
    "AS feature, l_orderkey AS id, CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE) AS value FROM lineitem)"
)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("transcript_id"),
        F.col("source").alias("gene_id"),
        F.col("lang").alias("biotype"),
        F.col("text").alias("sequence"),
        F.col("n_chars").alias("length"),
        "quality",
    )


TRANSCRIPTS = (
    "transcripts AS (SELECT d.doc_id AS transcript_id, source AS gene_id, lang AS biotype, text AS sequence, "
    "n_chars AS length, quality FROM documents d LEFT JOIN labels l USING (doc_id))"
)
