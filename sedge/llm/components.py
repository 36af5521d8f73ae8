"""Connected components of a graph of links, by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is a grouped minimum and a join, so no node's neighbours are ever gathered in one task; a node with very many
links is split by the skew join, as both sides of each join are shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import written


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """links has u and v, of one type that has an order. Return node and root, for every node with a link to another
    but the roots: root is the smallest node that node reaches. Null nodes have no links."""
    a, b = F.col("u"), F.col("v")
    edges = written(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(b.alias("u"), a.alias("v")))
        lowest = written(both.groupBy("u").agg(F.least(F.min("v"), a).alias("m")), "cc-lowest")
        large = written(
            both.where(b > a)
            .hint("merge")
            .join(lowest, "u")
            .select(b.alias("u"), F.col("m").alias("v"))
            .distinct(),
            "cc-large",
        )
        below = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-below")
        small = large.hint("merge").join(below, "u").where(b != F.col("m")).select(b.alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
