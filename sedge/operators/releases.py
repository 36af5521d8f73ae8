"""Comparison of two annotation releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both releases side by side, with the 21 FLAGS. Columns: clean_id and, with old_ or new_ before them, full_id,
    id_version, biotype and class (pc, lncRNA, or NA, as which a null counts). Versions and biotypes have changed if they
    are not the same, also where an id is in one release only."""
    both = old.join(new, "clean_id", "full")
    o, n = F.col("old_full_id").isNotNull(), F.col("new_full_id").isNotNull()
    oc, nc = F.coalesce("old_class", F.lit("NA")), F.coalesce("new_class", F.lit("NA"))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    common, added, removed = o & n, ~o & n, o & ~n
    had, has = oc != "NA", nc != "NA"
    kept, moved = common & had & has & (oc == nc), common & had & has & (oc != nc)
    flags = {
        "is_common": common,
        "transcript_added": added,
        "transcript_removed": removed,
        "version_changed": differs("old_id_version", "new_id_version"),
        "biotype_changed": differs("old_biotype", "new_biotype"),
        "both_have_class": common & had & has,
        "same_class": kept,
        "class_changed": moved,
        "class_added": common & ~had & has,
        "class_removed": common & had & ~has,
        "common_same_class": kept,
        "common_class_change": moved,
        "pc_to_lncRNA": moved & (oc == "pc") & (nc == "lncRNA"),
        "lncRNA_to_pc": moved & (oc == "lncRNA") & (nc == "pc"),
        "added_with_class": added & has,
        "added_pc": added & (nc == "pc"),
        "added_lncRNA": added & (nc == "lncRNA"),
        "removed_with_class": removed & had,
        "removed_pc": removed & (oc == "pc"),
        "removed_lncRNA": removed & (oc == "lncRNA"),
        "no_class": n & ~has,
    }
    return both.withColumns(flags)


FLAGS = [
    "is_common", "transcript_added", "transcript_removed", "version_changed", "biotype_changed", "both_have_class",
    "same_class", "class_changed", "class_added", "class_removed", "common_same_class", "common_class_change", "pc_to_lncRNA",
    "lncRNA_to_pc", "added_with_class", "added_pc", "added_lncRNA", "removed_with_class", "removed_pc", "removed_lncRNA",
    "no_class",
]
#: Of these the sequences of the new release are exported.
CATEGORIES = ["common_same_class", "common_class_change", "added_with_class", "no_class"]


def flow(compared: DataFrame) -> DataFrame:
    """Numbers of ids from class to class: 0 coding, 1 lncRNA, 2 without class, 3 absent."""
    code = lambda c, id_: (
        F.when(F.col(c) == "pc", 0).when(F.col(c) == "lncRNA", 1).when(F.col(id_).isNotNull(), 2).otherwise(3)
    )
    return compared.groupBy(
        code("old_class", "old_full_id").alias("source"), code("new_class", "new_full_id").alias("target")
    ).agg(F.count(F.lit(1)).alias("n"))


def flow_totals(flows: DataFrame) -> DataFrame:
    """What leaves each class on the old side and what comes to each on the new."""
    out = flows.groupBy("source").agg(F.sum("n").alias("n")).select(F.lit("old").alias("side"), F.col("source").alias("class"), "n")
    into = flows.groupBy("target").agg(F.sum("n").alias("n")).select(F.lit("new").alias("side"), F.col("target").alias("class"), "n")
    return out.unionByName(into)


def categories(compared: DataFrame) -> DataFrame:
    """clean_id and category of the ids to be exported; no id has two."""
    held = F.array_compact(F.array(*(F.when(F.col(c), c) for c in CATEGORIES)))
    return compared.select("clean_id", F.explode(held).alias("category"))
