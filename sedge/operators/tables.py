"""From each tool's predictions to one wide table and the label tables.

A tool is described, not programmed: a ToolSpec says which column holds the id, how the label and the coding probability
follow from the others, and what to drop. normalise() turns that into one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.ids import biotype, join_key, simple_id
from sedge.operators.ranks import QUARTILES, with_quantiles

CODING, NONCODING = "coding", "noncoding"


@dataclass(frozen=True)
class ToolSpec:
    name: str
    id: str
    #: Condition for coding, or a map of the tool's own labels; nothing if the tool gives none.
    coding: Column | None = None
    labels: dict[str, str] = field(default_factory=dict)
    label_column: str | None = None
    drops: tuple[str, ...] = ()
    extra: dict[str, Column] = field(default_factory=dict)


def mapped_label(c: Column, labels: dict[str, str]) -> Column:
    """The tool's label in our words; null for others."""
    return reduce(lambda a, kv: a.when(c == kv[0], kv[1]), labels.items(), F.when(F.lit(False), F.lit(None))).otherwise(
        F.lit(None)
    )


def threshold_label(p: Column, cutoff: float, inverted: bool = False) -> Column:
    """Coding unless p is below the cutoff; inverted: unless it is above. A null or NaN compares as neither, so it is
    coding, as in the tables that this follows."""
    low = (p > cutoff) if inverted else (p < cutoff)
    return F.when(low & ~F.isnan(p), NONCODING).otherwise(CODING)


def orf_coverage(start: Column, end: Column, length: Column) -> Column:
    return F.try_divide((end - start + 1).cast("double"), length.cast("double"))


def specs(cpat_cutoff: float = 0.364) -> dict[str, ToolSpec]:
    """The tools known here, as they are run; the cutoff of CPAT may come with its model."""
    c = F.col
    half = lambda name: threshold_label(c(name), 0.5) == CODING
    return {
        s.name: s
        for s in (
            ToolSpec("cpc2", "#ID", labels={CODING: CODING, NONCODING: NONCODING}, label_column="label"),
            ToolSpec("feelnc", "name", coding=c("label") == 1, drops=("label",)),
            ToolSpec(
                "cpat", "seq_ID", coding=threshold_label(c("Coding_prob"), cpat_cutoff) == CODING, drops=("ID",),
                extra={"orf_coverage": orf_coverage(c("ORF_start"), c("ORF_end"), c("mRNA"))},
            ),
            ToolSpec("lncdc", "Description", labels={"mrna": CODING, "lncrna": NONCODING}, label_column="predict"),
            ToolSpec("mrnn", "seq_ID", coding=half("coding_prob")),
            ToolSpec("rnasamba", "sequence_name", labels={CODING: CODING, NONCODING: NONCODING}, label_column="classification"),
            ToolSpec("lncrnabert", "id", labels={"pcRNA": CODING, "ncRNA": NONCODING}, label_column="class"),
            ToolSpec("plncpro", "transcript_id", coding=c("prediction") == 1, drops=("prediction", "Label")),
            ToolSpec("lncadeep", "ID", labels={"Coding": CODING, "Noncoding": NONCODING}, label_column="Index"),
            ToolSpec("lncfinder", "ID", labels={"Coding": CODING, "NonCoding": NONCODING}, label_column="Pred"),
            ToolSpec("lncrnanet", "ID", coding=threshold_label(c("coding_prob"), 0.5, True) == CODING),
        )
    }


def normalise(predictions: DataFrame, spec: ToolSpec) -> DataFrame:
    """seq_ID, label_{tool} and the tool's other columns with its name as suffix."""
    if spec.id not in predictions.columns:
        raise ValueError(f"{spec.name}: no column {spec.id}")
    if spec.coding is not None:
        label = F.when(spec.coding, CODING).otherwise(NONCODING)
    elif spec.label_column:
        label = mapped_label(F.col(spec.label_column), spec.labels)
    else:
        label = F.lit(None).cast("string")
    gone = {spec.id, spec.label_column, *spec.drops}
    rest = [F.col(f"`{c}`").alias(f"{c}_{spec.name}") for c in predictions.columns if c not in gone]
    more = [c.alias(f"{n}_{spec.name}") for n, c in spec.extra.items()]
    return predictions.select(F.col(f"`{spec.id}`").alias("seq_ID"), label.alias(f"label_{spec.name}"), *rest, *more)


def two_modes(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Full outer join of a tool's two runs; only columns that both have get the suffixes."""
    both = (set(a.columns) & set(b.columns)) - {key}
    named = lambda df, s: df.withColumnsRenamed({c: f"{c}{s}" for c in both})
    return named(a, suffixes[0]).join(named(b, suffixes[1]), key, "full")


def merge_tools(tools: Sequence[DataFrame]) -> DataFrame:
    """All tools side by side, by the key that their ids share: a chain of full outer joins, each shuffled by the same key.
    seq_ID is the first tool's, null where it lacks the row."""
    keyed = [t.withColumn("key", join_key(F.col("seq_ID"))) for t in tools]
    keyed = [keyed[0], *(t.drop("seq_ID") for t in keyed[1:])]
    return reduce(lambda a, b: a.join(b, "key", "full"), keyed)


def with_metadata(merged: DataFrame) -> DataFrame:
    return merged.withColumn("metadata", simple_id(F.col("seq_ID"))).withColumn("biotype", biotype(F.col("seq_ID")))


def _labels(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("label_")]


def class_table(full: DataFrame) -> DataFrame:
    return full.select("seq_ID", *_labels(full), *(["biotype"] if "biotype" in full.columns else []))


def real_class(id_: Column, coding: str = "__pc", noncoding: str = "__lnc") -> Column:
    return F.when(F.col(noncoding), NONCODING).when(F.col(coding), CODING)


def _marked(ids: DataFrame, key: str, name: str) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))


def with_real_class(rows: DataFrame, key: str, pc: DataFrame, lnc: DataFrame, other: str | None = None) -> DataFrame:
    """Adds label_real by membership in two sets of ids; an id in both is noncoding. other: the label of ids in neither."""
    met = rows.join(_marked(pc, key, "__pc"), key, "left").join(_marked(lnc, key, "__lnc"), key, "left")
    label = real_class(F.col(key))
    return met.withColumn("label_real", label if other is None else F.coalesce(label, F.lit(other))).drop("__pc", "__lnc")


def simple_table(classes: DataFrame, key: str, pc: DataFrame, lnc: DataFrame) -> DataFrame:
    """Rows whose real class is known."""
    return with_real_class(classes, key, pc, lnc).where(F.col("label_real").isNotNull())


def unclassified_table(simple: DataFrame) -> DataFrame:
    """Rows to which at least one tool gives no label."""
    return simple.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in _labels(simple))))


def binary_table(simple: DataFrame) -> DataFrame:
    """Complete rows; labels as booleans under the tools' names, the real one as `real`."""
    complete = simple.dropna("any", subset=_labels(simple))
    return complete.select(
        "seq_ID", *((F.col(c) == CODING).alias(c.removeprefix("label_")) for c in _labels(simple))
    )


def merge_folds(folds: Sequence[DataFrame]) -> DataFrame:
    """All folds under each other, with fold1, fold2, ... by their places."""
    tagged = [f.withColumn("fold", F.lit(f"fold{i}")) for i, f in enumerate(folds, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def beside(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames side by side by key; of columns with one name the first frame's stays."""
    seen, parts = {key}, []
    for f in frames:
        parts.append(f.select(key, *(c for c in f.columns if c not in seen)))
        seen |= set(f.columns)
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def aligned(spine: DataFrame, rows: DataFrame, key: str, fill: float | None = 0.0, cut: bool = False) -> DataFrame:
    """rows by the keys of spine; numbers that are missing are filled. cut: of the rows' keys only what is before the first
    bar counts."""
    if cut:
        rows = rows.withColumn(key, F.split_part(F.col(key), F.lit("|"), F.lit(1)))
    out = spine.select(key).join(rows, key, "left")
    return out if fill is None else out.fillna(fill)


def ordered_lookup(order: DataFrame, rows: DataFrame, key: str, position: str = "position") -> DataFrame:
    """rows whose keys are listed, in the order of the list."""
    return rows.join(order, key).orderBy(position)


def subset(rows: DataFrame, by: str, column: str = "class", values: Sequence[str] = ()) -> DataFrame:
    """all, class (column is one of values), contains or startswith (any of values)."""
    c = F.col(column)
    if by == "all":
        return rows
    if by == "class":
        return rows.where(c.isin(*values))
    if by in ("contains", "startswith"):
        return rows.where(reduce(lambda a, b: a | b, (getattr(c, by)(v) for v in values)))
    raise ValueError(f"unknown kind of subset: {by}")


def nearest(rows: DataFrame, dates: DataFrame, on: str, date: str, value: str, most: int = 10_000) -> DataFrame:
    """Adds the value of the nearest date, the earlier of two equally near. dates is a list of releases or the like, of at
    most `most` rows; it becomes one array that every row looks through."""
    known = dates.where(F.col(date).isNotNull()).select(F.to_date(date).alias("d"), F.col(value).alias("v"))
    if known.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} dates")
    table = known.agg(F.collect_list(F.struct("d", "v")).alias("__dates")).withColumn("__on", F.lit(1))
    gap = lambda x: F.abs(F.datediff(F.to_date(on), x["d"]))
    best = F.array_min(F.transform("__dates", lambda x: F.struct(gap(x).alias("gap"), x["d"].alias("d"), x["v"].alias("v"))))
    met = rows.withColumn("__on", F.lit(1)).join(F.broadcast(table), "__on")  # one row
    return met.withColumn(value, F.when(F.col(on).isNotNull(), best["v"])).drop("__on", "__dates")


def profiles(picks: DataFrame, sources: dict[str, DataFrame | None], key: str) -> DataFrame:
    """Picked ids with what each source says of them, its columns with its name before them; a source that is not there
    gives no columns."""
    out = picks
    for name, rows in sources.items():
        if rows is not None:
            out = out.join(rows.withColumnsRenamed({c: f"{name}_{c}" for c in rows.columns if c != key}), key, "left")
    return out


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std, min, quartiles and max of each column."""
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "v")
    sums = long.groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    return with_quantiles(sums, long, ["column"], "v", QUARTILES)
