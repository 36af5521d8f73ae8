"""Readers and writers of the files that analyses of transcripts start from and end in."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.dates import partial_date
from sedge.functions.ids import biotype, clean_id, id_version, quoted_attribute, simple_id
from sedge.operators.sequences import keyword_tag

GTF_SCHEMA = (
    "seqname STRING, source STRING, feature STRING, start BIGINT, `end` BIGINT, score STRING, strand STRING, "
    "frame STRING, attributes STRING"
)
REPEAT_COLUMNS = [
    "score", "divergence", "deletion", "insertion", "query", "begin", "end", "left", "strand", "repeat", "family",
    "r_begin", "r_end", "r_left", "id",
]


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """full_id and sequence of each record. Records, not lines, are the unit, so lines of any number are put together
    where they are read."""
    records = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    title = F.regexp_replace(F.split_part(record, F.lit("\n"), F.lit(1)), r"\r$", "")
    rest = F.when(F.contains(record, F.lit("\n")), F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n", ""), r"[\r\n]", "")).otherwise("")
    return records.select(title.alias("full_id"), rest.alias("sequence")).where((F.col("full_id") != "") | (F.col("sequence") != ""))


def transcript_fasta(spark: SparkSession, path: str) -> DataFrame:
    """fasta() with its header's fields: transcript_id, gene_id, description (fields two to the third last), biotype."""
    f = F.split("full_id", r"\|")
    n = F.size(f)
    return fasta(spark, path).select(
        F.get(f, 0).alias("transcript_id"),
        F.get(f, 1).alias("gene_id"),
        F.when(n > 4, F.array_join(F.slice(f, 3, n - 4), "|")).alias("description"),
        F.get(f, n - 2).alias("biotype"),
        "sequence",
        "full_id",
    )


def fasta_ids(spark: SparkSession, paths: list[str], simple: bool = True) -> DataFrame:
    """Distinct ids of one or more files, gzipped ones too."""
    ids = reduce(DataFrame.union, (fasta(spark, p).select("full_id") for p in paths))
    return ids.select((simple_id(F.col("full_id")) if simple else F.col("full_id")).alias("id")).distinct()


def unique_fasta(records: DataFrame) -> DataFrame:
    """The records, or an error if an id is there twice."""
    twice = records.groupBy("full_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"duplicate id: {twice[0]}")
    return records


def parsed_ids(rows: DataFrame, column: str = "full_id") -> DataFrame:
    c = F.col(column)
    return rows.withColumns(
        {"seq_id": simple_id(c), "clean_id": clean_id(c), "id_version": id_version(c), "biotype": biotype(c)}
    )


def gtf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=GTF_SCHEMA, quote="")


def gtf_transcripts(spark: SparkSession, path: str) -> DataFrame:
    rows = gtf(spark, path).where("feature = 'transcript'")
    a = F.col("attributes")
    return rows.withColumns({k: quoted_attribute(a, k) for k in ("gene_id", "transcript_id", "transcript_type")})


def cluster_representatives(spark: SparkSession, path: str) -> DataFrame:
    """Ids on lines of a .clstr file that end in a star."""
    lines = spark.read.text(path).where(F.col("value").endswith("*"))
    return lines.select(F.regexp_replace(F.regexp_extract("value", r">([^ ]+)", 1), r"\.\.\.$", "").alias("id"))


def delimited(
    spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t", skip: int = 0, titles: tuple[str, ...] = ()
) -> DataFrame:
    """A table with a header or, given a schema, without. skip: 1 leaves out the first line of each file. titles: what lines
    to be left out begin with, wherever they are; for tables with several title lines."""
    if skip not in (0, 1):
        raise ValueError("of several title lines, say what they begin with (titles)")
    if schema is None:
        return spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    if not titles:
        return spark.read.csv(path, sep=sep, schema=schema, header=bool(skip))
    kept = spark.read.text(path).where(~reduce(lambda a, b: a | b, (F.startswith("value", F.lit(t)) for t in titles)))
    return kept.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).where(F.col("value") != "").select("r.*")


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    readers: dict[str, Callable[[], DataFrame]] = {
        ".tsv": lambda: delimited(spark, path),
        ".csv": lambda: delimited(spark, path, sep=","),
        ".parquet": lambda: spark.read.parquet(path),
        ".json": lambda: spark.read.json(path, multiLine=True),
    }
    for suffix, read in readers.items():
        if path.endswith((suffix, f"{suffix}.gz")):
            return read()
    raise ValueError(f"unknown kind of file: {path}")


class TableRegistry:
    """Names of tables and the path templates where a data set has them."""

    def __init__(self, spark: SparkSession, templates: dict[str, str]):
        self.spark, self.templates = spark, templates

    def load(self, dataset: str, names: list[str] | None = None) -> dict[str, DataFrame]:
        unknown = set(names or []) - set(self.templates)
        if unknown:
            raise ValueError(f"unknown table: {', '.join(sorted(unknown))}")
        return {n: by_suffix(self.spark, self.templates[n].format(dataset=dataset)) for n in names or self.templates}

    def optional(self, dataset: str, name: str) -> DataFrame | None:
        """The table, or nothing if its path is not there."""
        from pyspark.errors import AnalysisException

        try:
            return self.load(dataset, [name])[name]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def with_complete_probabilities(probs: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A data set's probabilities and labels, for rows that have all probabilities."""
    return probs.join(labels, key).dropna("any", subset=columns)


def dataset(binary: DataFrame, full: DataFrame, key: str, columns: list[str], inverted: list[str] = [], real: str = "real") -> dict[str, DataFrame]:  # noqa: B006
    """A data set's frames: probs (the columns, P(noncoding) ones turned round, of rows with a class and with all of them),
    labels of these (coding_class and biotype), features (their rows of the full table) and binary as it is."""
    classes = binary.where(F.col(real).isNotNull()).select(key, F.col(real).cast("int").alias("coding_class")).distinct()
    known = full.join(classes, key).dropna("any", subset=columns)
    turned = [(1 - F.col(c) if c in inverted else F.col(c)).alias(c) for c in columns]
    biotype_ = F.when(F.col("coding_class") == 1, "coding").otherwise("lncRNA").alias("biotype")
    return {
        "probs": known.select(key, *turned),
        "labels": known.select(key, "coding_class", biotype_),
        "features": known.drop("coding_class"),
        "binary": binary,
    }


def repeat_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a RepeatMasker .out table; lines of fewer than 14 fields, headers among them, are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") >= 14) & F.get("p", F.lit(0)).rlike(r"^\d+$"))
    return rows.select(*(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(REPEAT_COLUMNS)))


def bed_overlaps(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    raw = spark.read.csv(path, sep="\t")
    return raw.select(*(F.col(f"_c{i}").alias(n) for i, n in columns.items()))


def json_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several files that each hold an array."""
    return spark.read.json(paths, multiLine=True)


def picks(text: DataFrame, column: str = "value") -> DataFrame:
    """group and id of a JSON object of lists; values that are no lists are left out."""
    pairs = F.from_json(column, "map<string,string>")
    lists = text.select(F.explode(pairs).alias("group", "list")).where(F.col("list").startswith("["))
    return lists.select("group", F.explode(F.from_json("list", "array<string>")).alias("id"))


def metrics_directory(spark: SparkSession, glob: str) -> DataFrame:
    """A row for each file of a training run: `name: number` lines by name, and the four counts of its 2 x 2 matrix."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), "value")
    number = lambda n: F.regexp_extract("value", rf"(?im)^\s*{n}\s*[:=]\s*([-0-9.eE]+)", 1).try_cast("double")
    counts = F.regexp_extract_all(F.regexp_extract("value", r"(?s)\[\s*\[(.*)\]\s*\]", 1), F.lit(r"(\d+)"), 1)
    return files.select(
        "file", *(number(n).alias(n.lower()) for n in ("ACC", "LOSS", "AUC")),
        *(F.get(counts, F.lit(i)).try_cast("long").alias(c) for i, c in enumerate(("tn", "fp", "fn", "tp"))),
    )


def html_items(pages: DataFrame, tag: str, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The texts of all elements of one kind: place, text."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    rows = pages.select(*keep, F.posexplode(found).alias("place", "raw"))
    return rows.select(*keep, "place", F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"))


def present(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def fold_tables(spark: SparkSession, template: str, folds: list[str]) -> DataFrame:
    """The tables of the folds that are there, by the path template, with their fold; an error if none is."""
    there = [f for f in folds if present(spark, template.format(fold=f))]
    if not there:
        raise ValueError(f"no fold of {', '.join(folds)} is there")
    parts = (by_suffix(spark, template.format(fold=f)).withColumn("fold", F.lit(f)) for f in there)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def structure_cache(spark: SparkSession, path: str) -> DataFrame:
    """id, rna, ss and mfe of a cache of two lines for each sequence; nulls where the second is of another form."""
    from sedge.operators.sequences import structure

    return fasta(spark, path).select(F.col("full_id").alias("id"), structure(F.trim("sequence")).alias("s")).select("id", "s.*")


def with_saved_groups(rows: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """rows with the groups that were saved for their keys; null for keys without."""
    return rows.join(saved, key, "left")


def feature_sets(spark: SparkSession, templates: dict[str, str]) -> dict[str, DataFrame]:
    """The feature sets whose files are there, by name."""
    return {n: by_suffix(spark, p) for n, p in templates.items() if present(spark, p)}


def write_fasta(rows: DataFrame, path: str, title: str = "full_id", sequence: str = "sequence", width: int | None = None) -> None:
    s = F.col(sequence)
    if width:
        s = F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")
    rows.select(F.concat(F.lit(">"), title, F.lit("\n"), s)).write.text(path)


def write_tables(tables: dict[str, DataFrame], root: str, text: bool = False) -> None:
    """Each table under its name: Parquet, or tab-separated text for other programs."""
    for name, t in tables.items():
        if text:
            t.write.csv(f"{root}/{name}.tsv", sep="\t", header=True)
        else:
            t.write.parquet(f"{root}/{name}.parquet")


def write_by(rows: DataFrame, column: str, root: str) -> None:
    rows.write.partitionBy(column).parquet(root)


def write_pairwise(results: tuple[DataFrame, DataFrame, DataFrame], root: str, stem: str) -> None:
    """The three tables of a pairwise comparison."""
    for table, name in zip(results, ("mannwhitney", "chi2", "cat_freq"), strict=True):
        table.write.parquet(f"{root}/{stem}_{name}.parquet")


def write_categories(compared: DataFrame, sequences: DataFrame, root: str, categories: list[str], key: str = "new_full_id") -> None:
    """The comparison as a table, and for each boolean column of categories the sequences (full_id, sequence) of its rows
    as FASTA."""
    compared.write.csv(f"{root}/comparison.tsv", sep="\t", header=True)
    for c in categories:
        ids = compared.where(c).select(F.col(key).alias("full_id"))
        write_fasta(sequences.join(ids, "full_id", "left_semi"), f"{root}/{c}_transcripts.fa")


def write_scalar(value: DataFrame, path: str) -> None:
    """The one value of a table of one row, as text."""
    value.select(F.col(value.columns[0]).cast("string").alias("value")).coalesce(1).write.text(path)


def json_list(rows: DataFrame, column: str) -> DataFrame:
    """One row with a sorted JSON list of a column's values; for short lists such as selected features."""
    return rows.agg(F.to_json(F.sort_array(F.collect_set(column))).alias("json"))


def dataset_statistics(rows: DataFrame, gene: str = "gene_id", kind: str = "class") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_transcripts"),
        F.count_distinct(gene).alias("n_genes"),
        F.count_if(F.col(kind) == "coding").alias("n_coding"),
        F.count_if(F.col(kind) == "noncoding").alias("n_noncoding"),
    )


def provenance(rows: DataFrame) -> DataFrame:
    """Adds source_file: the file's name up to its first point; of a part file, the name of the folder it is in."""
    parts = F.split(F.input_file_name(), "/")
    name = F.element_at(parts, -1)
    name = F.when(name.startswith("part-"), F.element_at(parts, -2)).otherwise(name)
    return rows.withColumn("source_file", F.split_part(name, F.lit("."), F.lit(1)))


#: Keywords by which titles are told to be of a tool.
TOOL_KEYWORDS = {
    "CPC": "CPC", "CPAT": "CPAT", "CPC2": "CPC2", "PLncPRO": "PLncPRO", "mRNN": "mRNN,deep recurrent neural network",
    "lncRNAnet": "lncRNAnet", "LncADeep": "LncADeep", "lncFinder": "lncFinder", "FEELnc": "FEELnc", "RNAsamba": "RNAsamba",
    "LncDC": "LncDC", "LncRNA-BERT": "LncRNA-BERT",
}


def bibliography(spark: SparkSession, path: str, keywords: dict[str, str] | None = None, found_only: bool = True) -> DataFrame:
    """title, date and tool of an exported bibliography: CSV with quoted fields that may hold line feeds and doubled quotes.
    A tool's keywords are parted by commas, and further ones go over TOOL_KEYWORDS; of several tools in a title the last
    counts. Dates may be partial; what is none is null. found_only: titles of no tool are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    words = [(w.strip(), tool) for tool, own in (TOOL_KEYWORDS | (keywords or {})).items() for w in own.split(",")]
    day = F.coalesce(F.try_to_timestamp(F.col("Date"), F.lit("yyyy-MM-dd")).cast("date"), partial_date(F.col("Date")))
    out = rows.select(F.col("Title").alias("title"), day.alias("date"), keyword_tag(F.col("Title"), words).alias("tool"))
    return out.where(F.col("tool").isNotNull()) if found_only else out
