"""Sequences as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, sequence: str = "sequence", longest: int = 100_000) -> DataFrame:
    """Without sequences that hold an N or are too long."""
    return rows.where(~F.contains(sequence, F.lit("N")) & (F.length(sequence) <= longest))


def legal(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    return rows.where(~F.col(sequence).rlike("[^ACGTUacgtu]"))


def without_n_ends(c: Column) -> Column:
    return F.regexp_replace(c, "^N+|N+$", "")


def orf_slice(sequence: Column, start: Column, peptide_length: Column) -> Column:
    return F.substring(sequence, start.cast("int"), (3 * peptide_length).cast("int"))


def gc_share(sequence: Column) -> Column:
    gc = F.length(F.regexp_replace(sequence, "[^GCgc]", ""))
    return F.try_divide(gc.cast("double"), F.length(sequence).cast("double"))


def kmer_counts(rows: DataFrame, k: int, sequence: str = "sequence", by: list[str] | None = None) -> DataFrame:
    """Counts of all runs of k characters, within `by`: summed up in each task before the shuffle."""
    letters = rows.select(*(by or []), F.split(F.col(sequence), "").alias("__c")).where(F.size("__c") >= k)
    at = lambda i: F.concat(*(F.get(F.col("__c"), i + j) for j in range(k)))
    kmers = F.transform(F.sequence(F.lit(0), F.size("__c") - k), at)
    return letters.select(*(by or []), F.explode(kmers).alias("kmer")).groupBy(*(by or []), "kmer").agg(F.count(F.lit(1)).alias("n"))


def structure(c: Column) -> Column:
    """A line of sequence, dot-bracket string and energy as a struct; null fields if it is none."""
    pattern = r"^([A-Za-z]+)([.()]+)[ (]*(-?[0-9.]+)\)?$"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.struct(part(1).alias("rna"), part(2).alias("ss"), part(3).try_cast("double").alias("mfe"))


#: Categories of feature names, tried in this order, case counting.
CATEGORY_RULES = [
    ("Non-B DNA presence flag", r"_present$"),
    ("ORF / coding potential", r"ORF.*_(cpat|lncDC|feelnc|lncfinder)$"),
    ("ORF / coding potential", r"^orf"),
    ("Hexamer score", r"Hexamer.*_(cpat|lncDC)$"),
    ("Fickett score", r"Fickett.*(cpat|lncDC|lncfinder)$"),
    ("Sequence composition ratio", r"\.dist|\.Dist|_Dist|UP\.PCT|SNR"),
    ("k-mer score (FEELnc)", r"kmerScore.*feelnc$"),
    ("Transcript length", r"RNA_size_feelnc$"),
    ("Codon bias", r"^RCB_"),
    ("SS_score (lncDC)", r"^SS_score"),
    ("FFT Power Signal (LncFinder)", r"^Signal"),
    ("MFE", r"^MFE"),
    ("3-mer composition (PLncPRO)", r"^[ACGT]{3}_plncpro$"),
    ("GC content", r"^GC_"),
    ("BLAST conservation", r"(Frame_Entropy|numhits|Bitscore|HitScore)"),
    ("TE content", r"^te_"),
    ("Low-complexity / satellite repeat", r"^lctr_"),
    ("Pseudogene / retrotransposon remnant", r"^pseudo"),
    ("Unknown repeat", r"^unknown_"),
    ("Global repeat landscape", r"^global_"),
    ("Non-B DNA motif", r"^(apr|dr|gq|ir|mr|str|tri|z)_"),
    ("Non-B DNA motif (summary)", r"^(any_nonb|all_nonb|motif_|total_nonb|n_motif_types)"),
]


def category(name: Column, rules: list[tuple[str, str]] | None = None, default: str = "Other") -> Column:
    """The category of the first rule whose pattern is found."""
    out = F
    for label, pattern in rules or CATEGORY_RULES:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise(default)


def keyword_tag(title: Column, keywords: list[tuple[str, str]]) -> Column:
    """The tag of the last keyword that the title holds."""
    low, out = F.lower(title), F
    for word, tag in reversed(keywords):
        out = out.when(F.contains(low, F.lit(word.lower())), tag)
    return out.otherwise(F.lit(None).cast("string"))


def cluster_search(members: DataFrame, query: str, how: str = "partial", match_case: bool = False) -> DataFrame:
    """Members of every cluster that has a feature which is (exact), holds (partial) or matches (regex) the query."""
    c, q = F.col("feature"), F.lit(query)
    if how == "regex":
        hit = c.rlike(query if match_case else f"(?i){query}")
    else:
        c, q = (c, q) if match_case else (F.lower(c), F.lower(q))
        hit = {"partial": F.contains(c, q), "exact": c == q}[how]
    return members.join(members.where(hit).select("cluster").distinct(), "cluster", "left_semi")
