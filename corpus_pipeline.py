"""The corpus pipeline, part of the llm subpackage: five stages, each of which calls one of its operators.

run() takes the documents of a folder through all of them: documents that fail a quality rule go, of equal ones one
stays, of near duplicates (a similarity of 0.8 or more of their five-word shingles) one stays, words of passages that a
smaller document has go, and what is left is packed into training sequences. Every stage is written to the shared
folder and read again, so a lost executor never costs more than the stage at hand, and what went before it is deleted.

Defined results: all columns of the input come through the first four stages as they were, but for text and n_chars,
which the fourth sets anew where it took words out; names cannot clash, as the operators choose names for their own
columns that the input has not. Nulls, ties, repeated rows and empty tables: see the operators.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import exact_dedup, packing, quality, simhash, substring
from sedge.llm.common import documents, tokenizer_file, written
from sedge.sources.scratch import clear_since, scratch_mark


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, quality.STANDARD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, partial(tokenizer_file, "word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("near dedup", near),
    ("substring dedup", passages),
    ("packing", pack),
]
#: The third stage needs XXH64 and the last a tokenizer, which SQL has not; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), scratch_mark(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        clear_since(spark, before)  # what the stage wrote on its way, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
