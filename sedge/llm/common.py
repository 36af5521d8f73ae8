"""What the operators of this subpackage share: inputs, key columns and small expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.sources.code import ship
from sedge.sources.scratch import scratch_path, written

__all__ = ["documents", "lower_ascii", "opened", "own_names", "quoted", "scratch_path", "ship", "tokenizer_file", "written"]

#: A run of characters that are none of space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null doc_id wherever ids are compared: null comes before every id, as in Spark's own order.
NULL_ID = -(2**63)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. lower() does that for pure ASCII and is much faster than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def quoted(names: list[str]) -> list[Column]:
    """Columns by their names, whatever these hold."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def own_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for further columns that none of the given has, in either case of letters."""
    taken, before = {c.lower() for c in columns}, "__"
    while any((before + w).lower() in taken for w in wanted):
        before += "_"
    return [before + w for w in wanted]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where this machine has the file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def opened(path: str | Callable[[], str]) -> str:
    """A path, given as such or as what each worker finds it by."""
    return path() if callable(path) else path
