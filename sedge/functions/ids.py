"""Normal forms of transcript identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_id(c: Column) -> Column:
    """What stands before the first bar."""
    return F.split_part(c, F.lit("|"), F.lit(1))


def clean_id(c: Column) -> Column:
    """The simple id without its version."""
    return F.split_part(simple_id(c), F.lit("."), F.lit(1))


def id_version(c: Column) -> Column:
    """The version of the simple id, empty if it has none."""
    return F.split_part(simple_id(c), F.lit("."), F.lit(2))


def biotype(c: Column) -> Column:
    """The second to last field; headers end in a bar."""
    return F.split_part(c, F.lit("|"), F.lit(-2))


def join_key(c: Column) -> Column:
    """What stands before the gene id, less one character; tools write different separators there."""
    before = F.split_part(c, F.lit("ENSG"), F.lit(1))
    return F.substring(before, F.lit(1), F.greatest(F.length(before) - 1, F.lit(0)))


def dotted_id(c: Column) -> Column:
    return F.translate(c, "|-", "..")


def without_version(c: Column) -> Column:
    return F.regexp_replace(c, r"\.\d+$", "")


def quoted_attribute(attributes: Column, name: str) -> Column:
    """The value of `name "value";`, null if it is not there."""
    return F.nullif(F.regexp_extract(attributes, rf'{name} "([^"]+)"', 1), F.lit(""))
