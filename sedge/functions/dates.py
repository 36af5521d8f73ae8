"""Partial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date(c: Column) -> Column:
    """MM.YYYY and YYYY-MM give the 15th of the month, YYYY the 15th of June; anything else null."""
    number = lambda i, n: F.substring(c, i, n).try_cast("int")
    middle = F.lit(15)
    valid = lambda m: m.between(1, 12)
    return (
        F.when(c.rlike(r"^\d{2}\.\d{4}$") & valid(number(1, 2)), F.make_date(number(4, 4), number(1, 2), middle))
        .when(c.rlike(r"^\d{4}-\d{2}$") & valid(number(6, 2)), F.make_date(number(1, 4), number(6, 2), middle))
        .when(c.rlike(r"^\d{4}$"), F.make_date(number(1, 4), F.lit(6), middle))
    )
