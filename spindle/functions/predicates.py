"""Predicates and keys of the archive's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no date.
NO_DATE = ("", "0000-00-00", "NULL")


def blank_date(name: str) -> Column:
    """Null or a placeholder."""
    return F.col(name).isNull() | F.col(name).isin(*NO_DATE)


def year(name: str) -> Column:
    return F.expr(f"try_cast(substr({name}, 1, 4) AS INT)")


def decade(name: str) -> Column:
    return F.expr(f"try_cast(concat(substr({name}, 1, 3), '0') AS INT)")


def ec_true(name: str) -> Column:
    return F.col(name) == 1


def has_key(name: str) -> Column:
    """A foreign key that points somewhere: neither null nor 0."""
    return F.col(name).isNotNull() & (F.col(name) != 0)


def blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def shown(name: str, otherwise: str = "(none)") -> Column:
    """The trimmed text, or a word for its absence."""
    return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit(otherwise))
