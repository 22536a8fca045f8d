"""What sources share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.terms import Val


class MissingReference(ValueError):
    """In strict mode: an attribute has no value in any row."""


class Reader:
    #: Whether each attribute has one value at most in each row, so that branches can share a scan.
    single_valued = False

    def facts(self) -> list:
        return []

    def present(self, v: Val) -> Column:
        """Whether an attribute has a value; without one the row isn't there."""
        return v.lex.isNotNull() if v.there is None else v.there


def plain_name(query: str) -> str:
    """$.x, $['x'] and x name the column x."""
    m = re.fullmatch(r"\$\[['\"](.+)['\"]\]", query) or re.fullmatch(r"\$\.(.+)", query)
    return m[1] if m else query


def find_name(have: list[str], query: str) -> str | None:
    """A column by its exact name, or by its name in another case."""
    name = plain_name(query)
    if name in have:
        return name
    return next((c for c in have if c.lower() == name.lower()), None)


def explode_all(df: DataFrame, arrays: dict[str, Column], strict: bool) -> DataFrame:
    """The product of the attributes' arrays; a row with an empty one goes."""
    df = df.select(*(c.alias(a) for a, c in arrays.items())) if arrays else df.select(F.lit(1).alias("one"))
    if strict and arrays:
        check_strict(df.select(*(F.max(F.coalesce(F.size(F.col(f"`{a}`")), F.lit(0))).alias(a) for a in arrays)))
    for a in arrays:
        rest = [F.col(f"`{c}`") for c in df.columns if c != a]
        df = df.select(*rest, F.explode(F.col(f"`{a}`")).alias(a))
    return df


def check_strict(largest: DataFrame) -> None:
    """largest: one row with each attribute's largest number of values; nulls if there is no row."""
    row = largest.first()
    missing = sorted(a for a, n in row.asDict().items() if n == 0)
    if missing:
        raise MissingReference(f"references without a value: {missing}")
