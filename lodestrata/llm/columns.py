"""Columns by position, so that the input's names can't clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...; ``toDF(*names)`` gives the names back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives a column."""
    return f"c{df.columns.index(name)}"


def fingerprint(value: Column) -> tuple[Column, Column]:
    """128 bits for a value. The second hash begins with another seed; hashing a number after the value would only rehash the first."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)
