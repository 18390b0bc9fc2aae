"""Shaping of result tables for reports: rows and columns to keep, names to print."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Motifs left out of the printed tables, and replacements that turn a column into a heading, in order.
LEFT_OUT = ("MA0210.1", "MA0218.1", "MA0026.1")
BEFORE = (("n_states", "number_of_states_in"), ("_", " "))
AFTER = (("Db", "DB"), ("Fsm", "FSM"), ("Mse", "Score MSE"), ("Id", "ID"), ("Number Of", r"\#"), ("In", "in"), ("Perc", r" \%"), ("Sec", " (sec.)"))


def printed_motifs(df: DataFrame, column: str = "matrix_id") -> DataFrame:
    """Rows that are neither reverse complements (``.rc`` in the name) nor left out."""
    c = F.col(column)
    keep = ~c.contains(".rc")
    for name in LEFT_OUT:
        keep = keep & ~c.contains(name)
    return df.filter(keep)


def heading(column: str) -> str:
    """A column's name as a heading."""
    for old, new in BEFORE:
        column = column.replace(old, new)
    column = column.title()
    for old, new in AFTER:
        column = column.replace(old, new)
    return column


def with_headings(df: DataFrame) -> DataFrame:
    return df.toDF(*[heading(c) for c in df.columns])


def selected(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns; missing ones are an error that names them all."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns that don't exist: {missing}")
    return df.select(*[f"`{c}`" for c in columns])


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name fits a pattern in which ``*`` stands for anything."""
    names = [c for c in df.columns if re.fullmatch(pattern.replace("*", ".*"), c)]
    if not names:
        raise ValueError(f"no column fits {pattern}")
    return names
