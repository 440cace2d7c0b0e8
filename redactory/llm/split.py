"""Folds of documents by their id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))
