"""Whitespace-separated lines as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def numbers(line: Column) -> Column:
    """All words as doubles; NULL where a word is not a number."""
    return F.transform(words(line), lambda w: w.try_cast("double"))


def is_content(line: Column) -> Column:
    """Neither empty nor a # comment."""
    return (F.length(F.trim(line)) > 0) & ~F.ltrim(line).startswith("#")
