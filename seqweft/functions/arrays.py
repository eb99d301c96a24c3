"""Array columns as lists: what an array column can't do by one built-in function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def insert_at(x: Column, place: int, value: Column) -> Column:
    """The value before the element at `place` (from 0), or at the end of a shorter list."""
    return F.concat(F.slice(x, 1, place), F.array(value), F.slice(x, F.lit(place + 1), F.greatest(F.size(x) - place, F.lit(0))))


def set_at(x: Column, place: int, value: Column) -> Column:
    """The list with the element at `place` (from 0) exchanged; a shorter list stays as it is."""
    return F.transform(x, lambda e, i: F.when(i == place, value).otherwise(e))


def as_text(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda e: e.cast("string")), ",")
