"""String, character and bit functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def rtrim(c: Column) -> Column:
    """Without trailing white space (space, line feed, tab, carriage return, form feed, vertical tab)."""
    return F.regexp_replace(c, r"[ \n\t\r\f\x0B]+$(?![\s\S])", "")


def chomp(c: Column) -> Column:
    """Without one line feed at the end."""
    return F.when(c.endswith("\n"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def split_any(c: Column, delimiters: str) -> Column:
    """Parts between any of the characters, empty ones too."""
    import re

    return F.split(c, "[" + "".join(re.escape(d) for d in delimiters) + "]", -1)


@F.pandas_udf(DecimalType(20, 0))
def djb2(s: pd.Series) -> pd.Series:
    """hash * 33 + byte from 5381 on, bytes as signed, modulo 2**64; vectorised over the rows by position."""
    from decimal import Decimal

    raw = [(x or "").encode() for x in s]
    n = np.array([len(x) for x in raw])
    order = np.argsort(-n, kind="stable")
    h = np.full(len(raw), 5381, np.uint64)
    flat = np.frombuffer(b"".join(raw), np.int8).astype(np.int64).view(np.uint64)
    at = (np.cumsum(n) - n)[order]
    live = n[order]
    for k in range(int(n.max(initial=0))):
        own = int(np.searchsorted(-live, -k, "left"))
        h[:own] = h[:own] * np.uint64(33) + flat[at[:own] + k]
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return pd.Series([None if x is None else Decimal(int(v)) for x, v in zip(s, out, strict=True)])


def char_codes(c: Column) -> Column:
    """Code of every character."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


def dense_ranks(c: Column, first: int) -> Column:
    """Each character's rank among those of the string, counted from `first`; null where ranks would pass 127."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    known = F.array_sort(F.array_distinct(chars))
    ranks = F.transform(chars, lambda x: (F.array_position(known, x) - 1 + first).cast("int"))
    return F.when(F.size(known) + first <= 128, ranks)


def fixed_binary(c: Column, width: int) -> Column:
    """Binary digits, filled up with zeros to 8, 32 or 64."""
    return F.lpad(F.bin(c), width, "0")


def byte_histogram(df: DataFrame, text: str) -> DataFrame:
    """(byte, n) over all texts; a task counts all its texts in 256 counters, and only these are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["byte", "n"])

    return df.select(F.col(text).cast("binary").alias("b")).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def remap(c: Column, from_: str, to: str) -> Column:
    return F.translate(c, from_, to)
