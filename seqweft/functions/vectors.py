"""Distances between vectors held as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch of packed rows between Spark and Python.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(2.0)).otherwise(1 - dot(a, b) / F.nullif(norm, F.lit(0.0)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(ids, width, whole, data): up to `size` vectors of equal length a row, as bytes; not whole are those with nulls."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("embedding")
            lists = column.to_pylist()
            width = np.array([-1 if x is None else len(x) for x in lists])
            whole = np.array([x is not None and None not in x for x in lists], bool)
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                for at in range(0, len(own), size):
                    some = own[at : at + size]
                    data = np.array([[0.0 if v is None else v for v in lists[i] or ()] for i in some], np.float64)
                    yield pa.RecordBatch.from_pydict({"ids": [ids[some].astype(np.int64).tobytes()], "width": pa.array([int(w)], pa.int32()), "whole": [whole[some].tobytes()], "data": [data.tobytes()]})

    return rows.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "ids binary, width int, whole binary, data binary")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of packed rows to pairs of vectors; entries are summed up in their order."""
    for batch in batches:
        for r in batch.to_pylist():
            q, v = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            x, y = (np.frombuffer(r[c], np.float64).reshape(len(i), max(r[w], 0)) for c, i, w in (("q_data", q, "q_width"), ("data", v, "width")))
            whole = np.frombuffer(r["q_whole"], bool)[:, None] & np.frombuffer(r["whole"], bool)[None]
            alike = whole & (r["q_width"] == r["width"])
            dot, square = np.zeros((len(q), len(v))), np.zeros((len(q), len(v)))
            xx, yy = np.zeros(len(q)), np.zeros(len(v))
            with np.errstate(all="ignore"):
                for k in range(x.shape[1]):
                    xx += x[:, k] * x[:, k]
                for k in range(y.shape[1]):
                    yy += y[:, k] * y[:, k]
                for k in range(min(x.shape[1], y.shape[1])):
                    a, b = x[:, k][:, None], y[:, k][None]
                    dot += a * b
                    gap = a - b
                    square += gap * gap
                norm = np.sqrt(xx)[:, None] * np.sqrt(yy)[None]
                cosine = np.where(norm == 0, 2.0, 1 - dot / norm)
            own = (q[:, None] != v[None]).ravel()
            no_cosine = ~(alike | whole & (norm == 0)).ravel()[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q, len(v))[own]), pa.array(np.tile(v, len(q))[own]), pa.array(cosine.ravel()[own], mask=no_cosine), pa.array(np.sqrt(square).ravel()[own], mask=~alike.ravel()[own])],
                ["q", "v", "cosine", "euclidean"],
            )


def to_queries(vectors: DataFrame, every: int = 50, block: int = 256) -> DataFrame:
    """(q, v, cosine, euclidean) from the stated queries, the rows whose id `every` divides, to all rows.

    Vectors are packed, `block` a row, and each packed row of queries meets each packed row of all vectors; a task holds
    one pair of them. A pair with a null or of unequal lengths has no distance, but cosine 2 where a vector is zero.
    """
    rows = vectors.select("vec_id", "embedding")
    spark = vectors.sparkSession
    now = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # with another unit it is larger
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    queries = _packed(rows.where(F.col("vec_id") % every == 0).repartition(max(1, parts // 8), "vec_id"), block)
    every_row = _packed(rows.repartition(parts, "vec_id"), block)
    met = every_row.crossJoin(queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]))
    kind = vectors.schema["vec_id"].dataType
    found = met.mapInArrow(_distances, "q long, v long, cosine double, euclidean double")
    return found.select(F.col("q").cast(kind).alias("q"), F.col("v").cast(kind).alias("v"), F.round("cosine", 6).alias("cosine"), F.round("euclidean", 6).alias("euclidean"))
