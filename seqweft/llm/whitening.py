"""Whitening of embeddings by exact cross-products over bit planes.

Entries become whole numbers, shifted by the least of their dimension so that none is negative. A task packs each bit of
each dimension across rows into 64-bit words, a plane; the number of ones in the AND of two planes, weighted by the planes'
powers of two, adds up to the exact cross-product of two dimensions. Sums over tasks are exact too, and n * cross - sum *
sum, the centred cross-products as whole numbers, go to the eigendecomposition. No sum depends on the order of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm._arrow import small_batches

#: An entry c becomes floor(SCALE * c) + SHIFT; rows that a task packs at once; components that are returned at most.
SCALE, SHIFT, ROWS, COMPONENTS = 64, 1_000_000, 4096, 32
#: Entries beyond this size are cut to it, so that all fits 64 bits; words of planes that are combined at once.
_FAR, _WORDS = float(1 << 61), 1 << 18


class Whitening(NamedTuple):
    """What was fitted: rows, sums of the dimensions, unit components as columns by falling eigenvalue, the eigenvalues, and
    their sum over all components."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def integers(array: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have only finite entries (and `size` of them), and these as whole numbers, by row."""
    keep = np.flatnonzero(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
    if size is not None:
        keep = keep[pc.list_value_length(array.take(pa.array(keep))).to_numpy(zero_copy_only=False) == size]
    rows = array.take(pa.array(keep))
    many = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    value = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    fine = np.logical_and.reduceat(np.isfinite(value), np.cumsum(many) - many) if len(keep) else np.zeros(0, bool)
    value = value[np.repeat(fine, many)]
    return keep[fine], np.floor(np.clip(SCALE * value, -_FAR, _FAR)).astype(np.int64) + SHIFT


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of rows of whole numbers that aren't negative: for each dimension bits[d] rows of 64-bit words."""
    n, d = y.shape
    words = -(-n // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for k in range(d):
        own = np.ascontiguousarray(y[:, k]).astype(np.uint64)
        for b in range(int(bits[k])):
            packed = np.packbits(((own >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def plane_products(p: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ones in the AND of each of the planes first to last - 1 with each plane from first on."""
    out = np.zeros((last - first, len(p) - first), np.int64)
    step = max(1, _WORDS // max(1, (last - first) * p.shape[1]))
    for a in range(first, len(p), step):
        both = p[first:last, None, :] & p[None, a : a + step, :]
        out[:, a - first : a - first + both.shape[1]] = np.bitwise_count(both).sum(2, dtype=np.int64)
    return out


def products(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact cross-products of the columns of y (upper half), by weighted counts over bit planes; Python's integers where
    64 bits might not do."""
    d, most = len(bits), int(bits.max(initial=0))
    kind = np.int64 if 2 * most + len(y).bit_length() < 62 else object
    p, ends = planes(y, bits), np.cumsum(bits)
    power = np.array([1 << b for k in range(d) for b in range(int(bits[k]))], kind)
    cross = np.zeros((d, d), kind)
    for k in range(d):
        first, last = int(ends[k] - bits[k]), int(ends[k])
        if first == last:
            continue
        counts = plane_products(p, first, last).astype(kind)
        weighted = (power[first:last, None] * counts).sum(0) * power[first:]
        total = np.append(np.zeros(1, kind), np.cumsum(weighted))
        cross[k, k:] = total[ends[k:] - first] - total[ends[k:] - bits[k:] - first]
    return cross


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, 31 bits) that a whole number that isn't negative is made of."""
    k = 0
    while value:
        yield k, value & 0x7FFFFFFF
        value >>= 31
        k += 1


def _dimension(vectors: DataFrame) -> tuple[int, list[int], list[int]]:
    """Entries of a vector (as most rows have; of several the most), and the least and largest of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            array = batch.column("v")
            for size in np.unique(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)).tolist():
                rows, x = integers(array, size) if size else ([], None)
                if not len(rows):
                    continue
                x = x.reshape(-1, size)
                own = found.setdefault(size, [0, x.min(0), x.max(0)])
                found[size] = [own[0] + len(x), np.minimum(own[1], x.min(0)), np.maximum(own[2], x.max(0))]
        for size, (n, low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(low), pa.array(high)], ["size", "d", "n", "low", "high"])

    stats = vectors.mapInArrow(run, "size int, d int, n long, low long, high long").groupBy("size", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    size = stats.where("d = 0").orderBy(F.desc("n"), F.desc("size")).select("size").first()
    if size is None:
        return 0, [], []
    rows = stats.where(F.col("size") == size[0]).orderBy("d").collect()
    return size[0], [r["low"] for r in rows], [r["high"] for r in rows]


def fit(embeddings: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors that whiten() keeps; None without any. The driver gets a row for each pair of
    dimensions, however many vectors there are."""
    small_batches(embeddings.sparkSession)
    vectors = embeddings.select(F.col(vector_col).cast("array<double>").alias("v"))
    size, low, high = _dimension(vectors)
    if not size:
        return None
    least, bits = np.array(low, np.int64), np.array([(h - a).bit_length() for a, h in zip(low, high, strict=True)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross, held = 0, np.zeros(size, object), np.zeros((size, size), object), []

        def add() -> None:
            nonlocal n, sums, cross
            y = np.concatenate(held)
            n, sums, cross = n + len(y), sums + y.sum(0, dtype=object if int(bits.max()) > 40 else np.int64), cross + products(y, bits)

        for batch in batches:
            x = integers(batch.column("v"), size)[1].reshape(-1, size) - least if batch.num_rows else np.zeros((0, size), np.int64)
            for a in range(0, len(x), ROWS):
                held.append(x[a : a + ROWS])
                if sum(map(len, held)) >= ROWS:
                    add()
                    held = []
        if held and sum(map(len, held)):
            add()
        if not n:
            return
        # -1, -1: the rows; -1, j: the sum of j; i, j: their cross-product
        cells = [(-1, -1, n), *((-1, j, int(s)) for j, s in enumerate(sums)), *((i, j, int(cross[i, j])) for i in range(size) for j in range(i, size))]
        rows = [(i, j, k, part) for i, j, value in cells for k, part in _limbs(value)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "part"])

    made = vectors.mapInArrow(run, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part"))
    total: dict[tuple[int, int], int] = {}
    for r in made.collect():
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["part"] << (31 * r["k"]))
    n = total[-1, -1]
    sums = [total.get((-1, j), 0) for j in range(size)]
    v = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):  # whole numbers until the last division, which rounds once
            v[i, j] = v[j, i] = (n * total.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, components = np.linalg.eigh(v)
    values, components = values[::-1], components[:, ::-1]
    sign = np.sign(components[np.abs(components).argmax(0), np.arange(size)])
    return Whitening(n, [s + n * a for s, a in zip(sums, low, strict=True)], components * sign, values, float(np.trace(v)))


def _usable(fitted: Whitening, most: int) -> int:
    """Components with a variance above what rounding gives, `most` at most."""
    return int((fitted.values[:most] > len(fitted.values) * np.finfo(float).eps * max(fitted.values[0], 0)).sum())


def _whitened(x: np.ndarray, fitted: Whitening, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of rows of whole numbers on the first k components, and their exact deviations."""
    n, sums = fitted.n, fitted.sums
    mean = [divmod(s, n) for s in sums]
    # n * x - S = n * (x - S div n) - S mod n, which stays small
    near = x - np.array([q for q, _ in mean], np.int64)
    centred = near - np.array([r / n for _, r in mean])
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    kind = np.int64 if most * most * x.shape[1] < 1 << 62 else object
    scaled = near.astype(kind) * n - np.array([r for _, r in mean], kind)
    return centred @ (fitted.components[:, :k] / np.sqrt(fitted.values[:k])), (scaled * scaled).sum(1)


def identity_error(embeddings: DataFrame, fitted: Whitening, vector_col: str = "embedding", components: int = COMPONENTS) -> float:
    """How far the covariance of the whitened vectors is from the identity at most, measured on all of them."""
    k, size = _usable(fitted, components), len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _whitened(integers(batch.column("v"), size)[1].reshape(-1, size), fitted, k)[0]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "part"])

    made = embeddings.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part"))
    cov = np.zeros(k * k)
    for r in made.collect():
        cov[r["at"]] = r["part"] / fitted.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0))


def whiten(embeddings: DataFrame, fitted: Whitening | None = None, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    Left out are null and empty vectors, those with null or non-finite entries, and those of another length than most have
    (of several lengths, the greatest). Components without variance are left out too, since nothing can be divided by it:
    equal vectors, or one vector, or none, give no row. Rows that repeat an id, or have none, are whitened one by one.
    Other columns are left out. deviation is null where it doesn't fit 64 bits.
    """
    fitted = fitted or fit(embeddings, vector_col)
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = _usable(fitted, components) if fitted else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, size = identity_error(embeddings, fitted, vector_col, components), len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = fitted.values[:k] / fitted.trace
        for batch in batches:
            rows, x = integers(batch.column("v"), size) if batch.num_rows else (np.zeros(0, np.int64), None)
            for a in range(0, len(rows), ROWS):
                own = rows[a : a + ROWS]
                w, deviation = _whitened(x.reshape(-1, size)[a : a + ROWS], fitted, k)
                m = len(own) * k
                far = [int(v) if v < 1 << 63 else None for v in deviation.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(m, fitted.n)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))), pa.array(w.ravel()), pa.array(np.tile(explained, len(own))), pa.array(np.full(m, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def brute_force(rows: list[tuple[int, list[float] | None]]) -> tuple[dict[int, int], np.ndarray]:
    """The deviations of the contract and n * n * V, by Python's integers, for tests on small tables."""
    import math

    kept = [(k, [math.floor(SCALE * float(c)) + SHIFT for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    own = [[n * x[j] - s[j] for j in range(d)] for _, x in kept]
    return {k: sum(c * c for c in y) for (k, _), y in zip(kept, own, strict=True)}, np.array([[sum(y[i] * y[j] for y in own) // n for j in range(d)] for i in range(d)], object)
