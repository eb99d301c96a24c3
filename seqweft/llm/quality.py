"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts makes a table of about twenty statistics a document. Each partition of its labelled rows sums
its part of the normal equations, and the sums are added in a tree; the solution has a fixed size. Calibration counts the
labelled rows in a fixed number of score bins and pools adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm._arrow import LOWER, bit_map, id_and_text, is_set, map_bits, mix, slices, utf8, words, written

#: Random features, ridge penalty, width of the kernel in standard deviations, bins of the calibration, seed.
FEATURES, RIDGE, WIDTH, BINS, SEED = 256, 1.0, 4.0, 200, 7
#: Partial sums that are added in one task.
FAN_IN = 16
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "symbols", "stops", "commas", "bars", "lines", "high",
    "same_as_last", "same_as_last_but_one", "longest_repeat", "distinct", "distinct_pairs", "symbol_words", "upper_words", "repeated_lines",
]

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 symbol, 5 white space, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
for _b in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _CLASS[_b] = 4
for _b in b" \t\n\r\x0b\x0c":
    _CLASS[_b] = 5
_NOT_SPACE, _NOT_BREAK, _AS_IS = _CLASS != 5, np.arange(256) != 10, np.arange(256, dtype=np.uint8)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], 0 where that is empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[first], minlength=n).astype(np.float64)


def statistics(array: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, off = utf8(array)
    n = len(array)
    size = np.maximum(np.diff(off), 1).astype(np.float64)
    kind = _CLASS[data]
    count = {k: _sums(kind == k, off) for k in range(1, 7)}
    first, stop, ids, at = words(data, off, LOWER, _NOT_SPACE)
    n_words = np.diff(at).astype(np.float64)
    w = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(n), np.diff(at))
    same = np.zeros((3, len(ids)), bool)
    for lag in (1, 2):
        same[lag, lag:] = (ids[lag:] == ids[:-lag]) & (owner[lag:] == owner[:-lag])
    breaks = np.flatnonzero(~same[1])
    runs = np.diff(np.append(breaks, len(ids)))
    longest = np.zeros(n)
    np.maximum.at(longest, owner[breaks], runs)
    pairs = ids.copy()
    pairs[1:] += ids[:-1] * np.uint64(0x9E3779B97F4A7C15)
    whole = np.zeros(len(ids), bool)
    whole[1:] = owner[1:] == owner[:-1]
    symbols = np.concatenate([[0], np.cumsum(kind == 4)])
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    smalls = np.concatenate([[0], np.cumsum(kind == 1)])
    _, _, lines, line_at = words(data, off, _AS_IS, _NOT_BREAK)
    n_lines = np.maximum(np.diff(line_at), 1).astype(np.float64)
    out = [
        np.log1p(np.diff(off)), np.log1p(n_words), np.minimum(_sums(stop - first, at) / w, 40), (count[1] + count[2] + count[6]) / size, count[2] / size, count[3] / size, count[4] / size,
        _sums(data == 46, off) / w, _sums(data == 44, off) / w, _sums(data == 124, off) / w, _sums(data == 10, off) / w, count[6] / size,
        _sums(same[1], at) / w, _sums(same[2], at) / w, np.minimum(longest, 50) / 50, _distinct(ids, owner, n) / w, _distinct(pairs[whole], owner[whole], n) / np.maximum(n_words - 1, 1),
        _sums((symbols[stop] - symbols[first]) > 0, at) / w, _sums(((capitals[stop] - capitals[first]) > 1) & (smalls[stop] == smalls[first]), at) / w,
        1 - _distinct(lines, np.repeat(np.arange(n), np.diff(line_at)), n) / n_lines,
    ]
    return np.stack(out, 1)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and stats (array of float); no shuffle. A null text counts as empty."""
    source = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(s.astype(np.float32).ravel()), s.shape[1]).cast(pa.list_(pa.float32()))], ["id", "stats"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, stats array<float>")


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.frequencies, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels) if len(self.edges) else np.full(len(stats), self.levels[0])


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    x = np.clip((stats - mean) / scale, -6, 6)
    z = np.sqrt(2 / len(phases)) * np.cos(x @ frequencies + phases)
    return np.concatenate([z, x * 0.1, np.ones((len(x), 1))], 1)


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)


def partition_sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of what `of` makes of each batch: a vector of `width` numbers for each partition, added in a tree."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table["sums"].to_pylist():
            total += np.frombuffer(x)
        return pa.table({"part": [table["part"][0].as_py() // FAN_IN], "sums": [total.tobytes()]})

    sums = written(rows.mapInArrow(part, "part long, sums binary"), "sums")
    left = sums.count()
    while left > FAN_IN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(add, "part long, sums binary")
        left = -(-left // FAN_IN)
    total = np.zeros(width)
    for row in sums.select("sums").collect():  # FAN_IN vectors at most
        total += np.frombuffer(bytes(row[0]))
    return total


def pool_adjacent(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing rates that fit best (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for p, c in zip(positives, counts, strict=True):
        blocks.append([float(p), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, c1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + c1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), p / c) for p, c, k in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, bins: int = BINS, seed: int = SEED) -> Model:
    """Fit to rows of (stats, y). Without rows all scores are 0.5; with one class they are that class's rate."""
    n_stats = len(STATISTICS)

    def moments(batch):
        s, y = _stacked(batch), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([[len(y), y.sum()], s.sum(0), (s * s).sum(0)])

    m = partition_sums(labelled, moments, 2 + 2 * n_stats)
    n = m[0]
    mean = m[2 : 2 + n_stats] / max(n, 1)
    scale = np.sqrt(np.maximum(m[2 + n_stats :] / max(n, 1) - mean**2, 1e-4))  # what hardly varies must not decide
    rng = np.random.default_rng(seed)
    frequencies, phases = rng.normal(0, 1 / width, (n_stats, features)), rng.uniform(0, 2 * np.pi, features)
    size = features + n_stats + 1
    rate = (m[1] + 0.5) / (n + 1)
    if not 0 < m[1] < n:
        return Model(mean, scale, frequencies, phases, np.zeros(size), np.zeros(0), np.array([rate]))

    def normal(batch):
        z = fourier(_stacked(batch), mean, scale, frequencies, phases)
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = partition_sums(labelled, normal, size * size + size)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    weights = np.linalg.solve(sums[: size * size].reshape(size, size) + np.diag(penalty), sums[size * size :])
    raw = Model(mean, scale, frequencies, phases, weights, np.zeros(0), np.zeros(1))

    def binned(batch):
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
        b = np.clip(((raw.raw(_stacked(batch)) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(b, y, bins), np.bincount(b, minlength=bins)])

    counts = partition_sums(labelled, binned, 2 * bins)
    own = counts[bins:] > 0
    levels = pool_adjacent(counts[:bins][own] + 1e-9, counts[bins:][own])
    return raw._replace(edges=(np.flatnonzero(own) + 0.5) / bins * 2 - 0.5, levels=np.clip(levels, 0, 1))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels must not be learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of docs: id, held_out, score (0 to 1, higher: label 1 likelier).

    Only statistics of the text enter the score. Labels of held-out ids and null labels aren't learnt; where an id has
    several labels, the largest counts. Null ids are scored and never learnt; repeated rows are scored alike.
    """
    stats = written(statistics_table(docs, id_col, text_col), "stats")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_rows(stats, labels, id_col, label_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.value.score(_stacked(batch)), pa.float64())], ["id", "score"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score")


def keep(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows of docs that score at least `least`, with their columns; each row is judged by its own text, null ids too.

    The model is fitted to the statistics of rows whose labels may be learnt; others are left out by a map of the ids
    that have labels. The texts themselves stay where they are, and each is read once more to be judged.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.xxhash64(F.col(id_col).cast("string")).alias("k")).distinct()
    bits = map_bits(known.count())
    place = lambda k: (mix(k.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(bit_map(known, lambda batch: place(batch.column("k").to_numpy()), bits))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(is_set(marks.value, place(batch.column("k").to_numpy())))).select(["id", "text"])
            if own.num_rows:
                yield own

    source = id_and_text(docs, id_col, text_col)
    some = source.select("id", "text", F.xxhash64(F.col("id").cast("string")).alias("k")).mapInArrow(marked, source.schema)
    stats = written(statistics_table(some, "id", "text"), "stats", (marks,))
    model = spark.sparkContext.broadcast(fit(labelled_rows(stats, labels, id_col, label_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            own = batch.filter(pa.array(model.value.score(statistics(batch.column(text_col))) >= least))
            if own.num_rows:
                yield own

    return docs.mapInArrow(run, docs.schema)


def labelled_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(stats, y) of the rows whose labels may be learnt."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    return written(stats.join(known, "id").select("stats", "y"), "labelled")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
