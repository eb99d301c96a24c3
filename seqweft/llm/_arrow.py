"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as numpy arrays at once (one text may exceed it), and of a batch between Spark and Python.
CHUNK_BYTES, BATCH_BYTES = 1 << 19, 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Long texts make batches of many rows large on both sides; where the session bounds their bytes less tightly than
    BATCH_BYTES, it does so from now on. Results don't depend on it."""
    now = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # with another unit it is larger
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under names that nothing can clash with."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory to the system: several workers, which Spark uses again, share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches so that each piece has about `most` bytes of text, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
        del batch
        give_back()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins; the last entry is where the last ends. Null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def strings(array: pa.Array) -> list[str]:
    """Python strings; null counts as empty, bytes that aren't UTF-8 are replaced."""
    try:
        return [x or "" for x in array.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in array.cast(pa.binary()).to_pylist()]


#: An odd number has an inverse modulo 2**64, so a sum of byte * BASE**place can be moved to place 0.
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            out.append(np.multiply.accumulate(p))
        known = _POWERS[base] = (out[0], out[1])
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, off: np.ndarray, fold: np.ndarray, inside: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which `inside` holds, cut at the borders of the texts.

    Returns where each begins, where it ends, its 64-bit hash over the folded bytes, and how many begin before each text.
    """
    n = len(data)
    mask = inside[data]
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    edge = off[:-1][off[:-1] < n]
    begin[edge] = mask[edge]
    last = off[1:][off[1:] > 0] - 1
    end[last] = mask[last]
    first, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1, base)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64))
    return first, stop, hashes, np.searchsorted(first, off)


#: Parts in which arrays of fixed size travel, and partial ones that are combined in one task.
PARTS, FAN_IN = 64, 16


def combined(rows: DataFrame, partial, join, kind: type, parts: int = PARTS) -> np.ndarray:
    """An array of fixed size that each task makes part of: partial(batches) gives one array of `kind` for a partition,
    join(list of arrays) combines them. (A task may count in a smaller kind.) They travel in so many parts and are combined FAN_IN at a time, however many."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = [zlib.compress(x.astype(kind, copy=False).tobytes(), 1) for x in partial(batches).reshape(parts, -1)]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * parts, pa.int64()), pa.array(range(parts), pa.int32()), pa.array(pieces, pa.binary())], ["task", "part", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = join([np.frombuffer(zlib.decompress(x), kind) for x in table["data"].to_pylist()]).astype(kind, copy=False)
        return pa.table({"task": [table["task"][0].as_py() // FAN_IN], "part": pa.array([table["part"][0].as_py()], pa.int32()), "data": [zlib.compress(total.tobytes(), 1)]})

    made, left = rows.mapInArrow(make, "task long, part int, data binary"), rows.rdd.getNumPartitions()
    while left > 1:
        made = made.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(add, "task long, part int, data binary")
        left = -(-left // FAN_IN)
    rows_ = sorted(made.select("part", "data").collect(), key=lambda r: r["part"])
    return np.concatenate([np.frombuffer(zlib.decompress(bytes(r["data"])), kind) for r in rows_]) if rows_ else partial(iter(()))


def map_bits(entries: int, most: int = 24) -> int:
    """Bits of a map, as a power of two, that so many entries fill to a sixty-fourth; 2**most at most."""
    return min(most, max(16, (64 * max(1, entries) - 1).bit_length()))


def bit_map(rows: DataFrame, place, bits: int = 24) -> np.ndarray:
    """A packed map of 2**bits bits of which place(batch) are set for each batch of rows; see is_set."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << bits, bool)
        for batch in batches:
            if batch.num_rows:
                total[place(batch)] = True
        return np.packbits(total)

    return combined(rows, partial, np.bitwise_or.reduce, np.uint8, max(1, PARTS >> max(0, 24 - bits)))


def is_set(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places of a bit map are set; the map stays packed."""
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & np.uint8(1) > 0


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all executors share; where the session names none (tests), one is set."""
    return f"{_shared(spark).rstrip('/')}/seqweft-{uuid.uuid4().hex}"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a shared folder, and the folder's path in it, for files that tasks write themselves."""
    return fs.FileSystem.from_uri(folder)


def _shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str = "part", used: tuple = ()) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    used: broadcast values that nothing needs once the table is written; they leave the executors' memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{name}"
    schema = df.schema
    df.write.parquet(path)
    del df
    for value in used:
        value.destroy()
    release(spark)
    return spark.read.schema(schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a written table that nothing needs any more. Where its folder can't be reached from here, it stays."""
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("seqweft-"):
            raise ValueError(f"{folder} is no table of these operators")
        try:
            system, path = opened(folder)
            system.delete_dir(path)
        except (OSError, ValueError, pa.ArrowException):
            pass


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver's objects for them are
    collected, which a driver with free memory puts off while the files fill the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ready_checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the session's own, or on a local master a temporary one where none is set."""
    where = _shared(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)


def look_up(left: DataFrame, right: DataFrame, key: str, hot_parts: int = 512) -> DataFrame:
    """Left join of a table whose key may be hot with one that has each key once.

    Keys that hold at least 1/hot_parts of the rows number hot_parts at most, so their rows of the right side have a
    proven bound and are broadcast; the rest is joined by shuffle. Rows with a null key get nulls.
    """
    total = left.count()
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= max(1000, total // hot_parts + 1))
    hot = written(right.join(F.broadcast(counts.select(key)), key, "left_semi"), "hot")
    if hot.isEmpty():
        return left.join(right, key, "left")
    marked = left.join(F.broadcast(hot.select(key).withColumn("is_hot", F.lit(True))), key, "left")
    out = [c for c in left.columns] + [c for c in right.columns if c != key]
    a = marked.where("is_hot").drop("is_hot").join(F.broadcast(hot), key, "left").select(out)
    b = marked.where("is_hot is null").drop("is_hot").join(right, key, "left").select(out)
    return a.unionByName(b)
