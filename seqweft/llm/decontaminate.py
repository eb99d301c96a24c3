"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 13 consecutive words of the benchmark's items. A shift table over blocks of two words
tells how far a search may move on; where it says 0, the bucket of the last block's hash gives the patterns to test,
and a direct comparison, word by word and then byte by byte, confirms each occurrence. Searches of many stretches of
text move on together as numpy arrays. Nothing is shuffled: the patterns go to the tasks in blocks of bounded size, as the
items' texts, and a worker compiles each block once; a pattern is a place in the block's words, not a copy of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm._arrow import LOWER, id_and_text, mix, slices, small_batches, utf8, words, written

WINDOW = 13
#: Bytes of item texts in one block of patterns; larger benchmarks take one pass for each block.
BLOCK_BYTES = 8 << 20
#: Bits of the tables, as a power of two that grows with the windows, within these bounds.
_LEAST_BITS, _MOST_BITS = 16, 24
#: Words a search covers before the next one takes over.
_STRETCH = 512

_INSIDE = np.ones(256, bool)
_INSIDE[0x00:0x30] = _INSIDE[0x3A:0x61] = _INSIDE[0x7B:0x80] = False
_INSIDE[0x41:0x5B] = True  # upper case, folded below


class Items(NamedTuple):
    """The words of a block of items, one after the other: hashes, where each begins and ends in the folded bytes; and the
    items' ids."""

    ids: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    low: bytes
    names: list[str]


class Patterns(NamedTuple):
    """The different windows of one length: the word of the block that each begins with, the items that have it (numbers
    owner[owner_start[k] : owner_start[k + 1]]), and the tables."""

    length: int
    begin: np.ndarray
    owner: np.ndarray
    owner_start: np.ndarray
    bits: int
    shift: np.ndarray
    bucket_of: np.ndarray
    bucket_start: np.ndarray
    bucket: np.ndarray


def _block_hash(ids: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Hash of the block that ends at each word, as a place in the tables."""
    h = ids.copy()
    if length > 1:
        h[1:] = mix(ids[1:] + ids[:-1] * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return words(data, off, LOWER, _INSIDE)


def _windows(words_: Items, begin: np.ndarray, owner: np.ndarray, length: int) -> Patterns:
    """Tables for the windows of `length` words that begin at the words `begin` of the items `owner`."""
    h = np.zeros(len(begin), np.uint64)
    for j in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words_.ids[begin + j]
    order = np.lexsort((owner, h))
    begin, owner = begin[order].astype(np.int32), owner[order].astype(np.int32)
    same = np.append(False, h[order[1:]] == h[order[:-1]])
    del h, order
    for j in range(length):  # equal in all words, not in the sum alone
        at = np.flatnonzero(same)
        same[at] = words_.ids[begin[at] + j] == words_.ids[begin[at - 1] + j]
    new = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    first = np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1]))  # an item once
    begin, owner, start = begin[new], owner[first], np.searchsorted(group[first], np.arange(len(new) + 1))
    size = 2 if length > 1 else 1
    bits = min(_MOST_BITS, max(_LEAST_BITS, (len(begin) * length).bit_length() + 2))
    shift = np.full(1 << bits, length - size + 1, np.uint8)
    place = _block_hash(words_.ids, length, bits)
    for j in range(size - 1, length):
        np.minimum.at(shift, place[begin + j], np.uint8(length - 1 - j))
    last = place[begin + length - 1]
    by_last = np.argsort(last, kind="stable").astype(np.int32)
    bucket_of, bucket_start = np.unique(last[by_last], return_index=True)
    return Patterns(length, begin, owner, start, bits, shift, bucket_of, np.append(bucket_start, len(by_last)), by_last)


def compile_patterns(items: list[tuple[str, str]]) -> tuple[Items, list[Patterns]]:
    """The words of (item id, text) pairs, and tables for their windows, one set for each length that occurs."""
    parts: list[tuple[np.ndarray, ...]] = []
    low = bytearray()
    for batch in slices(iter([pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], ["text"])])):
        data, off = utf8(batch.column("text"))
        first, stop, ids, at = split_words(data, off)
        parts.append((ids, (first + len(low)).astype(np.int32), (stop + len(low)).astype(np.int32), np.diff(at)))
        low += LOWER[data].tobytes()
    ids, first, stop, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    own, at = Items(ids, first, stop, bytes(low), [k for k, _ in items]), np.cumsum(n) - n
    out = []
    for length in np.unique(np.minimum(n[n > 0], WINDOW)).tolist():
        which = np.flatnonzero(np.minimum(n, WINDOW) == length)
        many = n[which] - length + 1
        begin = np.repeat(at[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out.append(_windows(own, begin, np.repeat(which, many), length))
    return own, out


#: The block that a worker has compiled last, under its name.
_COMPILED: dict[str, tuple[Items, list[Patterns]]] = {}


def _compiled(name: str, items: list[tuple[str, str]]) -> tuple[Items, list[Patterns]]:
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = compile_patterns(items)
    return _COMPILED[name]


def _search(p: Patterns, words_: Items, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last words of windows that agree with a pattern in all word hashes, and the patterns."""
    n = len(ids)
    if n < p.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    block = _block_hash(ids, p.length, p.bits)
    move = p.shift[block]
    pos = np.arange(p.length - 1, n, _STRETCH)
    end = np.minimum(pos + _STRETCH, n)
    stops = []
    while len(pos):
        step = move[pos]
        stops.append(pos[step == 0])
        pos = pos + np.maximum(step, 1)
        on = pos < end
        pos, end = pos[on], end[on]
    at = np.concatenate(stops)
    b = np.searchsorted(p.bucket_of, block[at])
    counts = p.bucket_start[b + 1] - p.bucket_start[b]
    place = np.repeat(at, counts)
    inner = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
    which = p.bucket[np.repeat(p.bucket_start[b], counts) + inner]
    for j in range(p.length):
        same = words_.ids[p.begin[which] + j] == ids[place - p.length + 1 + j]
        place, which = place[same], which[same]
    return place, which


def _scan(batches: Iterator[pa.RecordBatch], compiled: tuple[Items, list[Patterns]], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[tuple[int, int]]], list[set[str]]]]:
    own, patterns = compiled
    for batch in slices(batches, column):
        data, off = utf8(batch.column(column))
        first, stop, ids, at = split_words(data, off)
        low = LOWER[data].tobytes()
        hits: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
        items: list[set[str]] = [set() for _ in range(batch.num_rows)]
        for p in patterns:
            place, which = _search(p, own, ids)
            doc = np.searchsorted(at, place, "right") - 1
            whole = place - p.length + 1 >= at[doc]
            for d, last, k in zip(doc[whole].tolist(), place[whole].tolist(), which[whole].tolist(), strict=True):
                begin, b = last - p.length + 1, int(p.begin[k])
                if all(low[first[begin + j] : stop[begin + j]] == own.low[own.first[b + j] : own.stop[b + j]] for j in range(p.length)):
                    hits[d].append((begin - int(at[d]), last + 1 - int(at[d])))
                    items[d].update(own.names[i] for i in p.owner[p.owner_start[k] : p.owner_start[k + 1]].tolist())
        yield batch, np.diff(at), hits, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, of which the driver holds one at a time; at least one, which may be empty."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    held: list[tuple[str, str]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    yield held


#: Names of the columns that a search adds; nothing in a table is called so.
_HITS, _ITEMS, _WORDS, _TEXT = "_seqweft_hits", "_seqweft_items", "_seqweft_words", "_seqweft_text"


def searched(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """docs with the words of each text, its hit stretches and items: one pass for each block of the benchmark, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    none = {_TEXT: F.coalesce(F.col(text_col).cast("string"), F.lit("")), _WORDS: F.lit(0).cast("long"), _HITS: F.array().cast("array<int>"), _ITEMS: F.array().cast("array<string>")}
    state = docs.withColumns(none)
    schema = state.schema
    shared = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if shared is not None:  # what the block before found is written, and its patterns leave all memory
            state = written(state, "searched", (shared,))
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def one_pass(batches, shared=shared):
            for batch, n, hits, items in _scan(batches, _compiled(*shared.value), _TEXT):
                flat, own = [], []
                for old, new, before, now in zip(batch.column(_HITS).to_pylist(), hits, batch.column(_ITEMS).to_pylist(), items, strict=True):
                    runs: list[int] = []
                    for a, b in sorted([*zip(old[::2], old[1::2], strict=True), *new]):
                        if runs and a <= runs[-1]:
                            runs[-1] = max(b, runs[-1])
                        else:
                            runs += [a, b]
                    flat.append(runs)
                    own.append(sorted(now.union(before)))
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols |= {_WORDS: pa.array(n, pa.int64()), _HITS: pa.array(flat, pa.list_(pa.int32())), _ITEMS: pa.array(own, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

        state = state.mapInArrow(one_pass, schema)
    return state.drop(_TEXT)


def _n_hit():
    return F.aggregate(F.transform(_HITS, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, items (sorted list), spans (hit stretches of words, as first and past-last).

    A null or empty text has no words and is hit by nothing; rows with equal ids are judged one by one. Items with a null
    id or text, or without words, have no windows. Other columns are left out, whatever their names.
    """
    found = searched(id_and_text(docs, id_col, text_col), benchmark, "text", item_col, item_text_col, block_bytes)
    return found.select(F.col("id").alias(id_col), F.col(_WORDS).alias("n_words"), _n_hit().alias("n_hit"), F.col(_ITEMS).alias("items"), F.col(_HITS).alias("spans"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def keep(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that aren't contaminated, with their columns. Each row is judged by its own text, whatever rows share
    its id, null ones too; texts stay where they are."""
    found = searched(docs, benchmark, text_col, "item_id", "text", BLOCK_BYTES).withColumn(_ITEMS, _n_hit())
    return found.where(~contaminated(_ITEMS, _WORDS)).select(docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract word by word, for tests on small tables."""
    import re

    def split(t):
        t = (t or "").translate({i: i + 32 for i in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    windows: dict[tuple[str, ...], set[str]] = {}
    for k, t in items:
        w = split(t)
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
