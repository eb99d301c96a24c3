"""Suffix-array deduplication: every byte covered by a string of 400 bytes that also starts elsewhere is removed.

1. Each start of such a string is owned by an anchor within it, the place of its least hash of 64 bytes, and by how far
   back from the anchor it lies. Starts that follow each other with one owner form a piece; equal strings lie in pieces
   with the same key, the hash of the 232 bytes that all strings of a piece share.
2. Pieces whose key occurs once go. Of the others, the strings from first start to last end (contexts) are counted;
   equal ones are one context with a weight.
3. Contexts are dealt to shards by key. What no other context of a shard can match, since none has the 385 bytes that 16
   starts share, is left out of it. A shard is a text whose suffixes are sorted by external induced sorting (`induced`);
   neighbours with 400 bytes in common are the repeated strings. A weight above 1 repeats all of a context.
4. Repeated starts go back to the texts by context, and each text is cut once.
No step holds more than one shard or one text, and matches never cross texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm import induced
from seqweft.llm._arrow import bit_map, id_and_text, is_set, map_bits, mix, powers, slices, utf8, written

#: Bytes of a repeated string, of an anchor's hash, of starts that share a key, of those that share a key within a shard;
#: bytes of contexts in a shard.
LENGTH, ANCHOR, SPREAD, STEP, SHARD_BYTES = 400, 64, 169, 16, 4 << 20
_SECOND = 0xD1B54A32D192ED03


def pieces(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Pieces of all texts: doc, s (first start in the text), n (starts), h (key), c1 and c2 (hash of the context), back
    (how far the first start lies before the anchor).

    In periodic text the same context follows itself at every period: such pieces are one row, with m, the starts of all
    of them (n for a piece alone).
    """
    n, reach = len(data), length - ANCHOR + 1
    names = ("doc", "s", "n", "m", "h", "c1", "c2", "at", "back")
    starts = np.diff(off) - length + 1
    if n < length or not (starts > 0).any():
        return {k: np.zeros(0, np.int64) for k in names}
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n + 1 - ANCHOR])
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    own = np.maximum(starts, 0)
    s = np.arange(int(own.sum())) + np.repeat(off[:-1] - (np.cumsum(own) - own), own)
    doc = np.repeat(np.arange(len(own)), own)
    anchor = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    part = (anchor - s) // SPREAD
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    a, j, at, d = anchor[first], part[first], s[first], doc[first]
    left, right = a - j * SPREAD, a - (j + 1) * SPREAD + 1 + length
    key = mix(mix((total[right] - total[left]) * down[left]) + j.astype(np.uint64) * np.uint64(_SECOND))
    up2, down2 = powers(n + 1, _SECOND)
    total2 = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * up2[:n], out=total2[1:])
    end = at + count + length - 1
    size = count.astype(np.uint64)
    c1, c2 = mix((total[end] - total[at]) * down[at] + size), mix((total2[end] - total2[at]) * down2[at] ^ size)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (at[1:] != at[:-1] + count[:-1])
    f = np.flatnonzero(fresh)
    whole = np.add.reduceat(count, f)
    return {"doc": d[f], "s": at[f] - off[d[f]], "n": count[f], "m": whole, "h": key[f].view(np.int64), "c1": c1[f].view(np.int64), "c2": c2[f].view(np.int64), "at": at[f], "back": (a - at)[f]}


def _place(k1: np.ndarray, k2: np.ndarray, s: np.ndarray, bits: int) -> np.ndarray:
    """Bit of an occurrence in the map of those whose contexts are fetched."""
    with np.errstate(over="ignore"):
        h = mix(mix(k1.view(np.uint64)) + k2.view(np.uint64) * np.uint64(3) + s.astype(np.uint64) * np.uint64(_SECOND))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _marked(rows: DataFrame, bits: int) -> np.ndarray:
    """A packed map with the bits of all (k1, k2, s)."""
    return bit_map(rows, lambda batch: _place(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "s")), bits), bits)


def _shared_keys(data: np.ndarray, off: np.ndarray, back: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts: for every STEP starts by their distance from the anchor the hash of the bytes that their strings share,
    the context, and first and past-last start."""
    count = np.maximum(np.diff(off) - length + 1, 0)
    nearest = (back - count + 1) // STEP  # the last start's block
    many = np.where(count > 0, back // STEP - nearest + 1, 0)
    own = np.repeat(np.arange(len(count)), many)
    block = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + nearest[own]
    left, right = back[own] - block * STEP, back[own] - (block + 1) * STEP + 1 + length
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    left, right = left + off[own], right + off[own]
    key = mix(mix((total[right] - total[left]) * down[left]) + block.astype(np.uint64) * np.uint64(_SECOND))
    first = np.maximum(0, back[own] - (block + 1) * STEP + 1)
    return key, own, first, np.minimum(count[own], back[own] - block * STEP + 1)


def _matched(keys: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last start of each context between which some key occurs again; first is past last where none does."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    low, high = np.full(contexts, 1 << 40), np.zeros(contexts, np.int64)
    np.minimum.at(low, own[again], first[again])
    np.maximum.at(high, own[again], last[again])
    return low, high


def repeated_starts(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """One shard: (c1, c2, runs), runs being the flat (first, past-last) starts of a context that occur elsewhere in it."""
    whole, file = tempfile.TemporaryFile(), tempfile.TemporaryFile()
    begin, c1, c2, found, rows = [np.zeros(1, np.int64)], [], [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = utf8(batch.column("context"))
        whole.write(data.tobytes())
        begin.append(off[1:] + begin[-1][-1])
        key, own, first, last = _shared_keys(data, off, batch.column("back").to_numpy().astype(np.int64), length)
        found.append((key, own + rows, first, last))
        rows += batch.num_rows
        c1.append(batch.column("c1").to_numpy())
        c2.append(batch.column("c2").to_numpy())
    if not rows:
        return
    low, high = _matched(*(np.concatenate(x) for x in zip(*found, strict=True)), rows)
    del found
    kept = np.flatnonzero(low < high)
    if not len(kept):
        return
    whole.flush()
    begin = np.concatenate(begin)
    stored = np.memmap(whole, np.uint8, "r")
    at = [0]
    for a, b in zip((begin[kept] + low[kept]).tolist(), (begin[kept] + high[kept] + length - 1).tolist(), strict=True):
        part = np.append(stored[a:b].astype(np.uint16) + np.uint16(2), np.uint16(1))
        file.write(part.tobytes())
        at.append(at[-1] + len(part))
    file.write(np.zeros(1, np.uint16).tobytes())
    file.flush()
    text = np.asarray(np.memmap(file, np.uint16, "r", shape=(at[-1] + 1,)))
    order, common = induced.suffixes(text, length)
    again = induced.mapped(len(text), bool)
    for a in range(1, len(text), induced.BLOCK * 16):
        b = min(a + induced.BLOCK * 16, len(text))
        same = np.flatnonzero(common[a:b] >= length) + a
        again[order[same]] = True
        again[order[same - 1]] = True
    k1, k2, skipped = np.concatenate(c1)[kept], np.concatenate(c2)[kept], low[kept]
    out, own = [], []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        hit = again[a : max(a, b - length)]
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            own.append(i)
            out.append((edge + skipped[i]).astype(np.int32))
        if len(own) >= 10_000 or own and i == len(k1) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(out, pa.list_(pa.int32()))], ["c1", "c2", "runs"])
            out, own = [], []
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(out, pa.list_(pa.int32()))], ["c1", "c2", "runs"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id, n_bytes, removed (flat first and past-last bytes of maximal runs), kept (binary, what is left).

    A null text is empty; texts shorter than 400 bytes lose nothing. Rows that repeat a text repeat all its strings.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    keyed = source.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", F.lit(1), "id")})
    columns = ("s", "n", "m", "h", "c1", "c2")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = pieces(*utf8(batch.column("text")))
            keys = [pa.array(batch.column(k).to_numpy()[p["doc"]]) for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(p[c].astype(np.int32) if c in "snm" else p[c]) for c in columns)], ["k1", "k2", *columns])

    found = keyed.select("k1", "k2", "text").mapInArrow(split, "k1 long, k2 long, s int, n int, m int, h long, c1 long, c2 long")
    every = Window.partitionBy("h")
    found = written(found.withColumn("many", F.sum((F.col("m") / F.col("n")).cast("long")).over(every)).where("many > 1").drop("many"), "pieces")
    contexts = found.groupBy("h", "c1", "c2").agg(F.sum((F.col("m") / F.col("n")).cast("long")).alias("weight"), F.first("n").alias("n"), F.min(F.struct("k1", "k2", "s")).alias("one"))
    contexts = written(contexts, "contexts")
    # a context that is alone under its key has no other to be compared with: its weight says all
    rivals = contexts.join(contexts.groupBy("h").count().where("count > 1").select("h"), "h", "left_semi")
    rivals = written(rivals.select("n", "one"), "rivals")
    number, size = rivals.agg(F.count("*"), F.coalesce(F.sum(F.col("n") + LENGTH), F.lit(0))).first()
    bits = map_bits(number)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    marks = spark.sparkContext.broadcast(_marked(rivals.select("one.*"), bits))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = marks.value
        for batch in slices(batches):
            data, off = utf8(batch.column("text"))
            p = pieces(data, off)
            k1, k2 = (batch.column(k).to_numpy()[p["doc"]] for k in ("k1", "k2"))
            own = np.flatnonzero(is_set(wanted, _place(k1, k2, p["s"], bits))) if len(k1) else np.zeros(0, np.int64)
            raw = data.tobytes()
            cut = [raw[a : a + n + LENGTH - 1] for a, n in zip(p["at"][own].tolist(), p["n"][own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(p["h"][own]), pa.array(p["c1"][own]), pa.array(p["c2"][own]), pa.array(p["back"][own].astype(np.int32)), pa.array(cut, pa.binary())], ["h", "c1", "c2", "back", "context"])

    dealt = keyed.select("k1", "k2", "text").mapInArrow(fetch, "h long, c1 long, c2 long, back int, context binary").repartition(shards, "h").select("c1", "c2", "back", "context")
    sorted_ = dealt.mapInArrow(repeated_starts, "c1 long, c2 long, runs array<int>")
    runs = contexts.where("weight > 1").select("c1", "c2", F.array(F.lit(0), F.col("n")).alias("runs")).union(sorted_).groupBy("c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    runs = written(runs, "runs")
    spans = found.select("k1", "k2", "s", "n", "m", "c1", "c2").join(runs, ["c1", "c2"])
    # a run of starts removes up to the end of its last string; what repeats itself is removed from first to last
    one = F.transform("runs", lambda x, i: F.col("s") + x + F.when(i % 2 == 1, LENGTH - 1).otherwise(0))
    spans = spans.select("k1", "k2", F.when(F.col("m") > F.col("n"), F.array(F.col("s"), F.col("s") + F.col("m") + (LENGTH - 1))).otherwise(one).alias("spans"))
    spans = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = utf8(batch.column("text"))
            kept, removed = [], []
            raw = data.tobytes()
            column = batch.column("spans")
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                flat = values[at[i] : at[i + 1]] if column[i].is_valid else ()
                if not len(flat):
                    kept.append(raw[off[i] : off[i + 1]])
                    removed.append([])
                    continue
                text = data[off[i] : off[i + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, flat[::2], 1)
                np.add.at(edge, flat[1::2], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(text[~gone].tobytes())
                removed.append(np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())], [id_col, "n_bytes", "removed", "kept"])

    return keyed.join(spans, ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, removed array<long>, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    made = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return made.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract start by start, for tests on small tables."""
    import hashlib
    from collections import Counter

    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
