"""The edge table of a coloured de Bruijn graph: distinct k-mer, following symbol and colour, with counts and flags.

A colour is a collection; a context is what precedes a symbol; `$` follows the last symbol of a sequence. Rows are ordered
by the reversed k-mer, then symbol, then colour. No step sorts all rows in one task: what needs the order runs within
ranges of it, and what reaches over their borders is joined over one row for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.operators.order import in_ranges, numbered, starts

#: Bytes of a stretch that is cut from a long sequence at once.
STRETCH = 64
#: Places, and different contexts, that a task counts at once; what follows a sequence's last symbol.
COUNTED, _END = 1 << 18, ord("$")


def sequences(df: DataFrame, colour: str, text: str, alphabet: str = "ACGT") -> DataFrame:
    """(color, seq): upper-case texts, only symbols of the alphabet; rows without a colour go, null texts are empty."""
    kept = F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), f"[^{alphabet}]+", "")
    return df.where(F.col(colour).isNotNull()).select(F.col(colour).cast("string").alias("color"), kept.alias("seq"))


def contexts(seqs: DataFrame, k: int, wide: bool = False) -> DataFrame:
    """(color, kmer, W) for each full context. Long sequences are cut into overlapping stretches by byte first, so that
    reaching a place costs the same everywhere in a sequence; symbols must be single bytes, unless `wide` cuts by character."""
    if wide:
        own = seqs.where(F.length("seq") >= k).select("color", F.split("seq", "").alias("x"), F.length("seq").alias("n"))
        own = own.select("color", "x", "n", F.explode(F.sequence(F.lit(0), F.col("n") - k, F.lit(STRETCH))).alias("at"))
        return _within(own.select("color", F.array_join(F.slice("x", F.col("at") + 1, F.lit(STRETCH + k)), "").alias("s"), (F.col("at") + STRETCH + k > F.col("n")).alias("last")), k)
    long = seqs.where(F.octet_length("seq") >= k).select("color", F.col("seq").cast("binary").alias("b"), F.octet_length("seq").alias("n"))
    cut = long.select("color", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - k, F.lit(STRETCH))).alias("at"))
    part = cut.select("color", F.expr(f"substring(b, at + 1, {STRETCH + k})").alias("s"), (F.col("at") + STRETCH + k > F.col("n")).alias("last"))
    return _within(part, k)


def _within(part: DataFrame, k: int) -> DataFrame:
    """The contexts of stretches (color, s, last: whether the sequence ends with it)."""
    # a binary stretch is cut by byte, which needs no walk to the place
    starts = F.sequence(F.lit(1), F.least(F.length("s") - k + F.when(F.col("last"), 1).otherwise(0), F.lit(STRETCH)))
    place = part.where(F.length("s") >= k).select("color", "s", F.explode(starts).alias("p"))
    follows = F.substr("s", F.col("p") + k, F.lit(1)).cast("string")
    return place.select("color", F.substr("s", F.col("p"), F.lit(k)).cast("string").alias("kmer"), F.when(follows == "", "$").otherwise(follows).alias("W"))


def _blocks(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k symbols as a number of 8 bits each, the symbol after them) of each full context of the sequences that lie in data
    one after the other, COUNTED places at a time. `$` follows a sequence's last symbol."""
    ends, inside = off[1:], np.ones(len(data), bool)
    for back in range(1, k):
        at = ends - back
        inside[at[at >= off[:-1]]] = False
    final = np.zeros(len(data), bool)
    final[(ends - k)[ends - off[:-1] >= k]] = True
    for a in range(0, len(data), COUNTED):
        here = a + np.flatnonzero(inside[a : a + COUNTED])
        if not len(here):
            continue
        code = np.zeros(len(here), np.uint64)
        for i in range(k):
            code = code << np.uint64(8) | data[here + i]
        yield code, np.where(final[here], np.uint8(_END), data[np.minimum(here + k, len(data) - 1)])


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first)


def counted_windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(color, kmer, W, n): how often each full context of the batches' sequences (color, seq) occurs, k <= 8; one row for
    each while a task's different ones are fewer than COUNTED, else several that add up."""
    held: dict[tuple, list[list[np.ndarray]]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (color, w), (codes, counts) in held.items():
            code, n = codes[0], counts[0]
            raw = np.ascontiguousarray(code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - k :])
            at = np.arange(len(code) + 1, dtype=np.int32) * np.int32(k)
            kmer = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(at), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.repeat(color, len(code)), kmer, pa.repeat(pa.scalar(chr(w)), len(code)), pa.array(n)], ["color", "kmer", "W", "n"])

    def merge() -> int:
        for pair in held.values():
            if len(pair[0]) > 1:
                pair[:] = [[x] for x in _merged(*pair)]
        return sum(len(codes[0]) for codes, _ in held.values())

    for batch in batches:
        if not batch.num_rows:
            continue
        colours = batch.column("color").dictionary_encode("encode")
        own = colours.indices.to_numpy()
        for c, color in enumerate(colours.dictionary):
            seq = batch.column("seq").filter(pa.array(own == c)).cast(pa.large_binary())
            _, offsets, raw = seq.buffers()
            off = np.frombuffer(offsets, np.int64)[seq.offset : seq.offset + len(seq) + 1]
            data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
            for code, follows in _blocks(data, off - off[0], k):
                for w in np.flatnonzero(np.bincount(follows, minlength=256)).tolist():
                    found, n = np.unique(code[follows == w], return_counts=True)
                    pair = held.setdefault((color, w), [[], []])
                    pair[0].append(found)
                    pair[1].append(n.astype(np.int64))
                    size += len(found)
                if size >= 4 * COUNTED:
                    size = merge()
                    if size >= COUNTED:
                        yield from rows()
                        held, size = {}, 0
    merge()
    yield from rows()


def edges(seqs: DataFrame, k: int, wide: bool = False) -> DataFrame:
    """(color, kmer, W, coverage): distinct edges with how often each occurs; partial counts before the shuffle. Contexts of
    up to 8 bytes are counted as numbers, so no row is made of an occurrence."""
    if wide or not 1 <= k <= 8:
        return contexts(seqs, k, wide).groupBy("color", "kmer", "W").agg(F.count("*").alias("coverage"))
    whole = seqs.where(F.octet_length("seq") >= k).select("color", "seq")
    parts = whole.mapInArrow(lambda batches: counted_windows(batches, k), f"color {whole.schema['color'].dataType.simpleString()}, kmer string, W string, n long")
    return parts.groupBy("color", "kmer", "W").agg(F.sum("n").alias("coverage"))


def contexts_with_short(seqs: DataFrame, k: int) -> DataFrame:
    """(color, context, W, coverage) for every prefix of a sequence, cut to its last k symbols: short ones as well."""
    ends = seqs.select("color", "seq", F.explode(F.sequence(F.lit(0), F.length("seq"))).alias("e"))
    start = F.greatest(F.col("e") - k, F.lit(0))
    rows = ends.select("color", F.substr("seq", start + 1, F.col("e") - start).alias("context"), F.coalesce(F.nullif(F.substr("seq", F.col("e") + 1, F.lit(1)), F.lit("")), F.lit("$")).alias("W"))
    return rows.groupBy("color", "context", "W").agg(F.count("*").alias("coverage"))


def colour_totals(e: DataFrame) -> DataFrame:
    """Edges and their occurrences of each colour."""
    return e.groupBy("color").agg(F.count("*").alias("n_edges"), F.sum("coverage").alias("n_cov"))


def report(e: DataFrame) -> DataFrame:
    """(color, n_edges, n_cov) of each colour, and of all together under a null colour."""
    return e.rollup("color").agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("coverage"), F.lit(0).cast("long")).alias("n_cov"))


def symbol_counts(e: DataFrame) -> DataFrame:
    """(W, n, before): edges with a symbol, and with a smaller one. One row for each symbol enters the window."""
    n = e.groupBy("W").agg(F.count("*").alias("n"))
    return n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("W").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Length of the common prefix, up to `most`; 0 where either is null."""
    same = [F.when(F.substring(a, 1, i) == F.substring(b, 1, i), 1).otherwise(0) for i in range(1, most + 1)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return F.coalesce(F.least(total, F.length(a), F.length(b)), F.lit(0))


#: Rows whose flags a task works out at once, whole ranges of the first k - 1 symbols.
_BLOCK = 1 << 16


def _marked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Adds last, wm and lcp to sorted rows (r, W, ..). The lcp of a task's first row, whose neighbour another task has, is
    null. A symbol is one 32-bit code, so contexts compare as rows of numbers."""
    held: list[pa.RecordBatch] = []
    before: np.ndarray | None = None

    def made(table: pa.Table) -> pa.RecordBatch:
        nonlocal before
        n = table.num_rows
        codes = np.array(table["r"].to_pylist(), f"<U{k}").view(np.uint32).reshape(n, k)
        near = np.concatenate([np.zeros((1, k), np.uint32) if before is None else before[None], codes[:-1]])
        common = np.cumprod((codes == near) & (codes != 0), axis=1).sum(1)
        size = (codes != 0).sum(1)
        new = (codes != near).any(1)
        stem = np.cumsum((codes[:, : k - 1] != near[:, : k - 1]).any(1)) if k > 1 else np.zeros(n, np.int64)
        _, symbol = np.unique(np.array(table["W"].to_pylist()), return_inverse=True)
        again = np.append(False, symbol[1:] == symbol[:-1])
        lcp = np.where(new, common, np.where(size < k, size, k + again))
        new[0] = True
        first = np.zeros(n, np.int32)
        first[np.unique(stem * (int(symbol.max()) + 1) + symbol, return_index=True)[1]] = 1
        out = dict(zip(table.schema.names, table.combine_chunks().to_batches()[0].columns, strict=True))
        unknown = np.zeros(n, bool)
        unknown[0] = before is None
        before = codes[-1]
        out |= {"last": pa.array(np.append(new[1:], True).astype(np.int32)), "wm": pa.array(first), "lcp": pa.array(lcp.astype(np.int32), mask=unknown)}
        return pa.RecordBatch.from_arrays([*out.values()], [*out])

    def stems(batch: pa.RecordBatch) -> list[str]:
        return [x[: k - 1] for x in batch.column("r").to_pylist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= _BLOCK:
            own = stems(batch)
            cut = next((i for i in range(len(own) - 1, 0, -1) if own[i] != own[i - 1]), 0)
            if cut:  # the last stem's rows may go on in the next batch
                yield made(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
    if held:
        yield made(pa.Table.from_batches(held))


def ordered(rows: DataFrame, k: int) -> DataFrame:
    """The whole edge table of distinct edges (color, context, W, coverage), contexts of fewer than k symbols among them:
    adds pos, last, wm, lcp and sl.

    Rows are ordered by the reversed context (a shorter one before those that begin with it), then symbol, then colour.
    last: the final edge of its context. wm: the first edge with its symbol among contexts that share their last k - 1
    symbols. lcp: what a context has in common with the one before; for further edges of a context k, or k + 1 after an edge
    with the same symbol, or its own length where that is below k. sl: the context's length and one.
    """
    r = F.reverse("context")
    dealt = in_ranges(rows.select("color", "context", "W", "coverage", r.alias("r"), F.substring(r, 1, k - 1).alias("stem")), ["stem"], ["r", "W", "color"]).drop("stem")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", last int, wm int, lcp int"
    table = numbered(dealt.mapInArrow(lambda batches: _marked(batches, k), schema), "edges")
    ends = starts(table, None, F.max_by("r", "at").alias("top"))
    ends = ends.withColumn("near", F.lag("top").over(Window.orderBy("part"))).drop("top")  # one row for each task
    lcp = F.coalesce("lcp", common_prefix(F.col("r"), F.col("near"), k)).cast("int")
    return table.join(F.broadcast(ends), "part").select((F.col("before") + F.col("at")).alias("pos"), "context", "W", "color", "coverage", "last", "wm", lcp.alias("lcp"), (F.length("context") + 1).alias("sl"))


def flags(e: DataFrame, k: int) -> DataFrame:
    """Full edges (color, kmer, W, coverage) with last, wm and lcp; see ordered()."""
    return ordered(e.withColumnRenamed("kmer", "context"), k).select("color", F.col("context").alias("kmer"), "W", "coverage", "last", "wm", "lcp")
