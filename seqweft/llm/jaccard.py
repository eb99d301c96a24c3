"""N-gram Jaccard self-join: documents whose sets of five-word shingles reach a similarity of 0.8, and their components.

1. Equal sets collapse into one class first, so copies never meet as pairs.
2. Shingles are ordered by how often they occur (levels of a counting sketch over all documents), then by hash; a set is
   indexed under its prefix alone, the fewest first shingles of which similar sets must share one.
3. Lists of the same sets are one list. Index lists are skipped by position: within a list, sets lie in blocks by size, only blocks of sizes that can reach
   the similarity meet, and a pair goes on only if what lies behind its positions can still make up the overlap.
4. A set takes over the answers of a set that it is found highly similar to. In the first round a set meets its neighbours
   in its lists, in the next ones all sets of its lists with other answers, and it is compared with the one that its parity
   is least apart from: one comparison a set, however many it meets.
   Linked sets share one answer (their component) and don't meet again, so that large groups of near copies become one
   component while only a few pairs a set were compared. The last round is complete: lists are dealt out by pairs of
   blocks, all sets of a list that still have different answers meet there, and only pairs that sizes, positions and short
   parities allow become rows. No link between components is lost.
All verification counts the exact intersection of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm._arrow import LOWER, bit_map, combined, forget, id_and_text, is_set, look_up, map_bits, mix, ready_checkpoints, slices, utf8, words, written

#: Words of a shingle, least similarity as a fraction, counters of the sketch as a power of two, rounds before the last at most
#: (they end once one finds less than a tenth of all links so far).
SHINGLE, PART, OF, SKETCH_BITS, ROUNDS = 5, 80, 100, 23, 8
#: Least bits of the parities that bound how far two sets differ, 64-bit numbers of the short ones that lists carry in the
#: last round, sets of a list in one block, pairs that are looked at at once.
PARITY_BITS, SHORT, LIST_BLOCK, AT_ONCE = 1024, 8, 1024, 1 << 18
#: Nodes (numbers of 8 bytes) that are broadcast at most.
FEW_NODES = 1 << 17

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 9, 10, 11, 12, 13]] = False


def shingle_sets(array: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, by text and then value, and where each text's begin."""
    data, off = utf8(array)
    _, _, ids, at = words(data, off, LOWER, _INSIDE)
    n = np.diff(at)
    made, owner = [], []
    if len(ids) >= size:
        h = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k]
        begin = np.arange(len(h))
        doc = np.searchsorted(at, begin, "right") - 1
        whole = begin + size <= at[doc + 1]
        made.append(mix(h[whole]))
        owner.append(doc[whole])
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        h = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for x in ids[at[d] : at[d + 1]]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + x
        made.append(mix(np.array([h])))
        owner.append(np.array([d]))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(len(array) + 1, np.int64)
    h, o = np.concatenate(made), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[first], o[first]
    return h, np.searchsorted(o, np.arange(len(array) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that stand for a set, whatever the order of its elements."""
    return tuple(mix(_sums(mix(h ^ np.uint64(s)), at)).view(np.int64) for s in (0x51ED270B, 0xC2B2AE3D27D4EB4F))  # type: ignore[return-value]


def parities(h: np.ndarray, at: np.ndarray, least: int = PARITY_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each set a power of two of bits, no fewer than its elements, as 64-bit numbers, and where each set's begin.

    Bit k is set if an odd number of elements hash to k, so two sets differ in at least as many elements as their parities
    in bits. Halves of a parity, one laid over the other, are the parity of half as many bits.
    """
    n = np.diff(at)
    bits = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits // 64)])
    owner = np.repeat(np.arange(len(n)), n)
    place = (mix(h + np.uint64(0xA5A5)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(first[-1]), np.uint64)
    np.bitwise_xor.at(out, first[:-1][owner] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return out, first


def prefix_sizes(n: np.ndarray, part: int = PART, of: int = OF) -> np.ndarray:
    """Sets of n elements with similarity part/of to another share one of so many first elements."""
    return np.where(n > 0, n - (n * part + of - 1) // of + 1, 0)


class Levels(NamedTuple):
    """Counters that stand out: a packed map of them, their numbers in order, and a level for each."""

    bits: int
    packed: np.ndarray
    counters: np.ndarray
    levels: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """Level of each shingle: 0 for what is usual, then powers of two."""
        own = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.zeros(len(h), np.uint8)
        high = np.flatnonzero(is_set(self.packed, own))
        out[high] = self.levels[np.searchsorted(self.counters, own[high])]
        return out


def sketch(source: DataFrame, bits: int = SKETCH_BITS) -> Levels:
    """Levels of how often shingles occur, by the first bits of their hashes.

    All documents are counted. The counters have a fixed size, so counts of several shingles run together; a counter
    stands out if it is four standard deviations above what chance gives. As one level belongs to each hash, the order is
    the same for all sets, which is all that exactness needs.
    """
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(width, np.uint16)  # of a task; what occurs more often stays at the end of the range
        for batch in slices(batches):
            h, _ = shingle_sets(batch.column("text"))
            own, n = np.unique((h >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
            total[own] = np.minimum(total[own] + n, 0xFFFF)
        return total

    total = combined(source.select("text"), count, lambda xs: np.minimum(np.sum(xs, 0, dtype=np.uint64), 0xFFFFFFFF), np.uint32)
    mean = total.mean()
    usual = mean + 4 * np.sqrt(mean) + 2
    high = np.flatnonzero(total > usual)
    return Levels(bits, np.packbits(total > usual), high.astype(np.int32), np.ceil(np.log2(total[high] / usual)).astype(np.uint8))


def _fixed(data: bytes, rows: int) -> pa.Array:
    """Binary values of equal length, one after the other."""
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * (8 * SHORT)).astype(np.int32)), pa.py_buffer(data)])


def prefix_table(source: DataFrame, levels: Levels) -> DataFrame:
    """Per row of (id, t, text): id, t, n (set size), s1 and s2 (the set's key), parity, short (folded to SHORT numbers), prefix (its rarest shingles, rarest
    first), uid (a number of its own)."""
    shared = source.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in slices(batches):
            h, at = shingle_sets(batch.column("text"))
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, level.of(h), owner))
            kept = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(prefix_sizes(n), n)
            s1, s2 = set_keys(h, at)
            off = np.concatenate([[0], np.cumsum(prefix_sizes(n))]).astype(np.int32)
            bits_of, first = parities(h, at)
            short = np.zeros(len(n) * SHORT, np.uint64)
            words_of = np.diff(first)
            np.bitwise_xor.at(short, np.repeat(np.arange(len(n)), words_of) * SHORT + (np.arange(len(bits_of)) - np.repeat(first[:-1], words_of)) % SHORT, bits_of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bits_of.view(np.int64))), _fixed(short.tobytes(), len(n)), pa.ListArray.from_arrays(pa.array(off), pa.array(h[order][kept].view(np.int64)))], ["id", "t", "n", "s1", "s2", "parity", "short", "prefix"]
            )

    made = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, t string, n long, s1 long, s2 long, parity array<long>, short binary, prefix array<long>")
    return written(made.withColumn("uid", F.monotonically_increasing_id()), "prefixes", (shared,))


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def whole_sets(source: DataFrame, own: DataFrame) -> DataFrame:
    """(s1, s2, hid, shingles) of the nodes in own (with s1, s2, hid), made again from the texts of the classes' own ids.

    A bit map keeps most other texts out, which is all it is for. Rows that repeat a class's id come along.
    """
    bits = map_bits(own.count())
    shared = source.sparkSession.sparkContext.broadcast(bit_map(own.select("hid"), lambda batch: _bit(batch.column("hid").to_numpy(), bits), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for whole in slices(batches):
            batch = whole.filter(pa.array(is_set(wanted, _bit(whole.column("hid").to_numpy(), bits))))
            if not batch.num_rows:
                continue
            h, at = shingle_sets(batch.column("text"))
            s1, s2 = set_keys(h, at)
            yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), batch.column("hid"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["s1", "s2", "hid", "shingles"])

    found = source.select("text", F.xxhash64("id").alias("hid")).mapInArrow(run, "s1 long, s2 long, hid long, shingles array<long>")
    return written(found, "sets", (shared,))


def _only(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of table (node, ..) whose node is among nodes, where these are few enough to be sent to all tasks: then
    nothing else of the table is shuffled by what comes next. Else the table as it is."""
    different = nodes.distinct()
    return table.join(F.broadcast(different), "node", "left_semi") if different.count() <= FEW_NODES else table


def plausible(pairs: DataFrame, classes: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """(a, b, apart) of the pairs whose parities, which are apart in so many bits, don't rule the similarity out."""
    pairs = written(pairs, "met")
    own = _only(classes.select("node", "n", "parity"), pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    right = own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y"))
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c, to: F.when(F.size(c) > F.size(to), F.zip_with(F.slice(c, 1, half(c)), F.slice(c, half(c) + 1, half(c)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(c))
    # sizes in reach of each other give parities of which one is twice as long at most
    apart = F.aggregate(F.zip_with(folded("x", "y"), folded("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    # with d elements apart the intersection has at most (n_a + n_b - d) / 2
    both = F.col("n_a") + F.col("n_b")
    met = pairs.join(left, "a").join(right, "b").withColumn("apart", apart)
    return met.where(of * (both - F.col("apart")) >= part * (both + F.col("apart"))).select("a", "b", "apart")


def verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """Pairs (a, b) of nodes whose whole sets reach the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    own = written(classes.join(nodes, "node", "left_semi").select("node", "n", "s1", "s2", F.xxhash64("least").alias("hid")), "needed")
    sets = whole_sets(source, own)
    keyed = pairs.select("a", "b").join(own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.struct("s1", "s2", "hid").alias("x_key")), "a")
    keyed = keyed.join(own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.struct("s1", "s2", "hid").alias("y_key")), "b")
    named = sets.select(F.struct("s1", "s2", "hid").alias("key"), "shingles")
    met = keyed.join(named.select(F.col("key").alias("x_key"), F.col("shingles").alias("x")), "x_key").join(named.select(F.col("key").alias("y_key"), F.col("shingles").alias("y")), "y_key")
    common = F.size(F.array_intersect("x", "y"))
    return met.where(of * common >= part * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link; component is the least node. Large star and small star in turn."""
    spark = edges.sparkSession
    ready_checkpoints(spark)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()


def _reach(n_x: Column, n_y: Column, i: Column, j: Column, part: int, of: int) -> Column:
    """Whether sizes and positions (from 0) of a shared element of two prefixes still allow the similarity."""
    most = 1 + F.least(n_x - i - 1, n_y - j - 1) + F.least(i, j)
    return (of * F.least(n_x, n_y) >= part * F.greatest(n_x, n_y)) & (of * most >= part * (n_x + n_y - most))


def _met(pairs: DataFrame, part: int, of: int) -> DataFrame:
    """Different pairs (a, b), a > b, of rows (node, n, i, c, o: the same of another set) that may be similar."""
    near = pairs.where("o is not null and o.node <> node and o.c <> c").where(_reach(F.col("n"), F.col("o.n"), F.col("i"), F.col("o.i"), part, of))
    return near.select(F.greatest("node", "o.node").alias("a"), F.least("node", "o.node").alias("b")).distinct()


def _allowed(cols: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, part: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of entries of one group have different answers and aren't ruled out, and how far their short parities
    are apart; cheap tests come first."""
    ok = np.flatnonzero((cols["c"][p] != cols["c"][q]) & ((cols["x"][p] == cols["y"][p]) | (cols["block"][p] != cols["block"][q])))
    p, q = p[ok], q[ok]
    n_p, n_q = cols["n"][p], cols["n"][q]
    i, j = cols["i"][p], cols["i"][q]
    most = 1 + np.minimum(n_p - i - 1, n_q - j - 1) + np.minimum(i, j)
    own = (of * np.minimum(n_p, n_q) >= part * np.maximum(n_p, n_q)) & (of * most >= part * (n_p + n_q - most))
    ok, p, q = ok[own], p[own], q[own]
    apart = np.bitwise_count(cols["short"][p] ^ cols["short"][q]).sum(1, dtype=np.int64)
    both = cols["n"][p] + cols["n"][q]
    own = of * (both - apart) >= part * (both + apart)
    return ok[own], apart[own]


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of rows (a, b, apart) those with the least apart, then the least b, for each a."""
    pairs = pairs[:, np.lexsort((pairs[1], pairs[2], pairs[0]))]
    return pairs[:, np.flatnonzero(np.append(True, pairs[0, 1:] != pairs[0, :-1])[: pairs.shape[1]])]


def met_in_blocks(batches: Iterator[pa.RecordBatch], part: int = PART, of: int = OF, best: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, apart), a > b, of entries (h, x, y, block, node, n, i, c, short) with equal h, x and y, by which they are
    sorted; with `best`, only the nearest b of each node a, in either direction.

    A group is a pair of blocks, x and y, of the list h; LIST_BLOCK bounds it, so that a group and a batch are held at once.
    """
    names = ("h", "x", "y", "block", "node", "n", "i", "c")
    held: dict[str, np.ndarray] = {}

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
        data, _ = utf8(batch.column("short"))
        return cols | {"short": data.view(np.uint64).reshape(-1, SHORT).copy() if len(data) else np.zeros((0, SHORT), np.uint64)}

    def scan(cols: dict[str, np.ndarray], upto: int) -> pa.RecordBatch:
        key = np.stack([cols[c][:upto] for c in ("h", "x", "y")])
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))) if upto else np.zeros(0, np.int64)
        ends = np.repeat(np.append(first[1:], upto), np.diff(np.append(first, upto))) if upto else first
        many = ends - np.arange(upto) - 1
        total, out, at = np.concatenate([[0], np.cumsum(many)]), [np.zeros((3, 0), np.int64)], 0
        while at < upto:
            end = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, "right")) - 1)
            p = np.repeat(np.arange(at, end), many[at:end])
            q = np.arange(len(p)) - np.repeat(total[at:end] - total[at], many[at:end]) + p + 1
            ok, apart = _allowed(cols, p, q, part, of)
            a, b = cols["node"][p[ok]], cols["node"][q[ok]]
            high = np.stack([np.maximum(a, b), np.minimum(a, b), apart])
            out.append(_nearest(np.concatenate([high, high[[1, 0, 2]]], 1)) if best else np.unique(high, axis=1))
            at = end
        pairs = np.concatenate(out, 1)
        pairs = _nearest(pairs) if best else np.unique(pairs, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b", "apart"])

    for batch in batches:
        now = read(batch)
        cols = {c: np.concatenate([held[c], now[c]]) for c in now} if held else now
        size = len(cols["h"])
        same = (cols["h"] == cols["h"][-1]) & (cols["x"] == cols["x"][-1]) & (cols["y"] == cols["y"][-1]) if size else np.zeros(0, bool)
        upto = int(np.flatnonzero(~same)[-1]) + 1 if size and not same.all() else 0
        yield scan(cols, upto)
        held = {c: v[upto:] for c, v in cols.items()}
    if held:
        yield scan(held, len(held["h"]))


def _scanned(open_: DataFrame, short: DataFrame, part: int, of: int, best: bool) -> DataFrame:
    """Pairs (a, b, apart) of entries (h, node, n, i, c) of one list with different answers that aren't ruled out: all of
    them, or the nearest b of each node a."""
    every = Window.partitionBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = open_.withColumn("k", F.ceil(F.count("*").over(every) / LIST_BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")))
    dealt = sized.join(_only(short, open_.select("node")), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "n", "i", "c", "short")
    dealt = dealt.repartition(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "x", "y").sortWithinPartitions("h", "x", "y")
    found = dealt.mapInArrow(lambda batches: met_in_blocks(batches, part, of, best), "a long, b long, apart long")
    if not best:
        return found.distinct()
    found = found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _firsts(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows (node, ..) whose node is in `chosen`, and a broadcast map that they need.

    Most are: a map of those that aren't keeps nearly all others out of the join, so their columns aren't shuffled.
    """
    copies = written(rows.select("node").join(chosen.select("node"), "node", "left_anti"), "copies")
    bits = map_bits(copies.count())
    shared = rows.sparkSession.sparkContext.broadcast(bit_map(copies, lambda batch: _bit(batch.column("node").to_numpy(), bits), bits))

    def sifted(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(is_set(shared.value, _bit(batch.column("node").to_numpy(), bits)) == wanted))
                if own.num_rows:
                    yield own

        return rows.mapInArrow(run, rows.schema)

    return sifted(False).union(sifted(True).join(copies, "node", "left_anti")), shared


def classes(source: DataFrame, part: int = PART, of: int = OF) -> tuple[DataFrame, DataFrame]:
    """For (id, t, text): the prefix table, and (node, s1, s2, least, c) of every different set that isn't empty: its key,
    its least id, and its component."""
    table = prefix_table(source, sketch(source))
    marks = table.select(F.col("uid").alias("node"), "n", "parity")
    slim = written(table.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("least"), F.min("uid").alias("node")), "classes")
    own, marks_of = _firsts(table.where("n > 0").select(F.col("uid").alias("node"), "n", "prefix"), slim)
    # size and place in one number: most bytes are shuffled here (23 million rows at 0.5 GB)
    lists = own.select("node", "n", F.posexplode("prefix").alias("i", "h")).select("h", "node", (F.shiftleft("n", 32) + F.col("i")).alias("ni"))
    every = Window.partitionBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    who = [F.bit_xor(F.xxhash64("node", F.lit(seed))).over(every).alias(f"who{seed}") for seed in (1, 2)]
    lists = lists.select("h", "node", "ni", F.count("*").over(every).alias("many"), *who).where("many > 1")
    sized = [F.shiftright("ni", 32).cast("int").alias("n"), F.col("ni").bitwiseAND(0xFFFFFFFF).cast("int").alias("i")]
    lists = lists.select("h", "node", *sized, "many", *(f"who{seed}" for seed in (1, 2)))
    del own
    lists = written(lists, "members", (marks_of,))
    # lists of the same sets (shingles of one passage) allow the same pairs: any of a pair's common shingles has a position
    # that doesn't rule it out, so one list stands for all of them
    one = lists.groupBy("many", "who1", "who2").agg(F.min("h").alias("h")).select("h")
    members, lists = lists, written(lists.select("h", "node", "n", "i").join(one, "h", "left_semi"), "lists")
    forget(members)
    open_, edges, known, turn, last = lists.withColumn("c", F.col("node")), None, None, 0, ROUNDS < 1
    while True:
        if known is not None:  # only lists with different answers are left
            open_ = lists.join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
            open_ = written(open_.withColumn("differ", F.min("c").over(every) < F.max("c").over(every)).where("differ").drop("differ"), "open")
        if turn or last:
            pairs = _scanned(open_, table.select(F.col("uid").alias("node"), "short"), part, of, not last)
            pairs = written(plausible(pairs, marks, part, of), "pairs")
        else:
            here, order = F.struct("node", "n", "i", "c"), Window.partitionBy("h").orderBy("n", "node")
            near = open_.withColumns({"last": F.lag(here).over(order), "head": F.first(here).over(order)})
            pairs = _met(near.select("node", "n", "i", "c", F.explode(F.array("last", "head")).alias("o")), part, of)
            pairs = written(plausible(pairs, marks, part, of), "pairs")
            both = pairs.select("a", "b", "apart").union(pairs.select("b", "a", "apart")).toDF("x", "y", "apart")
            best = both.groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))  # of all that a set met
            pairs = written(best.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "best")
        found = pairs.select("a", "b") if pairs.isEmpty() else written(verified(pairs, slim, source, part, of), "edges")
        edges = found if edges is None else edges.union(found)
        if not found.isEmpty() or known is None:
            known = written(components(edges), "known")
        if last:
            break
        turn += 1
        last = turn >= ROUNDS or found.count() * 10 <= edges.count()
    return table, slim.select("node", "s1", "s2", "least").join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("t", _text_key(F.col("text")))


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, of: int = OF) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links, its own included).

    Texts without words (null, empty, blank) have no shingles and are linked with nothing. Equal sets are linked whatever
    their ids; rows that repeat an id are judged one by one. A null id never names a component, unless it has no other id.
    """
    table, named = classes(_source(docs, id_col, text_col).withColumn("t", F.lit("")), part, of)
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    answers = written(named.join(least, "c").select(F.struct("s1", "s2").alias("key"), "component_id"), "answers")
    rows = table.select("id", "n", F.when(F.col("n") > 0, F.struct("s1", "s2")).alias("key"))
    return look_up(rows, answers, "key").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs of which each component of near duplicates has one, with their columns; rows without words all stay.

    It is the row with the least id, null ones last; of equal ids the one with the least hash of its text. Rows are told
    apart by id and text, so unlike texts with one id, or without id, don't go with each other; of rows that repeat both,
    one stays.
    """
    table, named = classes(_source(docs, id_col, text_col))
    rows = look_up(table.where("n > 0").select("id", "t", F.struct("s1", "s2").alias("key")), named.select(F.struct("s1", "s2").alias("key"), "c"), "key")
    rows = written(rows.select("id", "t", "c"), "members")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")
    stays = written(rows.groupBy("c").agg(F.min(place).alias("one"), F.count("*").alias("many")).where("many > 1"), "stays")
    same = F.col("id").eqNullSafe(F.col("one.id")) & (F.col("t") == F.col("one.t"))
    marked = rows.join(stays, "c").withColumn("first", same)
    marked = written(marked.groupBy("id", "t").agg(F.max("first").alias("first"), F.count("*").alias("rows")).where("not first or rows > 1"), "duplicates")
    # a map of what goes keeps nearly all other texts out of the join
    key = lambda x, t: F.xxhash64(x.cast("string"), t)
    bits = map_bits(marked.count())
    marks = docs.sparkSession.sparkContext.broadcast(bit_map(marked.select(key(F.col("id"), F.col("t")).alias("k")), lambda batch: _bit(batch.column("k").to_numpy(), bits), bits))
    named_docs = docs.withColumn("_t", _text_key(F.col(text_col))).withColumn("_k", key(F.col(id_col), F.col("_t")))

    def sifted(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(is_set(marks.value, _bit(batch.column("_k").to_numpy(), bits)) == wanted))
                if own.num_rows:
                    yield own

        return named_docs.mapInArrow(run, named_docs.schema)

    some = sifted(True)
    alike = lambda x: some[id_col].eqNullSafe(x["id"]) & (some["_t"] == x["t"])
    kept = sifted(False).union(some.join(marked, alike(marked), "left_anti"))
    again = marked.where("first")
    if not again.isEmpty():
        kept = kept.union(some.join(again, alike(again), "left_semi").dropDuplicates([id_col, "_t"]))
    return kept.drop("_t", "_k")


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """The contract pair by pair, for tests on small tables."""
    import re

    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    at: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < i}:
            both = len(s & sets[j])
            if OF * both >= PART * (len(s) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]
