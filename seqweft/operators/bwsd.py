"""Burrows-Wheeler similarity distribution: run lengths of the colours of each pair of collections, and its summaries.

For colours i < j, the edges of both in order give a sequence of colours; its run lengths are counted. Edges are dealt to
tasks by ranges of the order. A task sums up its range for all pairs at once: first run, last run and a histogram of those
between, which is no larger for a longer range. Summaries of neighbouring ranges merge into one of the same kind, first of
FAN ranges at a time, so what is left for the last step is small. The sequence of a pair is never sorted in one task, and
no edge is repeated for the pairs it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.operators.order import in_ranges
from seqweft.operators.shared import stored

#: Edges that a task sums up at once, and ranges whose summaries merge in one step.
BLOCK, FAN = 1 << 18, 512

_HEAVY = "￿"  # unlike any colour: ends runs, is no run itself


def pairs(e: DataFrame) -> DataFrame:
    """(i, j) of all colours i < j, ordered by bytes. One row for each colour is joined."""
    c = e.select("color").distinct()
    return c.select(F.col("color").alias("i")).join(c.select(F.col("color").alias("j")), F.col("i") < F.col("j"))


class _Summary:
    """Runs of one pair in a range: the first, the one that is still open, and how many there are of each length and side
    (0 the smaller colour, 1 the other, 2 a barrier)."""

    def __init__(self):
        self.first: tuple[int, int] | None = None
        self.open: tuple[int, int] | None = None
        self.counts: dict[tuple[int, int], int] = {}

    def add(self, sides: np.ndarray) -> None:
        """Further edges of the range, by side."""
        start = np.flatnonzero(np.append(True, sides[1:] != sides[:-1]))
        size, sides = np.diff(np.append(start, len(sides))), sides[start]
        if self.open is not None:
            if self.open[0] == sides[0]:
                size[0] += self.open[1]
            else:
                sides, size = np.append(self.open[0], sides), np.append(self.open[1], size)
        self.open = int(sides[-1]), int(size[-1])
        sides, size = sides[:-1], size[:-1]
        if len(size) and self.first is None:
            self.first, sides, size = (int(sides[0]), int(size[0])), sides[1:], size[1:]
        self.count((size * 3 + sides)[sides < 2])

    def count(self, codes: np.ndarray, times: int | None = None) -> None:
        for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True):
            key = code % 3, code // 3
            self.counts[key] = self.counts.get(key, 0) + (n if times is None else times)


def _heavy(own: np.ndarray, other: np.ndarray, key: np.ndarray, coverage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, in both colours, of edges that both have and either more than once, and the lesser and greater coverage."""
    if not len(own) or not len(other):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = np.minimum(np.searchsorted(key[other], key[own]), len(other) - 1)
    same = key[other[at]] == key[own]
    a, b = own[same], other[at[same]]
    low, high = np.minimum(coverage[a], coverage[b]), np.maximum(coverage[a], coverage[b])
    many = high > 1
    return a[many], b[many], low[many], high[many]


def _summed(batches: Iterator[pa.RecordBatch], of: list[tuple[int, int]], colours: int, with_coverage: bool) -> Iterator[tuple[int, _Summary]]:
    """(number of the pair, its summary) of a range of sorted edges (c, coverage, key)."""
    found: dict[int, _Summary] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def add(c: np.ndarray, coverage: np.ndarray, key: np.ndarray) -> None:
        where = [np.flatnonzero(c == x) for x in range(colours)]
        number = np.cumsum(np.append(0, key[1:] != key[:-1]))
        for p, (i, j) in enumerate(of):
            a, b = where[i], where[j]
            if not len(a) and not len(b):
                continue
            own = found.setdefault(p, _Summary())
            bars = np.zeros(0, np.int64)
            if with_coverage:
                bars, others, low, high = _heavy(a, b, number, coverage)
                if len(bars):
                    a, b = a[~np.isin(a, bars, assume_unique=True)], b[~np.isin(b, others, assume_unique=True)]
                    own.count(np.array([3 + 2]), int(2 * low.sum()))  # runs of length 1, of no side
                    own.count((high - low)[high > low] * 3 + 2)
            at = np.concatenate([a, b, bars])
            sides = np.repeat(np.arange(3), (len(a), len(b), len(bars)))
            own.add(sides[np.argsort(at, kind="stable")])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(x).to_numpy() for x in ("c", "coverage", "key")))
        if sum(len(x[0]) for x in held) >= BLOCK:
            c, coverage, key = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])  # the last edge may go on in the next batch
            if cut:
                add(c[:cut], coverage[:cut], key[:cut])
                held = [(c[cut:], coverage[cut:], key[cut:])]
    if held:
        add(*(np.concatenate(x) for x in zip(*held, strict=True)))
    yield from found.items()


def summaries(e: DataFrame, pair: DataFrame, with_coverage: bool = False) -> DataFrame:
    """(part, i, j, place, color, len, n) of each range of the order: place is 1 for its first run, 2 for its last, 0 for n
    runs between. Barriers have a colour of their own; with coverage, what edges of both colours give has none.

    The names of the colours and the pairs asked for go through the driver and to the tasks, as the result's rows do.
    """
    names = sorted((r[0] for r in e.select("color").distinct().collect()), key=str.encode)
    code = {x: k for k, x in enumerate(names)}
    asked = [(r["i"], r["j"]) for r in pair.collect()]
    known = [(i, j) for i, j in asked if i in code or j in code]
    of = [(code.get(i, len(names)), code.get(j, len(names))) for i, j in known]
    codes = F.broadcast(e.sparkSession.createDataFrame([*code.items()], "color string, c int"))
    r = F.reverse("kmer")
    placed = in_ranges(e.join(codes, "color").select("c", "coverage", r.alias("r"), "W"), ["r", "W"], ["r", "W", "c"]).select("c", "coverage", F.xxhash64("r", "W").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), []
        for p, own in _summed(batches, of, len(names) + 1, with_coverage):
            i, j = known[p]
            sides = (i, j, _HEAVY)
            outer = [(1, own.first), (2, own.open)] if own.first else [(1, own.open)]
            rows += [(part, i, j, place, sides[x[0]], x[1], 1) for place, x in outer if x is not None]
            rows += [(part, i, j, 0, None if side == 2 else sides[side], size, n) for (side, size), n in own.counts.items() if with_coverage or side < 2]
        types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "i", "j", "place", "color", "len", "n"])

    return placed.mapInArrow(run, "part int, i string, j string, place int, color string, len long, n long")


def merged(s: DataFrame, fan: int) -> DataFrame:
    """Summaries of `fan` neighbouring ranges each as one summary: a last run and the next range's first run of one colour
    are one run."""
    group = F.floor(F.col("part") / fan).cast("int")
    w = Window.partitionBy("group", "i", "j").orderBy("part", "place")
    new = F.when((F.lag("color").over(w) == F.col("color")) & (F.lag("part").over(w) != F.col("part")), 0).otherwise(1)
    outer = s.where("place > 0").withColumn("group", group).withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs_ = outer.groupBy("group", "i", "j", "run").agg(F.first("color").alias("color"), F.sum("len").alias("len"))
    most = F.max("run").over(Window.partitionBy("group", "i", "j"))
    place = F.when(F.col("run") == 1, 1).when(F.col("run") == most, 2).otherwise(0)
    runs_ = runs_.select(F.col("group").alias("part"), "i", "j", place.alias("place"), "color", "len", F.lit(1).cast("long").alias("n"))
    inner = s.where("place = 0").groupBy(group.alias("part"), "i", "j", "place", "color", "len").agg(F.sum("n").alias("n"))
    return inner.unionByName(runs_)


def _counted(e: DataFrame, pair: DataFrame | None, with_coverage: bool, store: bool = True) -> DataFrame:
    """(i, j, color, len, n) of the whole order."""
    e = stored(e, "edges") if store else e
    s = summaries(e, pairs(e) if pair is None else pair, with_coverage)
    ranges = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while ranges > FAN:
        s, ranges = merged(s, FAN), -(-ranges // FAN)
    s = merged(s, 1 << 30)
    # a barrier is no run; what shared edges gave has no colour, and all others have one
    return s.where(F.col("color").isNull() | (F.col("color") != _HEAVY)).groupBy("i", "j", "color", "len").agg(F.sum("n").alias("n"))


def runs(e: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    """(i, j, color, len, n): how many runs of a colour have a length, for every pair, without coverage."""
    return _counted(e, pair, False)


def histogram(e: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    """(i, j, len, n): how many runs have a length."""
    return runs(e, pair).groupBy("i", "j", "len").agg(F.sum("n").alias("n"))


def coverage_histogram(e: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    """As histogram, with coverage: an edge of both colours that either has more than once gives 2 * min runs of length 1
    and one of the difference, and parts the runs around it; all others count once."""
    return _counted(e, pair, True).groupBy("i", "j", "len").agg(F.sum("n").alias("n"))


def distances(hist: DataFrame, pair: DataFrame) -> DataFrame:
    """(i, j, s, expectation, entropy) of every pair; without runs s is 0, expectation -1 and entropy 0."""
    s = F.sum("n").over(Window.partitionBy("i", "j"))
    p = F.col("n") / F.col("s")
    found = hist.withColumn("s", s).groupBy("i", "j").agg(F.first("s").alias("s"), (F.sum(F.col("len") * p) - 1).alias("e"), (-F.sum(p * F.log2(p))).alias("h"))
    return pair.join(found, ["i", "j"], "left").select(
        "i", "j", F.coalesce("s", F.lit(0).cast("long")).alias("s"), F.coalesce(F.round("e", 6), F.lit(-1.0)).alias("expectation"), F.coalesce(F.abs(F.round("h", 6)), F.lit(0.0)).alias("entropy")
    )


def similarity(e: DataFrame, coverage: bool = False, pair: DataFrame | None = None) -> DataFrame:
    """(i, j, s, expectation, entropy) of every pair; the edges are counted once and written."""
    e = stored(e, "edges")
    pair = pairs(e) if pair is None else pair
    hist = _counted(e, pair, coverage, False).groupBy("i", "j", "len").agg(F.sum("n").alias("n"))
    return distances(hist, pair)


def pair_similarity(e: DataFrame, i: str, j: str, coverage: bool = False) -> DataFrame:
    """(i, j, s, expectation, entropy) of two named colours alone; edges of others are left out first."""
    i, j = sorted((i, j))
    pair = e.sparkSession.createDataFrame([(i, j)], "i string, j string")
    return similarity(e.where(F.col("color").isin(i, j)), coverage, pair)


def coloured(e: DataFrame) -> DataFrame:
    """(kmer, W, colors): each edge once, with the colours that have it in order."""
    return e.groupBy("kmer", "W").agg(F.array_sort(F.collect_set("color")).alias("colors"))


def classes(e: DataFrame) -> DataFrame:
    """(colors, n): the different sets of colours that edges have, and how many edges have each. What pairs share follows
    from these few rows."""
    return coloured(e).groupBy("colors").agg(F.count("*").alias("n"))


def _class_pairs(c: DataFrame) -> DataFrame:
    """(i, j, n) of all pairs of colours i < j that some edge has."""
    return c.where(F.size("colors") > 1).select(F.explode("colors").alias("i"), "colors", "n").select("i", F.explode("colors").alias("j"), "n").where("i < j").groupBy("i", "j").agg(F.sum("n").alias("n"))


def edge_sets(e: DataFrame, i: str, j: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (kmer, W) that both colours have, that only the first has, and that either has."""
    own = coloured(e.where(F.col("color").isin(i, j)))
    one, two = F.array_contains("colors", i), F.array_contains("colors", j)
    return own.where(one & two).select("kmer", "W"), own.where(one & ~two).select("kmer", "W"), own.select("kmer", "W")


def owners(e: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    """(i, j, len, has_i, has_j): whose runs have a length."""
    return runs(e, pair).groupBy("i", "j", "len").agg(F.bool_or(F.col("color") == F.col("i")).alias("has_i"), F.bool_or(F.col("color") == F.col("j")).alias("has_j"))


def longest(e: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    return runs(e, pair).groupBy("i", "j").agg(F.max("len").alias("longest"))


def shared(e: DataFrame) -> DataFrame:
    """(i, j, n): edges that two colours have in common; pairs without any have no row."""
    return _class_pairs(classes(e))


def private(e: DataFrame) -> DataFrame:
    """(color, n): edges that no other colour has."""
    return classes(e).where(F.size("colors") == 1).select(F.col("colors")[0].alias("color"), "n")


def set_sizes(e: DataFrame) -> DataFrame:
    """(i, j, n_both, n_only_i, n_only_j, n_any) of the edge sets of all pairs."""
    c = stored(classes(e), "classes")
    n = c.select(F.explode("colors").alias("color"), "n").groupBy("color").agg(F.sum("n").alias("n"))
    p = pairs(n).join(n.select(F.col("color").alias("i"), F.col("n").alias("a")), "i").join(n.select(F.col("color").alias("j"), F.col("n").alias("b")), "j")
    both = F.coalesce("n", F.lit(0).cast("long"))
    return p.join(_class_pairs(c), ["i", "j"], "left").select("i", "j", both.alias("n_both"), (F.col("a") - both).alias("n_only_i"), (F.col("b") - both).alias("n_only_j"), (F.col("a") + F.col("b") - both).alias("n_any"))
