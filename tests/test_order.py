"""Orders over ranges: the whole edge table, the order of all contexts, run summaries, colour classes."""

import random
from collections import Counter
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqweft.operators import bwsd, edges, order
from seqweft.operators.contexts import context_order


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _reads(seed, alphabet="ACGT"):
    rng = random.Random(seed)
    one = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 30, 150]))) for _ in range(12)]
    return [("a", 0, None)] + [(c, i, s) for c in "ab" for i, s in enumerate(one[:9] if c == "a" else one[3:] + [one[4] + "A", "A" * 90, "A" * 70], 1)]


@pytest.mark.parametrize(("k", "alphabet"), [(1, "ACGT"), (3, "ACGT"), (5, "甲乙")])
def test_whole_edge_table(spark, k, alphabet):
    rows = [(c, s) for c, _, s in _reads(k, alphabet) if s is not None]
    seqs = spark.createDataFrame(rows, "color string, seq string")
    got = [tuple(r) for r in edges.ordered(edges.contexts_with_short(seqs, k), k).orderBy("pos").collect()]
    count = Counter((s[max(0, e - k) : e][::-1], s[e] if e < len(s) else "$", c) for c, s in rows for e in range(len(s) + 1))
    want, met = [], set()
    table = sorted(count)
    for n, (r, w, c) in enumerate(table):
        before = table[n - 1] if n else ("", "", "")
        new = n == 0 or before[0] != r
        last = n == len(table) - 1 or table[n + 1][0] != r
        lcp = _common(before[0], r) if new else len(r) if len(r) < k else k + (before[1] == w)
        want.append((n, r[::-1], w, c, count[r, w, c], int(last), int((r[: k - 1], w) not in met), lcp, len(r) + 1))
        met.add((r[: k - 1], w))
    assert got == want


def test_order_of_all_contexts(spark):
    rows = _reads(7) + [("c", 1, "ACGTTGCA" * 60), ("c", 2, "TTACGTTGCA" + "ACGTTGCA" * 40), ("c", 3, "ACGTTGCA" * 60)]
    got = [tuple(r) for r in context_order(spark.createDataFrame(rows, "color string, read int, seq string"), ["read"]).orderBy("rank").collect()]
    every = sorted(((s or "")[:e][::-1], c, i, (s or "")[e : e + 1] or "$") for c, i, s in rows for e in range(len(s or "") + 1))
    want = [(n, w, _common(every[n - 1][0], r) if n else 0, len(r) + 1, c) for n, (r, c, _, w) in enumerate(every)]
    assert got == want
    assert context_order(spark.createDataFrame([], "color string, read int, seq string"), ["read"]).count() == 0


def test_ranges_are_even_whatever_the_composition(spark):
    rng = random.Random(2)
    seqs = spark.createDataFrame([("a", "".join(rng.choice("AAAAAAAAAAAAAAAAAAAC") for _ in range(40_000))), ("b", "".join(rng.choice("ACGT") for _ in range(2_000)))], "color string, seq string")
    e = edges.edges(seqs, 12).withColumn("r", F.reverse("kmer"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        table = order.numbered(order.in_ranges(e.repartition(8), ["r", "W"], ["r", "W", "color"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in table.groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    pos = [r.pos for r in order.with_positions(table).orderBy("r", "W", "color").collect()]
    assert pos == list(range(len(pos)))
    groups = spark.createDataFrame([(x, x * x) for x in range(50)], "x long, n long")
    assert {r.x: r.before for r in order.running(groups, ["x"], "n").collect()} == {x: sum(y * y for y in range(x)) for x in range(50)}


@pytest.mark.parametrize("with_coverage", [False, True])
def test_summaries_however_edges_are_cut(with_coverage, monkeypatch):
    """Blocks and batches of any size give the runs of the whole, and summaries of ranges merge into them."""
    rng = random.Random(11)
    keys = sorted((k, c) for k in range(300) for c in rng.sample(range(3), rng.choice([1, 1, 1, 2, 3])))
    cover = {x: rng.choice([1, 1, 1, 4]) for x in keys}
    of = list(combinations(range(3), 2))
    for block, size in ((5, 3), (64, 10), (1 << 18, 1000)):
        monkeypatch.setattr(bwsd, "BLOCK", block)
        batches = [pa.RecordBatch.from_arrays([pa.array([c for _, c in own]), pa.array([cover[x] for x in own]), pa.array([k for k, _ in own])], ["c", "coverage", "key"]) for own in (keys[a : a + size] for a in range(0, len(keys), size))]
        got = dict(bwsd._summed(iter(batches), of, 3, with_coverage))
        for p, (i, j) in enumerate(of):
            sides, ones, rest = [], 0, Counter()
            for _, group in groupby((x for x in keys if x[1] in (i, j)), key=lambda x: x[0]):
                group = list(group)
                n = [cover[x] for x in group]
                if with_coverage and len(group) == 2 and max(n) > 1:
                    sides.append(2)
                    ones += 2 * min(n)
                    rest.update([max(n) - min(n)] if n[0] != n[1] else [])
                else:
                    sides += [int(x[1] == j) for x in group]
            runs = [(s, len(list(g))) for s, g in groupby(sides)]
            own = got[p]
            assert own.first[0] == runs[0][0] and own.open[0] == runs[-1][0]
            assert own.first[1] == runs[0][1] or runs[0][0] == 2
            want = Counter((s, n) for s, n in runs[1:-1] if s < 2)
            if ones:
                want[2, 1] += ones
            for n, t in rest.items():
                want[2, n] += t
            assert Counter(own.counts) == want


def test_merging_in_several_steps(spark):
    rng = np.random.default_rng(4)
    rows, sides = [], []
    for part in range(40):
        runs = [(str(s), len(list(g))) for s, g in groupby(rng.integers(0, 2, int(rng.integers(0, 5))).tolist())]
        sides += [s for s, n in runs for _ in range(n)]
        for k, (s, n) in enumerate(runs):
            rows.append((part, "0", "1", 1 if k == 0 else 2 if k == len(runs) - 1 else 0, s, n, 1))
    want = Counter((s, len(list(g))) for s, g in groupby(sides))
    s = spark.createDataFrame(rows, "part int, i string, j string, place int, color string, len long, n long")
    for fans in ([1 << 30], [3, 1 << 30], [2, 2, 5, 1 << 30]):
        now = s
        for fan in fans:
            now = bwsd.merged(now, fan)
        got = {(r.color, r.len): r.n for r in now.groupBy("color", "len").agg(F.sum("n").alias("n")).collect()}
        assert got == want


def test_colour_classes(spark):
    rows = [("a", "x", "1"), ("b", "x", "1"), ("c", "x", "1"), ("a", "y", "1"), ("b", "y", "1"), ("a", "z", "1"), ("d", "q", "1")]
    e = spark.createDataFrame(rows, "color string, kmer string, W string")
    assert {(tuple(r.colors), r.n) for r in bwsd.classes(e).collect()} == {(("a", "b", "c"), 1), (("a", "b"), 1), (("a",), 1), (("d",), 1)}
    assert {tuple(r) for r in bwsd.shared(e).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {tuple(r) for r in bwsd.private(e).collect()} == {("a", 1), ("d", 1)}
    sizes = {(r.i, r.j): (r.n_both, r.n_only_i, r.n_only_j, r.n_any) for r in bwsd.set_sizes(e).collect()}
    assert sizes["a", "b"] == (2, 1, 0, 3) and sizes["c", "d"] == (0, 1, 1, 2) and len(sizes) == 6
