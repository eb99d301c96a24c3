"""Graphs, trees, bit vectors, strings, readers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweft.functions import numbers, strings
from seqweft.operators import bitvector, graphs, trees
from seqweft.sources import readers, writers


def test_neighbour_joining_recovers_additive_trees():
    rng = random.Random(3)
    for n in (2, 3, 4, 7, 12):
        branches, leaves = [(n, 0, 1.0)] if n > 1 else [], [0]
        inner = n
        for t in range(1, n):
            # attach a leaf to the middle of a random branch
            a, b, w = branches.pop(rng.randrange(len(branches)))
            mid = inner + 1 if t > 1 else inner
            inner = mid
            if t == 1:
                branches = [(0, 1, rng.uniform(0.5, 2))]
            else:
                branches += [(a, mid, w / 2), (b, mid, w / 2), (mid, t, rng.uniform(0.5, 2))]
            leaves.append(t)
        d = trees.path_lengths(branches, n)
        assert np.allclose(trees.path_lengths(trees.join_neighbours(d), n), d)


def test_newick_small():
    assert trees.newick([], []) == ";" and trees.newick([], ["a"]) == "(a);"
    assert trees.newick(trees.join_neighbours(np.array([[0, 2.0], [2.0, 0]])), ["a", "b"]) == "(a,b):2.0000000000000000e+00;"


def test_cliques_and_triangles(spark):
    rng = random.Random(5)
    n = 12
    e = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
    near = {v: {b if a == v else a for a, b in e if v in (a, b)} for v in range(n)}
    want = set()
    for m in range(1, 1 << n):
        c = [v for v in range(n) if m >> v & 1]
        if all(b in near[a] for i, a in enumerate(c) for b in c[i + 1 :]) and not any(all(x in near[v] for x in c) for v in range(n) if v not in c):
            want.add(",".join(map(str, c)))
    want = {c for c in want if "," in c}  # lone vertices have no edge
    df = graphs.both_ways(spark.createDataFrame([(a, b, 1.0) for a, b in e], "u long, v long, w double"))
    got = [r.clique for r in graphs.maximal_cliques(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    tri = {(r.a, r.b, r.c) for r in graphs.triangles(df).collect()}
    assert tri == {(a, b, c) for a, b in e for c in near[a] & near[b] if a < b < c}


@pytest.mark.parametrize(("n", "share"), [(300, 0.3), (2600, 0.01), (2600, 0.9), (512, 0.0), (64, 1.0)])
def test_bits(spark, n, share):
    rng = random.Random(n)
    bits = [int(rng.random() < share) for _ in range(n)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "o int, bit int")
    assert [(x.pos, x.rank1, x.rank0) for x in bitvector.ranked(df, "bit", ["o"]).orderBy("o").collect()] == [(i, sum(bits[: i + 1]), i + 1 - sum(bits[: i + 1])) for i in range(n)]
    p = bitvector.packed(bitvector.positions(df, ["o"]), "bit")
    asked = [0, 1, 2, 5, 63, 64, 65, 511, 512, 513, n - 1, n, n + 1]
    wanted = spark.createDataFrame([(x,) for x in asked], "x long")
    ones, zeros = ([i for i, b in enumerate(bits) if b == v] for v in (1, 0))
    place = lambda own, x: own[x - 1] if 0 < x <= len(own) else -1
    assert {x.x: x.pos for x in bitvector.select1(p, wanted).collect()} == {x: place(ones, x) for x in asked}
    assert {x.x: x.pos for x in bitvector.select0(p, wanted).collect()} == {x: place(zeros, x) if x else 0 for x in asked}
    at = wanted.withColumnRenamed("x", "pos")
    assert {x.pos: x.bit for x in bitvector.access(p, at).collect()} == {x: bits[x] if x < n else None for x in asked}
    new = [b or i in asked for i, b in enumerate(bits)]
    assert {x.pos: x.rank1 for x in bitvector.rank1(bitvector.with_bits(p, at), at).collect()} == {x: sum(new[: x + 1]) if x < n else None for x in asked}
    want = {}
    for a, b in zip(ones, ones[1:]):
        want[b - a - 1] = want.get(b - a - 1, 0) + 1
    assert {r.gap: r.n for r in bitvector.gaps(p).collect()} == want


def test_strings(spark):
    rows = ["a b \t\n", "x\n\n", "", None, "é,b;c"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = df.select("i", strings.rtrim(F.col("s")).alias("r"), strings.chomp(F.col("s")).alias("c"), strings.split_any(F.col("s"), ",;").alias("p"), strings.djb2("s").alias("h")).orderBy("i").collect()
    assert [x.r for x in got] == ["a b", "x", "", None, "é,b;c"]
    assert [x.c for x in got] == ["a b \t", "x\n", "", None, "é,b;c"]
    assert got[4].p == ["é", "b", "c"]

    def djb2(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + (b - 256 if b > 127 else b)) % 2**64
        return h

    assert [None if x.h is None else int(x.h) for x in got] == [None if s is None else djb2(s) for s in rows]


def test_numbers(spark):
    df = spark.range(0, 400)
    got = df.select("id", numbers.prime_from(F.col("id")).alias("p"), numbers.power_of_two_from(F.col("id")).alias("q"), numbers.is_power_of_two(F.col("id")).alias("b")).collect()
    prime = lambda n: n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))
    for r in got:
        assert r.p == next(n for n in range(max(2, r.id), 1000) if prime(n))
        assert r.q == next(1 << k for k in range(20) if 1 << k >= r.id) and r.b == (r.id != 0 and r.id & (r.id - 1) == 0)


def test_integer_functions_as_its_sql_beyond_its_trial_division(spark, tmp_path):
    import duckdb

    from seqweft.jobs.catalogue import ORACLE_SQL, QUERIES

    keys = [-500, -3, 0, 1, 2, 94_240, 94_247, 94_248, 94_249, 95_450, 95_477, 1_191_953, 1_191_995, 1_199_999, None]
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    of = lambda rows: {r[1]: r[-1] for r in rows}
    got = of(QUERIES["integer_functions"](spark, str(tmp_path)).collect())
    assert got == of(sql.sql(ORACLE_SQL["integer_functions"]).fetchall())
    assert got[7] == 94_249 and got[0] is None


def test_large_primes(spark):
    # numbers that pass the strong test for the first bases, squares of primes, and ends of the range
    ns = [2047, 1373653, 25326001, 3215031751, 999983**2, 1009 * 1013, 999_999_999_961, 2**31 - 1, 2**40 - 87, 2**40 - 200]
    prime = lambda n: n > 1 and n % 2 > 0 and all(n % d for d in range(3, int(n**0.5) + 1, 2))
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", numbers.prime_from(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [next(m for m in range(n, n + 400) if prime(m)) for n in ns]


def test_hops(spark):
    rng = random.Random(8)
    e = [(rng.randrange(15), rng.randrange(15), float(rng.randrange(1, 5))) for _ in range(22)]
    df = graphs.both_ways(spark.createDataFrame(e, "u long, v long, w double"))
    got = {(r.source, r.u): r.dist for r in graphs.hops(df, df.select("u").distinct()).collect()}
    near = {}
    for a, b, _ in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        want[s, s] = 0
        front, d = {s}, 0
        while front:
            d += 1
            front = {t for x in front for t in near[x] if (s, t) not in want}
            want |= {(s, t): d for t in front}
    assert got == want


def test_trees(spark):
    rng = random.Random(4)
    e = [(rng.randrange(i), i, 1.0) for i in range(1, 40)]
    df = graphs.both_ways(spark.createDataFrame(e, "u long, v long, w double"))
    dist = {(r.source, r.u): r.dist for r in graphs.hops(df, df.select("u").distinct()).collect()}
    ecc = {u: max(dist[u, v] for v in range(40)) for u in range(40)}
    leaves = [u for u in range(40) if sum(u in x[:2] for x in e) == 1]
    assert graphs.diameter(df).first()[0] == max(ecc.values())
    assert {(r.u, r.ecc) for r in graphs.tree_centers(df).collect()} == {(u, x) for u, x in ecc.items() if x == min(ecc.values())}
    assert {r.u: (r.dist, r.leaf) for r in graphs.nearest_leaf(df).collect()} == {u: min((dist[u, v], v) for v in leaves) for u in range(40)}
    assert graphs.diameter(df.limit(0)).first()[0] is None


def test_readers(spark, tmp_path):
    labels, d = trees.matrix([("b", "a", 1.5), ("c", "a", 2.0), ("c", "b", 0.25)])
    (tmp_path / "m.dmat").write_text(writers.dmat(labels, d))
    got = {(r.label_i, r.label_j): r.d for r in readers.read_dmat(spark, str(tmp_path / "m.dmat")).collect()}
    assert got == {("b", "a"): 1.5, ("c", "a"): 2.0, ("c", "b"): 0.25}
    (tmp_path / "g.txt").write_text("vertices: 3\ntype: u\nedge weights: y\n0 1 2.5\n1 2 1\n")
    assert {(r.u, r.v, r.w) for r in readers.read_graph(spark, str(tmp_path / "g.txt")).collect()} == {(0, 1, 2.5), (1, 0, 2.5), (1, 2, 1.0), (2, 1, 1.0)}
    (tmp_path / "d.col").write_text("c x\np edge 3 1\ne 1 3\n")
    assert {(r.u, r.v) for r in readers.read_dimacs(spark, str(tmp_path / "d.col")).collect()} == {(0, 2), (2, 0)}
    (tmp_path / "n.txt").write_text("1 2\n3 4.5\n")
    assert {(r.i, r.j, r.v) for r in readers.numbers(spark, str(tmp_path / "n.txt")).collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.5)}
    e = spark.createDataFrame([(0, 1, 0.5)], "u long, v long, w double")
    assert [r.line for r in writers.dot_lines(e).collect()] == ['"0" -- "1" [label="0.500"];']
    assert [r.line for r in writers.json_lines(e).collect()] == ['{"source":0,"target":1,"value":0.5}']


@pytest.mark.parametrize("weights", [{(0, 1): 1.0, (1, 2): -0.5, (2, 3): 2.0, (0, 3): 9.0}])
def test_shortest(spark, weights):
    df = spark.createDataFrame([(u, v, w) for (u, v), w in weights.items()], "u long, v long, w double")
    got = {(r.u, r.v): r.d for r in graphs.shortest(df).collect()}
    assert got[0, 3] == 2.5 and got[0, 2] == 0.5 and (3, 0) not in got


def test_shortest_from_sources_only(spark):
    e = graphs.both_ways(spark.createDataFrame([(0, 1, 1.0), (0, 1, 0.25), (1, 2, 1.0), (0, 2, 3.0), (7, 8, 1.0)], "u long, v long, w double"))
    some = spark.createDataFrame([(2,), (2,), (99,)], "u long")
    assert {tuple(r) for r in graphs.shortest(e, some).collect()} == {(2, 2, 0.0), (2, 1, 1.0), (2, 0, 1.25), (99, 99, 0.0)}
    assert graphs.shortest(e.where("u < 0")).count() == 0
