"""Diameters, parents, shortest paths of small weights, joining by relations, folded Newick."""

import random

import numpy as np
import pytest

from seqweft.operators import graphs, trees


def _graph(spark, edges):
    return graphs.both_ways(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double"))


def _all_hops(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        out[s], front, d = {s: 0}, {s}, 0
        while front:
            d += 1
            front = {t for x in front for t in near[x]} - out[s].keys()
            out[s] |= dict.fromkeys(front, d)
    return out


def _want(edges):
    hops = _all_hops(edges)
    out = {}
    for s, to in hops.items():
        c = min(to)
        out[c] = max(out.get(c, 0), max(to.values()))
    return out


CASES = {
    "two paths": [(0, 1), (10, 11), (11, 12), (12, 13)],
    "ring and tail": [(i, (i + 1) % 9) for i in range(9)] + [(0, 20), (20, 21)],
    "two rings": [(i, (i + 1) % 8) for i in range(8)] + [(30 + i, 30 + (i + 1) % 5) for i in range(5)],
    "grid": [(5 * y + x, 5 * y + x + 1) for y in range(4) for x in range(4)] + [(5 * y + x, 5 * y + x + 5) for y in range(3) for x in range(5)],
    "random": [(random.Random(k).randrange(24), random.Random(k + 1000).randrange(24)) for k in range(30)],
    "bipartite": [(s, 100 + random.Random(17 * s + k).randrange(40)) for s in range(8) for k in range(9)],
}


@pytest.mark.parametrize("name", CASES)
def test_diameters(spark, name):
    edges = [(a, b) for a, b in CASES[name] if a != b]
    g = _graph(spark, edges)
    want = _want(edges)
    assert {r.component: r.diameter for r in graphs.diameters(g).collect()} == want
    assert graphs.diameter(g).first()[0] == max(want.values())
    assert {r.u: r.component for r in graphs.components(g).collect()} == {u: min(to) for u, to in _all_hops(edges).items()}


def test_parents(spark):
    rng = random.Random(6)
    e = [(rng.randrange(i), i) for i in range(1, 30)]
    got = {r.u: (r.parent, r.dist, r.far) for r in graphs.hops(_graph(spark, e), spark.range(1).withColumnRenamed("id", "u"), "w", parents=True).collect()}
    up = {b: a for a, b in e}
    depth = {0: 0}
    for b in range(1, 30):
        depth[b] = depth[up[b]] + 1
    assert got == {u: (up.get(u), d, float(d)) for u, d in depth.items()}


def test_shortest_paths_of_small_and_of_large_weights(spark):
    for scale in (1e-10, 1.0, 1e12):
        edges = [(i, i + 1, scale) for i in range(5)] + [(0, 5, 10 * scale), (1, 4, 10 * scale)]
        df = spark.createDataFrame(edges, "u long, v long, w double")
        got = {(r.u, r.v): r.d for r in graphs.shortest(df).collect()}
        assert got[0, 5] == pytest.approx(5 * scale, rel=1e-12) and got[1, 4] == pytest.approx(3 * scale, rel=1e-12)


def test_joining_by_relations_is_joining_of_a_matrix(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for key, n in (("two", 2), ("three", 3), ("four", 4), ("seven", 7), ("ties", 6)):
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                d[i, j] = d[j, i] = 1.0 if key == "ties" else round(rng.uniform(1, 9), 6)
                rows.append((key, f"t{j}", f"t{i}", float(d[i, j])))
        want[key] = {(u, v): w for u, v, w in trees.join_neighbours(d)}
    got = {}
    for r in trees.joined(spark.createDataFrame(rows, "key string, i string, j string, d double"), "key", "d").collect():
        got.setdefault(r.key, {})[r.u, r.v] = r.w
        assert r.label == (f"t{r.v}" if r.v < {"two": 2, "three": 3, "four": 4, "seven": 7, "ties": 6}[r.key] else None)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key].keys() == want[key].keys()
        assert all(got[key][k] == pytest.approx(w, abs=1e-9) for k, w in want[key].items())


def test_paths_between_taxa(spark):
    d = np.array([[0, 3.0, 5, 6], [3, 0, 6, 7], [5, 6, 0, 5], [6, 7, 5, 0]])
    rows = [("k", f"t{j}", f"t{i}", float(d[i, j])) for i in range(4) for j in range(i)] + [("two", "a", "b", 2.5)]
    tree = trees.joined(spark.createDataFrame(rows, "key string, i string, j string, d double"), "key", "d")
    got = {(r.key, r.i, r.j): r.d for r in trees.paths_between(tree, "key").collect()}
    assert {(i, j): got["k", i, j] for i in range(4) for j in range(4)} == pytest.approx({(i, j): d[i, j] for i in range(4) for j in range(4)})
    assert got["two", 0, 1] == 2.5 and len(got) == 20


def test_folded_newick(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 10, 0.5), (1, 3, 0.2), (3, 4, 1.5)], "u long, v long, w double")
    root = spark.createDataFrame([(0,), (3,)], "u long")
    got = {r.source: r.newick for r in trees.folded(graphs.both_ways(e), root).collect()}
    assert got[0] == "(((4:1.5)3:0.2,10:0.5)1:1.0,2:2.0)0:0.0;"
    assert got[3].count("(") == 3 and got[3].endswith(")3:0.0;")
    alone = trees.folded(spark.createDataFrame([], "u long, v long, w double"), root).collect()
    assert {r.source: r.newick for r in alone} == {0: "0:0.0;", 3: "3:0.0;"}


def test_diameters_search_from_few_vertices_where_many_lie_on_the_fringe(spark, monkeypatch):
    rng = random.Random(5)
    edges = sorted({(s, 100 + p) for p in range(300) for s in rng.sample(range(20), 4)})
    searched = []
    for name in ("hops", "eccentricities"):
        monkeypatch.setattr(graphs, name, lambda e, sources, *more, of=getattr(graphs, name): (searched.append(sources.count()), of(e, sources, *more))[1])
    assert graphs.diameter(_graph(spark, edges)).first()[0] == max(_want(edges).values())
    assert sum(searched) <= 4 + 20


def test_eccentricities(spark, monkeypatch):
    monkeypatch.setattr(graphs, "_PASS", 1100)
    rng = random.Random(8)
    edges = [(rng.randrange(i), i) for i in range(1, 90)] + [(1000 + i, 1001 + i) for i in range(3)]
    away = [(5000 + i, 5001 + i) for i in range(0, 4000, 2)]  # more sources than a pass and a row hold
    links = _graph(spark, edges + away).select("u", "v")
    sources = [7, 50, 61, 1001, *(a for a, _ in away)]
    got = {r.u: r.far for r in graphs.eccentricities(links, spark.createDataFrame([(u,) for u in sources], "u long")).collect()}
    want = {}
    for s, to in _all_hops(edges + away).items():
        own = [to[x] for x in sources if x in to]
        want |= {s: max(own)} if own else {}
    assert got == want


@pytest.mark.parametrize("weighted", [False, True])
def test_leaves_follow_from_what_they_hang_on(spark, monkeypatch, weighted):
    rows = []
    keep = lambda df, name="part": (lambda t: (rows.append(t.count()), t)[1])(stored(df, name))
    stored = graphs.stored
    monkeypatch.setattr(graphs, "stored", keep)
    edges = [(0, 1), (1, 2)] + [(i % 3, 10 + i) for i in range(60)] + [(200, 201), (300, 300)]
    g = _graph(spark, edges)
    sources = spark.createDataFrame([(u,) for u in [2, *range(10, 70), 201, 300, 400]], "u long")
    want = {(s, u): d for s, to in _all_hops(edges).items() for u, d in to.items()} | {(400, 400): 0}
    want = {k: d for k, d in want.items() if k[0] not in (0, 1, 200)}
    if weighted:
        got = [((r.u, r.v), r.d) for r in graphs.shortest(g, sources).collect()]
    else:
        found = graphs.hops(g, sources, "w", parents=True).collect()
        got = [((r.source, r.u), r.dist) for r in found]
        assert all(r.far == r.dist and (r.parent is None) == (r.source == r.u) for r in found)
        assert all(r.parent is None or want[r.source, r.parent] == r.dist - 1 for r in found)
    assert len(got) == len(want) and dict(got) == want
    assert max(rows) < 300  # of 4,096 that are returned


def _places_of(spark, path, customers=120):
    spark.createDataFrame([(r,) for r in range(2)], "r_regionkey int").write.parquet(f"{path}/region.parquet")
    spark.createDataFrame([(n, n % 2) for n in range(5)], "n_nationkey int, n_regionkey int").write.parquet(f"{path}/nation.parquet")
    spark.createDataFrame([(c, c % 4) for c in range(customers)], "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    edges = [(0, 1 + r, 1.0) for r in range(2)] + [(1 + n % 2, 100 + n, 2.0) for n in range(5)] + [(100 + c % 4, 1000 + c, 0.5) for c in range(customers)]
    return edges, 1 + 2 + 5 + customers


def _rows_of_sql(path, query):
    import duckdb

    from seqweft.jobs.catalogue import ORACLE_SQL

    sql = duckdb.connect()
    for t in ("region", "nation", "customer"):
        sql.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return sorted(sql.sql(ORACLE_SQL[query]).fetchall())


def test_hops_of_all_pairs(spark, tmp_path, monkeypatch):
    from seqweft.jobs.catalogue import QUERIES

    monkeypatch.setattr(graphs, "_BLOCK", 40)  # several blocks of sources
    edges, n = _places_of(spark, str(tmp_path))
    want = [(s, u, d) for s, to in _all_hops([e[:2] for e in edges]).items() for u, d in to.items()]
    got = sorted(map(tuple, QUERIES["all_pairs_hops"](spark, str(tmp_path)).collect()))
    assert len(got) == n * n and got == sorted(want) == _rows_of_sql(tmp_path, "all_pairs_hops")


def test_shortest_paths_of_all_pairs(spark, tmp_path, monkeypatch):
    from seqweft.jobs.catalogue import QUERIES

    monkeypatch.setattr(graphs, "_BLOCK", 40)  # several blocks of sources
    _, n = _places_of(spark, str(tmp_path), customers=90)
    got = sorted(map(tuple, QUERIES["apsp"](spark, str(tmp_path)).collect()))
    assert len(got) == n * n and got == _rows_of_sql(tmp_path, "apsp")


def _many(seed):
    """All cases and random graphs as components of one graph."""
    rng, edges = random.Random(seed), []
    cases = [*CASES.values(), [(i, i + 1) for i in range(12)], [(0, k) for k in range(1, 9)]]
    cases += [[(rng.randrange(m), rng.randrange(m)) for _ in range(int(m * rng.uniform(0.8, 2.5)))] for m in [6, 12, 20, 40, 70, 90] * 4]
    for i, case in enumerate(cases):
        edges += [(1000 * i + a, 1000 * i + b) for a, b in case if a != b]
    return edges


@pytest.mark.parametrize("most", [1 << 23, 0])
def test_diameters_in_memory_and_by_rows(spark, monkeypatch, most):
    monkeypatch.setattr(graphs.packed, "MOST", most)
    monkeypatch.setattr(graphs.packed, "_PIECE", 50)
    edges = _many(3) if most else _many(3)[:150]
    got = {r.component: r.diameter for r in graphs.diameters(_graph(spark, edges + [(99_999_999, 99_999_999)])).collect()}
    assert got == _want(edges) | {99_999_999: 0}


def test_searches_of_a_dense_graph_shuffle_no_bits(spark, monkeypatch):
    monkeypatch.setattr(graphs, "eccentricities", lambda *_: pytest.fail("bits of searches as rows"))
    rng = random.Random(2)
    edges = sorted({(1000 * c + s, 1000 * c + 100 + p) for c in range(3) for p in range(200) for s in rng.sample(range(30), 3)})
    assert {r.component: r.diameter for r in graphs.diameters(_graph(spark, edges)).collect()} == _want(edges)


def test_vertices_are_settled_by_several_hubs(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(graphs.packed, "_search", lambda *args, of=graphs.packed._search, **more: (searched.append(len(args[-1])), of(*args, **more))[1])
    rng = random.Random(1)
    edges = sorted({(s, 90 + p) for p in range(900) for s in rng.sample(range(90), 5)})
    assert {r.component: r.diameter for r in graphs.diameters(_graph(spark, edges)).collect()} == _want(edges)
    # of 990 vertices; one hub doesn't settle those it is named by, since it is as far from something as the diameter
    assert len(searched) > 1 and sum(searched) < 120
