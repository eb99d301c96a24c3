"""Steps that work on numbers within tasks, against plain ones."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqweft.operators import contexts, edges, graphs


@pytest.mark.parametrize("k", [1, 3, 8])
def test_windows_counted_within_tasks_equal_counted_rows(spark, k, monkeypatch):
    monkeypatch.setattr(edges, "COUNTED", 7)  # blocks end within sequences
    rows = [("a", "ACGTACGTACGTTTGACGTACGTA"), ("a", ""), ("b", "ACGTACGT"), ("a", "ACGTACG"), (None, "CCCCCCCCCCCC"), ("b", None), ("b", "A"), ("b", "ACGTACGTA")]
    batch = pa.record_batch([pa.array([c for c, _ in rows], pa.string()), pa.array([s or "" for _, s in rows])], ["color", "seq"])
    got: dict = {}
    for found in edges.counted_windows(iter([batch, batch.slice(1, 6)]), k):
        for r in found.to_pylist():
            key = r["color"], r["kmer"], r["W"]
            got[key] = got.get(key, 0) + r["n"]
    want: dict = {}
    for c, s in rows + rows[1:7]:
        for i in range(len(s or "") - k + 1):
            key = c, s[i : i + k], s[i + k : i + k + 1] or "$"
            want[key] = want.get(key, 0) + 1
    assert got == want
    df = spark.createDataFrame(rows, "color string, seq string")
    plain = edges.contexts(df, k).groupBy("color", "kmer", "W").agg(F.count("*").alias("coverage"))
    assert sorted(map(str, edges.edges(df, k).collect())) == sorted(map(str, plain.collect()))


def _plain_cliques(near: dict[int, set[int]]) -> list[str]:
    found, open_ = set(), [frozenset([v]) for v in near]
    while open_:
        c = open_.pop()
        more = set.intersection(*(near[v] for v in c)) - c
        if not more:
            found.add(",".join(map(str, sorted(c))))
        open_ += {c | {v} for v in more if v > max(c)}
    return sorted(found)


def test_cliques_by_bits_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(min(a, b)) * 7, int(max(a, b)) * 7) for a, b in rng.integers(0, 24, (150, 2)) if a != b} | {(1000, 1001)}
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = graphs.maximal_cliques(graphs.both_ways(spark.createDataFrame(sorted(pairs), "u long, v long"))).collect()
    assert sorted(r.clique for r in got) == _plain_cliques(near)
    # a vertex without later neighbours has a clique only if none came before
    none = np.zeros(0, np.int64)
    assert graphs._cliques_of(5, none, none, none, none) == [[5]]
    assert graphs._cliques_of(5, none, np.array([1]), none, none) == []
    # an earlier neighbour that is joined with a later one stands against its clique alone
    assert graphs._cliques_of(5, np.array([7, 9]), np.array([3, 4]), np.array([3]), np.array([7])) == [[5, 9]]


def _plain_order(rows: list[tuple[str, int, str]]) -> list[tuple]:
    every = sorted((s[:e][::-1], c, i, e, s[e : e + 1] or "$") for c, i, s in rows for e in range(len(s) + 1))
    out = []
    for rank, (r, c, _, e, w) in enumerate(every):
        last = every[rank - 1][0] if rank else ""
        out.append((rank, w, len(os.path.commonprefix([r, last])), e + 1, c))
    return out


def test_contexts_that_share_little_are_ranked_once(spark, monkeypatch):
    calls = []
    ranked = contexts._ranked
    monkeypatch.setattr(contexts, "_ranked", lambda rows, keys, rank: (calls.append(rank), ranked(rows, keys, rank))[1])
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    some = text(20)
    rows = [("x", 1, text(40) + some + text(30)), ("y", 2, text(25) + some + text(9)), ("x", 3, "")]
    df = lambda rows: spark.createDataFrame([(c, i, s) for c, i, s in rows], "color string, i int, seq string")
    assert sorted(map(tuple, contexts.context_order(df(rows), ["i"]).collect())) == _plain_order(rows)
    assert calls == ["first"]
    # copies, parts of copies behind other symbols, and long repeats within a sequence
    long = text(150)
    rows += [("x", 4, long), ("y", 5, long), ("y", 6, text(3) + long[10:] + "A"), ("x", 7, "AC" * 60), ("y", 8, "C" + "AC" * 50), ("x", 9, long[:90] + text(40))]
    assert sorted(map(tuple, contexts.context_order(df(rows), ["i"]).collect())) == _plain_order(rows)
    assert len(calls) > 3
