"""Toy collections with values worked out by hand, brute-force runs, and properties."""

import math
import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from seqweft.jobs.compare import compare_directory, compare_sequences
from seqweft.operators import bwsd, edges

READS = {"reads1": ["TACTCA", "TACACT", "ACTC", "ACTC", "ACTC"], "reads2": ["GACTCG", "ACTC", "ACTC"], "reads3": ["TACACT", "TCATCA", "GACTCG"]}


def frame(spark, reads):
    return spark.createDataFrame([(c, s) for c, seqs in reads.items() for s in seqs], "color string, seq string")


def brute(reads, k, coverage=False):
    count = Counter()
    for c, seqs in reads.items():
        for s in seqs:
            for p in range(len(s) - k + 1):
                count[s[p : p + k][::-1], s[p + k : p + k + 1] or "$", c] += 1
    out = {}
    names = sorted(reads)
    for a, i in enumerate(names):
        for j in names[a + 1 :]:
            rows = sorted(x for x in count if x[2] in (i, j))
            hist = Counter()
            run = []
            for (r, w), group in groupby(rows, key=lambda x: x[:2]):
                group = list(group)
                n = [count[g] for g in group]
                if coverage and len(group) == 2 and max(n) > 1:
                    hist.update(len(list(g)) for _, g in groupby(run))
                    run = []
                    hist[1] += 2 * min(n)
                    if n[0] != n[1]:
                        hist[abs(n[0] - n[1])] += 1
                else:
                    run += [g[2] for g in group]
            hist.update(len(list(g)) for _, g in groupby(run))
            s = sum(hist.values())
            e = sum(n * t for n, t in hist.items()) / s - 1 if s else -1.0
            h = -sum(t / s * math.log2(t / s) for t in hist.values()) if s else 0.0
            out[i, j] = (s, e, h)
    return out


def test_edge_table(spark):
    got = {(r.kmer, r.W, r.color): r.coverage for r in edges.edges(frame(spark, READS), 3).collect()}
    assert got["ACT", "C", "reads1"] == 4 and got["ACT", "C", "reads2"] == 3 and got["CTC", "$", "reads1"] == 3
    assert Counter(c for *_, c in got) == {"reads1": 9, "reads2": 5, "reads3": 12}
    assert {r.color: (r.n_edges, r.n_cov) for r in edges.colour_totals(edges.edges(frame(spark, READS), 3)).collect()} == {"reads1": (9, 14), "reads2": (5, 8), "reads3": (12, 12)}


@pytest.mark.parametrize(("coverage", "expected"), [
    (False, {("reads1", "reads2"): (8, 0.75, 1.5), ("reads1", "reads3"): (16, 0.3125, 1.014098), ("reads2", "reads3"): (9, 0.888889, 1.657743)}),
    (True, {("reads1", "reads2"): (18, 0.222222, 0.803072)}),
])
def test_toy_similarity(spark, coverage, expected):
    got = {(r.i, r.j): (r.s, r.expectation, r.entropy) for r in compare_sequences(frame(spark, READS), 3, coverage).collect()}
    for pair, values in expected.items():
        assert got[pair] == pytest.approx(values, abs=1e-6)


@pytest.mark.parametrize("coverage", [False, True])
@pytest.mark.parametrize("k", [3, 6])
def test_against_brute_force(spark, coverage, k):
    rng = random.Random(k)
    reads = {c: ["".join(rng.choice("ACGT") for _ in range(rng.choice([k - 1, k, k + 1, 40, 700]))) for _ in range(6)] for c in "abcd"}
    reads["d"] += reads["a"][:3] * 2
    got = {(r.i, r.j): (r.s, r.expectation, r.entropy) for r in compare_sequences(frame(spark, reads), k, coverage).collect()}
    want = brute(reads, k, coverage)
    assert got.keys() == want.keys()
    for pair in want:
        assert got[pair] == pytest.approx(want[pair], abs=2e-6)


def test_properties(spark):
    same = compare_sequences(frame(spark, {"a": ["ACGTACGGT"], "b": ["ACGTACGGT"]}), 3).first()
    assert (same.expectation, same.entropy) == (0.0, 0.0)
    short = compare_sequences(frame(spark, {"a": ["AC"], "b": ["GT"], "c": ["ACGT"], "d": ["ACGG"]}), 3).collect()
    assert [(r.i, r.j) for r in short] == [("c", "d")]  # colours without a full context have no edges
    pair = spark.createDataFrame([("a", "b")], "i string, j string")
    none = bwsd.similarity(edges.edges(frame(spark, {"a": ["AC"], "b": ["GT"]}), 3), pair=pair).first()
    assert (none.s, none.expectation, none.entropy) == (0, -1.0, 0.0)


def test_long_sequences_are_cut_alike(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(3 * edges.STRETCH + 5))
    for k in (1, 5, 32):
        for n in (k - 1, k, edges.STRETCH, edges.STRETCH + k - 1, edges.STRETCH + k, len(s)):
            got = Counter((r.kmer, r.W) for r in edges.contexts(spark.createDataFrame([("a", s[:n])], "color string, seq string"), k).collect())
            assert got == Counter((s[p : p + k], s[:n][p + k : p + k + 1] or "$") for p in range(n - k + 1))


def test_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "ACGT"), ("b", "")], "lang string, text string")
    assert edges.edges(edges.sequences(df, "lang", "text"), 3).count() == 0


def test_directory(spark, tmp_path):
    for name, reads in READS.items():
        lines = [x for i, s in enumerate(reads) for x in (f"@r{i} toy", s, "+", "#" * 6)]
        (tmp_path / f"{name}.fastq").write_text("\n".join(lines))
    out = compare_directory(spark, str(tmp_path), 3)
    assert out.labels == ["reads1", "reads2", "reads3"]
    assert out.expectation.splitlines()[5:7] == ["0.750000", "0.312500\t0.888889"]
    assert out.expectation_tree.startswith("(reads3:2.2569") and out.expectation_tree.endswith(":0.00;")
    fasta = tmp_path / "fasta"
    fasta.mkdir()
    for name, reads in READS.items():
        (fasta / f"{name}.fasta").write_text("".join(f">r{i} toy > x\n{s[:2]}\n{s[2:]}\n" for i, s in enumerate(reads)))
    assert compare_directory(spark, str(fasta), 3) == out


def test_files_with_like_names_stay_apart(spark, tmp_path):
    (tmp_path / "x.1.fasta").write_text(">a\nACGTACGT\n")
    (tmp_path / "x.2.fasta").write_text(">a\nTTGTACGA\n")
    (tmp_path / "x.1.fastq").write_text("@a\nGGGTACGA\n+\n########")
    assert compare_directory(spark, str(tmp_path), 3).labels == ["x.1.fasta", "x.1.fastq", "x.2.fasta"]


def test_symbols_of_several_bytes(spark):
    """Sequences over a large alphabet give the edges of the same sequence over letters."""
    plain, wide = "ABCABDABC" * 60, "甲乙丙甲乙丁甲乙丙" * 60
    back = str.maketrans("甲乙丙丁", "ABCD")
    a, b = (edges.edges(spark.createDataFrame([("c", s)], "color string, seq string"), 3, wide=w).collect() for s, w in ((plain, False), (wide, True)))
    assert sorted((r.kmer, r.W, r.coverage) for r in a) == sorted((r.kmer.translate(back), r.W.translate(back), r.coverage) for r in b)


def test_more_event_types_than_letters(spark, tmp_path):
    import datetime

    from seqweft.jobs.catalogue import _event_edges

    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 40 + i, start + datetime.timedelta(seconds=i), u, f"t{(i * 7 + u) % 40:02d}") for u in range(8) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert _event_edges(spark, str(tmp_path), 3).agg({"coverage": "sum"}).first()[0] == 8 * 38


def test_vector_distances_by_packed_rows(spark):
    import math

    from seqweft.functions import vectors

    rows = [(i, [math.sin(i * (k + 1)) for k in range(5)]) for i in range(0, 60)]
    rows += [(100, [0.0] * 5), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0]), (150, [1.0, 2.0]), (None, [1.0] * 5), (103, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plain = df.alias("q").crossJoin(df.alias("v")).where("q.vec_id % 50 = 0 and q.vec_id <> v.vec_id")
    want = plain.selectExpr("q.vec_id", "v.vec_id", "q.embedding", "v.embedding").toDF("q", "v", "x", "y")
    from pyspark.sql import functions as F

    want = want.select("q", "v", F.round(vectors.cosine_distance(F.col("x"), F.col("y")), 6), F.round(vectors.euclidean_distance(F.col("x"), F.col("y")), 6))
    found = vectors.to_queries(df, block=7)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # a pair of vectors is no row before it is one of the result
    assert "explode" not in found._jdf.queryExecution().toString().lower()
