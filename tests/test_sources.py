"""Readers of sequences with malformed files and like names, the edge store, matrices, outputs of a comparison."""

import random

import pytest
from pyspark.sql import functions as F

from seqweft.jobs.compare import compare_directory, compare_files, compare_sequences
from seqweft.operators import edges
from seqweft.sources import readers, store, writers


def test_like_names_in_two_folders_stay_apart(spark, tmp_path):
    for folder, seq in (("a", "ACGTACGTTTGA"), ("b", "TTGTACGATTGA")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "g.fasta").write_text(f">x\n{seq}\n")
    got = compare_files(spark, str(tmp_path / "a/g.fasta"), str(tmp_path / "b/g.fasta"), 3)
    assert got.labels == ["a/g", "b/g"] and got.expectation_tree.startswith("(a/g,b/g):")
    seqs = spark.createDataFrame([("a", "ACGTACGTTTGA"), ("b", "TTGTACGATTGA")], "color string, seq string")
    row = compare_sequences(seqs, 3).first()
    assert got.expectation.splitlines()[-1] == f"{row.expectation:.6f}"
    assert readers._tails(["file:///x/a/g", "file:///y/a/g", "file:///y/h"]) == {"/x/a/g": "x/a/g", "/y/a/g": "y/a/g"}


def test_comparison_is_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, seq in (("a", "ACGTACGTTTGA"), ("b", "TTGTACGATTGA"), ("c", "GGGTACGATT")):
        (tmp_path / f"in/{name}.fasta").write_text(f">x\n{seq}\n")
    got = compare_directory(spark, str(tmp_path / "in"), 3)
    got.write(spark, str(tmp_path / "out"))
    assert {r.d for r in readers.read_dmat(spark, str(tmp_path / "out/entropy.dmat")).collect()} == {float(x) for line in got.entropy.splitlines()[5:] for x in line.split()}
    assert spark.read.text(str(tmp_path / "out/expectation.nhx")).first()[0] == got.expectation_tree


def _fastq(records, blank=0):
    return "\n".join(x for i, (s, q) in enumerate(records) for x in (f"@r{i} note", s, "+", q, *[""] * blank))


def test_blank_lines_and_empty_sequences(spark, tmp_path):
    records = [("ACGT", "####"), ("", ""), ("GG", "@@"), ("TTT", "+++"), ("AC", "@+")]
    for blank in (0, 1, 3):
        path = tmp_path / f"x{blank}.fastq"
        path.write_text("\n" * blank + _fastq(records, blank) + "\n")
        got = readers.read_fastq(spark, str(path)).orderBy("rec").collect()
        assert [(r.id, r.desc, r.seq) for r in got] == [(f"r{i}", "note", s) for i, (s, _) in enumerate(records)]
        assert readers.fastq_errors(spark, str(path)).count() == 0


def test_malformed_lines_are_reported(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("stray\n@a\nAC\n+\n##\n@cut\nGG\n@b\nTT\n+\n##\n@end\nA")
    got = readers.read_fastq(spark, str(tmp_path), mode="report").orderBy("rec").collect()
    assert [(r.id, r.seq) for r in got] == [("a", "AC"), ("b", "TT")]
    assert [(r.line, r.value) for r in readers.fastq_errors(spark, str(tmp_path)).orderBy("line").collect()] == [(0, "stray"), (5, "@cut"), (6, "GG"), (11, "@end"), (12, "A")]
    with pytest.raises(Exception, match="malformed line"):
        readers.read_fastq(spark, str(tmp_path)).count()
    (tmp_path / "y.fasta").write_text("before\n>a b > c\nAC\nGT\n>d\n")
    assert [(r.id, r.seq) for r in readers.read_fasta(spark, str(tmp_path), mode="report").orderBy("rec").collect()] == [("a", "ACGT"), ("d", "")]
    assert [r.value for r in readers.fasta_errors(spark, str(tmp_path)).collect()] == ["before"]
    with pytest.raises(Exception, match="malformed line"):
        readers.read_fasta(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="mode"):
        readers.read_fasta(spark, str(tmp_path), mode="lenient")


def test_records_over_groups_and_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    records = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))), "#" * rng.randint(1, 9)) for _ in range(300)]
    (tmp_path / "x.fastq").write_text(_fastq(records))
    monkeypatch.setattr(readers, "_GROUP", 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = readers.read_fastq(spark, str(tmp_path)).orderBy("rec").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.id, r.seq) for r in got] == [(f"r{i}", s) for i, (s, _) in enumerate(records)]


@pytest.mark.parametrize("coverage", [False, True])
def test_store_gives_what_a_full_run_gives(spark, tmp_path, capsys, coverage):
    rng = random.Random(3)
    rows = [(c, "".join(rng.choice("ACGT") for _ in range(300))) for c in "0123" for _ in range(2)]
    rows += [("3", rows[0][1]), ("3", rows[0][1])]
    seqs = spark.createDataFrame(rows, "color string, seq string")
    path = str(tmp_path / "store")
    for part in ("color = '0'", "color = '1'", "color = '2'"):
        store.add(path, edges.edges(seqs.where(part), 4), 4)
    whole = {(r.i, r.j): tuple(r) for r in compare_sequences(seqs, 4, coverage).collect()}
    got = {(r.i, r.j): tuple(r) for r in store.compare_with(spark, path, seqs.where("color = '3'"), 4, coverage).collect()}
    assert got == {k: v for k, v in whole.items() if "3" in k}
    one = store.read(spark, path, 4, ["1"])
    assert one.select("color").distinct().collect() == [("1",)]
    one.explain("formatted")  # folders of other colours aren't read
    assert any("color" in line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters"))
    store.add(path, edges.edges(seqs.where("color = '1'"), 4), 4)
    twice = edges.edges(seqs.where("color = '1'"), 4).agg(F.sum("coverage")).first()[0] * 2
    assert store.read(spark, path, 4, ["1"]).agg(F.sum("coverage")).first()[0] == twice


def test_triangles_and_nodes(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\n2 3\n\n4 5 6\n")
    assert {(r.i, r.j): r.v for r in readers.read_triangle(spark, str(tmp_path / "t.txt")).collect()} == {(1, 0): 1, (2, 0): 2, (2, 1): 3, (3, 0): 4, (3, 1): 5, (3, 2): 6}
    with_diagonal = {(r.i, r.j): r.v for r in readers.read_symmetric(spark, str(tmp_path / "t.txt"), diagonal=True).collect()}
    assert with_diagonal == {(0, 0): 1, (1, 0): 2, (0, 1): 2, (1, 1): 3, (2, 0): 4, (0, 2): 4, (2, 1): 5, (1, 2): 5, (2, 2): 6}
    assert {(r.i, r.j): r.v for r in readers.read_symmetric(spark, str(tmp_path / "t.txt")).collect()}[0, 3] == 4
    v = spark.createDataFrame([(0, "abc", True), (1, None, False)], "u long, label string, flag boolean")
    assert [r.line for r in writers.dot_nodes(v).orderBy("line").collect()] == ['"0" [label="abc", shape="circle", style="filled", fillcolor="grey"];', '"1" [label="1", shape="circle"];']
    assert [r.line for r in writers.dot_nodes(v.withColumn("image", F.lit("x.png")), images=True).orderBy("line").collect()][1] == '"1" [label="1", shape="none", image="x.png"];'
    assert [r.line for r in writers.json_nodes(v).orderBy("line").collect()] == ['{"id":0,"label":"abc"}', '{"id":1,"label":"1"}']
    writers.write_lines(writers.json_nodes(v), str(tmp_path / "nodes"))
    assert spark.read.json(str(tmp_path / "nodes")).count() == 2
