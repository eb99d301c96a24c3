"""The whole comparison: collections to matrices, trees and files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from seqweft.operators import bwsd, trees
from seqweft.operators.edges import edges
from seqweft.sources.readers import read_collections
from seqweft.sources.writers import dmat


@dataclass
class Comparison:
    labels: list[str]
    expectation: str
    entropy: str
    expectation_tree: str
    entropy_tree: str

    def write(self, spark: SparkSession, path: str) -> None:
        """Two matrices and two trees below `path`, each a text: expectation.dmat, entropy.dmat and the same as .nhx."""
        for name, text in (("expectation.dmat", self.expectation), ("entropy.dmat", self.entropy), ("expectation.nhx", self.expectation_tree), ("entropy.nhx", self.entropy_tree)):
            spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/{name}")


def compare_sequences(seqs: DataFrame, k: int = 32, coverage: bool = False) -> DataFrame:
    """(i, j, s, expectation, entropy) of all pairs of colours of (color, seq)."""
    return bwsd.similarity(edges(seqs, k), coverage)


def _short(names: list[str]) -> list[str]:
    """File names without their ending, or whole where two would be alike."""
    short = [re.sub(r"\.fast[aq]$", "", x) for x in names]
    return short if len(set(short)) == len(short) else names


def compare_directory(spark: SparkSession, path: str, k: int = 32, coverage: bool = False) -> Comparison:
    """Distance matrices and trees of the FASTA and FASTQ files of a directory; one row for each pair is collected."""
    return _compared(read_collections(spark, path), k, coverage)


def compare_files(spark: SparkSession, one: str, other: str, k: int = 32, coverage: bool = False) -> Comparison:
    """As compare_directory, of two files."""
    return _compared(read_collections(spark, [one, other]), k, coverage)


def _compared(found: DataFrame, k: int, coverage: bool) -> Comparison:
    seqs = found.selectExpr("genome as color", "seq")
    table, out = edges(seqs, k).persist(), []
    try:
        rows = bwsd.similarity(table, coverage).collect()
    finally:
        table.unpersist()
    for value in ("expectation", "entropy"):
        labels, d = trees.matrix([(r["i"], r["j"], r[value]) for r in rows])
        labels = _short(labels)
        out.append((labels, dmat(labels, d), trees.newick(trees.join_neighbours(d), labels)))
    return Comparison(out[0][0], out[0][1], out[1][1], out[0][2], out[1][2])
