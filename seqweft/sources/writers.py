"""Text forms of matrices, trees and graphs. Matrices and trees have a row for each pair of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dmat(labels: list[str], d, places: int = 6) -> str:
    """[size], [labels] and the lower triangle."""
    rows = ["\t".join(f"{d[i][j]:.{places}f}" for j in range(i)) for i in range(1, len(labels))]
    return "\n".join([f"[size]\n{len(labels)}", "[labels]", " ".join(labels), "[distances]", *rows, ""])


def dot_lines(e: DataFrame, directed: bool = False) -> DataFrame:
    """(line): the edges of a graph (u, v, w) for GraphViz; undirected ones once."""
    sign = "->" if directed else "--"
    own = e if directed else e.where("u < v")
    return own.select(F.format_string(f'"%s" {sign} "%s" [label="%.3f"];', F.col("u").cast("string"), F.col("v").cast("string"), F.col("w").cast("double")).alias("line"))


def dot(lines: list[str], directed: bool = False) -> str:
    return ("digraph" if directed else "graph") + " {\n" + "\n".join(lines) + "\n}\n"


def dot_nodes(vertices: DataFrame, images: bool = False) -> DataFrame:
    """(line): vertices (u, label, flag[, image]) for GraphViz: grey where flagged, circles where no label has more than
    three characters and boxes otherwise, or with their pictures. Without a label the number stands."""
    name = F.coalesce("label", F.col("u").cast("string"))
    most = vertices.agg(F.max(F.length(name)).alias("most"))  # one row
    own = vertices.crossJoin(F.broadcast(most))
    shape = F.when(F.col("most") <= 3, F.lit("circle")).otherwise(F.lit("box"))
    look = F.concat(F.lit('shape="none", image="'), F.col("image"), F.lit('"')) if images else F.concat(F.lit('shape="'), shape, F.lit('"'))
    grey = F.when(F.coalesce("flag", F.lit(False)), F.lit(', style="filled", fillcolor="grey"')).otherwise(F.lit(""))
    return own.select(F.concat(F.lit('"'), F.col("u").cast("string"), F.lit('" [label="'), name, F.lit('", '), look, grey, F.lit("];")).alias("line"))


def json_nodes(vertices: DataFrame) -> DataFrame:
    """(line): vertices (u, label) as JSON."""
    return vertices.select(F.to_json(F.struct(F.col("u").alias("id"), F.coalesce("label", F.col("u").cast("string")).alias("label"))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """(line) as text files, one part for each task."""
    lines.select(F.col("line").alias("value")).write.text(path)


def json_lines(e: DataFrame) -> DataFrame:
    """(line): each edge as JSON."""
    return e.select(F.to_json(F.struct(F.col("u").alias("source"), F.col("v").alias("target"), F.col("w").alias("value"))).alias("line"))


def write_fastq(seqs: DataFrame, path: str) -> None:
    """(id, seq) as FASTQ files with the quality that stands for none."""
    seqs.select(F.concat(F.lit("@"), F.col("id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("#"), F.length("seq"))).alias("value")).write.text(path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    """(id, seq) as FASTA files with one line a sequence."""
    seqs.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)
