"""Readers of sequence files, matrices and graphs, all through Spark's text source."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines that a task looks at together where records are told from what is around them.
_GROUP = 4096


def _tails(files: list[str]) -> dict[str, str]:
    """Paths of files whose name occurs more than once, by as many last parts as tell them apart."""
    parts = {re.sub(r"^[A-Za-z][\w+.-]*:/+", "/", f): None for f in files}
    out, depth = {}, 1
    left = {f: f.split("/") for f in parts}
    while left:
        names = Counter("/".join(x[-depth:]) for x in left.values())
        for f, x in list(left.items()):
            name = "/".join(x[-depth:])
            if names[name] == 1 or depth >= len(x):
                out[f] = name
                del left[f]
        depth += 1
    return {f: name for f, name in out.items() if "/" in name}


def _numbered(part: DataFrame) -> DataFrame:
    """Adds `line`, the number of each row within its file, from 0, to (genome, block, nr, ..).

    Rows are numbered within the block of a file that one task reads; only one row for each block is ordered by file.
    """
    inner = Window.partitionBy("genome", "block").orderBy("nr")
    sizes = part.groupBy("genome", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("genome").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select("genome", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return part.join(skips, ["genome", "block"]).withColumn("line", F.col("skip") + F.row_number().over(inner) - 1).drop("skip")


def _pieces(spark: SparkSession, path: str | list[str], glob: str, **options) -> DataFrame:
    """(genome, block, nr, value): pieces of files in the order of the file within each block. A collection's name is its
    file's; where files in several folders have one name, as much of their paths as tells them apart goes before it."""
    raw = spark.read.text(path, pathGlobFilter=glob, **options)
    place = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][\w+.-]*:/+", "/")
    genome, tails = F.element_at(F.split(place, "/"), -1), _tails(raw.inputFiles())
    if tails:
        genome = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in tails.items() for x in pair]), place), genome)
    return raw.select(genome.alias("genome"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"), "value")


def _fastq_lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(genome, line, value, seq, is_head, known): every line, whether a record begins there (`@`, and `+` two lines on), its
    sequence, and whether the line is one of a record's four.

    A record is told by its own lines, so what went before, blank lines among it, can't shift it. Lines are looked at in
    groups of _GROUP with the three lines around each, so no task needs more of a file than that.
    """
    lines = _numbered(_pieces(spark, path, glob)).select("genome", "line", F.regexp_replace("value", "\r", "").alias("value"))
    group, place = F.floor(F.col("line") / _GROUP), F.col("line") % _GROUP
    near = F.array_compact(F.array(group, F.when((place < 3) & (group > 0), group - 1), F.when(place >= _GROUP - 3, group + 1)))
    w = Window.partitionBy("genome", "group").orderBy("line")
    shown = lines.withColumn("home", group).withColumn("group", F.explode(near))
    head = F.col("value").startswith("@") & F.coalesce(F.lead("value", 2).over(w).startswith("+"), F.lit(False))
    shown = shown.withColumns({"is_head": head, "seq": F.lead("value", 1).over(w)})
    known = F.max(F.col("is_head").cast("int")).over(w.rowsBetween(-3, 0)) == 1
    return shown.withColumn("known", known).where("group = home").select("genome", "line", "value", "seq", "is_head", "known")


def fastq_errors(spark: SparkSession, path: str | list[str], glob: str = "*.fastq") -> DataFrame:
    """(genome, line, value): lines from 0 that aren't blank and belong to no record."""
    return _fastq_lines(spark, path, glob).where(~F.col("known") & (F.trim("value") != "")).select("genome", "line", "value")


def _checked(good: DataFrame, errors: DataFrame, mode: str) -> DataFrame:
    """The records; in strict mode reading them fails with the first malformed line met."""
    if mode not in ("strict", "report"):
        raise ValueError(f"mode is strict or report, not {mode}")
    if mode == "report":
        return good
    told = F.raise_error(F.concat(F.lit("malformed line "), F.col("line").cast("string"), F.lit(" of "), "genome", F.lit(": "), F.substring("value", 1, 80)))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema]
    return good.unionByName(errors.where(told.cast("string").isNotNull()).select(blank))


def read_fastq(spark: SparkSession, path: str | list[str], glob: str = "*.fastq", mode: str = "strict") -> DataFrame:
    """(genome, rec, id, desc, seq) of records of four lines; qualities may have any length, sequences may be empty, and blank
    lines may lie between records. rec is the line that a record begins at.

    Lines that belong to no record make the reading fail (strict), or are left to fastq_errors (report). Files are split
    over tasks.
    """
    lines = _fastq_lines(spark, path, glob)
    head = F.substr("value", F.lit(2))
    good = lines.where("is_head").select("genome", F.col("line").alias("rec"), F.substring_index(head, " ", 1).alias("id"), F.regexp_extract(head, " (.*)$", 1).alias("desc"), F.upper("seq").alias("seq"))
    return _checked(good, lines.where(~F.col("known") & (F.trim("value") != "")), mode)


def _fasta_pieces(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(genome, line, value, fits): pieces of files between line feeds with `>`; the first one must begin with it itself."""
    part = _numbered(_pieces(spark, path, glob, lineSep="\n>"))
    fits = (F.col("line") > 0) | F.col("value").startswith(">")
    return part.select("genome", "line", F.regexp_replace("value", "^>|\r", "").alias("value"), fits.alias("fits")).where(F.length(F.trim("value")) > 0)


def fasta_errors(spark: SparkSession, path: str | list[str], glob: str = "*.fasta") -> DataFrame:
    """(genome, line, value): what stands before the first record of a file."""
    return _fasta_pieces(spark, path, glob).where("not fits").select("genome", "line", "value")


def read_fasta(spark: SparkSession, path: str | list[str], glob: str = "*.fasta", mode: str = "strict") -> DataFrame:
    """(genome, rec, id, desc, seq): records begin with `>` at the start of a line and may have many lines.

    Records are cut by Spark's reader, so files are split over tasks; rec counts them within a file. What stands before the
    first record makes the reading fail (strict), or is left to fasta_errors (report).
    """
    pieces = _fasta_pieces(spark, path, glob)
    head = F.substring_index("value", "\n", 1)
    seq = F.upper(F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s", ""))
    good = pieces.where("fits").select("genome", F.col("line").alias("rec"), F.substring_index(head, " ", 1).alias("id"), F.regexp_extract(head, " (.*)$", 1).alias("desc"), seq.alias("seq"))
    return _checked(good, pieces.where("not fits"), mode)


def read_collections(spark: SparkSession, path: str | list[str], mode: str = "strict") -> DataFrame:
    """All FASTA and FASTQ files of a directory, or of a list of files."""
    return read_fasta(spark, path, mode=mode).unionByName(read_fastq(spark, path, mode=mode))


def numbers(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(i, j, v) of a text of lines with numbers between white space; empty lines don't count."""
    whole = spark.read.text(path, wholetext=True).select("value")
    lines = whole.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    return lines.select("i", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "v")).select("i", "j", F.col("v").cast(kind).alias("v"))


def read_triangle(spark: SparkSession, path: str, kind: str = "double", diagonal: bool = False) -> DataFrame:
    """(i, j, v) with j < i (or j <= i with `diagonal`) of a text of numbers between white space: the lower triangle by row.

    With number p of all, i is the largest row that begins at p or before. Lines don't matter, empty ones included.
    """
    lines = numbers(spark, path, kind)
    sizes = lines.groupBy("i").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # of one text
    p = lines.join(sizes, "i").select((F.col("skip") + F.col("j")).alias("p"), "v")
    row = F.floor((F.sqrt(8 * F.col("p") + 1) - 1) / 2)  # by row 0, 1, 2, .. with 1, 2, 3, .. numbers
    at = p.select(row.alias("r"), (F.col("p") - row * (row + 1) / 2).cast("int").alias("j"), "v")
    return at.select((F.col("r") + (0 if diagonal else 1)).cast("int").alias("i"), "j", "v")


def read_symmetric(spark: SparkSession, path: str, kind: str = "double", diagonal: bool = False) -> DataFrame:
    """(i, j, v) of both halves of the matrix whose lower triangle a text holds; without `diagonal` it is zero."""
    low = read_triangle(spark, path, kind, diagonal)
    both = low.unionByName(low.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    if diagonal:
        return both
    ends = low.select("i").union(low.select(F.col("j").alias("i"))).distinct()
    return both.unionByName(ends.select("i", F.col("i").alias("j"), F.lit(0).cast(kind).alias("v")))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, w) of a text with a header (vertices, type, edge weights) and one edge a line; undirected ones both ways."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n")).alias("line"), F.regexp_extract("value", r"type:\s*(\w)", 1).alias("type"))
    part = lines.where(F.col("line").rlike(r"^\s*\d+\s+\d+")).select("type", F.split(F.trim("line"), r"\s+").alias("x"))
    e = part.select("type", F.col("x")[0].cast("long").alias("u"), F.col("x")[1].cast("long").alias("v"), F.coalesce(F.get("x", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    return e.drop("type").unionByName(e.where("type = 'u'").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """(u, v), numbered from 0, both ways, of lines `e i j` numbered from 1."""
    x = F.split(F.trim("value"), r"\s+")
    e = spark.read.text(path).where("value like 'e %'").select((x[1].cast("long") - 1).alias("u"), (x[2].cast("long") - 1).alias("v"))
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def read_dmat(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, d) with j < i, and labels where given, of a text with [size], optional [labels] and [distances]."""
    whole = spark.read.text(path, wholetext=True)
    section = lambda name: F.regexp_extract("value", rf"\[{name}\]\s*([^\[]*?)\s*(?:\[|$)", 1)
    cells = whole.select(F.split(section("labels"), r"\s+").alias("labels"), F.posexplode(F.split(section("distances"), r"\s+")).alias("p", "d"))
    i = F.floor((1 + F.sqrt(8 * F.col("p") + 1)) / 2).cast("int")
    cells = cells.where("d <> ''").select(i.alias("i"), (F.col("p") - i * (i - 1) / 2).cast("int").alias("j"), F.col("d").cast("double").alias("d"), "labels")
    name = lambda c: F.nullif(F.get("labels", F.col(c)), F.lit(""))
    return cells.select("i", "j", "d", name("i").alias("label_i"), name("j").alias("label_j"))
