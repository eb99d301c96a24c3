"""Bit vectors in packed form: superblocks of 512 bits as eight 64-bit words, with how many bits are set before each.

Rank joins a position with its superblock alone and counts bits within it; select joins a rank with the few superblocks
that hold ranks near it. No window runs over all rows: positions and counts are added up by range (see order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.operators.order import in_ranges, numbered, running, with_positions
from seqweft.operators.shared import stored

#: Bits of a word, words of a superblock, and ranks that one key of a select's join stands for.
WORD, WORDS, NEAR = 64, 8, 64
SUPERBLOCK = WORD * WORDS


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df with pos, each row's place in the order from 0."""
    return with_positions(numbered(in_ranges(df, order, order), "bits")).drop("part", "at")


def _power(places: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), places.cast("int"))


def _lowest(n: Column) -> Column:
    """A word of which the n lowest bits are set."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (WORD - n).cast("int")))


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))


def _counted(blocks: DataFrame) -> DataFrame:
    """(block, words, size, ones) with before, the bits set in all blocks before."""
    return stored(running(blocks.withColumn("ones", _ones(F.col("words"))), ["block"], "ones"), "superblocks")


def packed(placed: DataFrame, bit: str) -> DataFrame:
    """(block, words, size, ones, before) of rows with pos and a bit of 0 or 1; positions run from 0 without gaps. A null
    bit isn't set."""
    one = F.when(F.coalesce(F.col(bit), F.lit(0)) != 0, _power(F.col("pos") % WORD)).otherwise(F.lit(0).cast("long"))
    words = placed.groupBy(F.floor(F.col("pos") / WORD).alias("w")).agg(F.bit_or(one).alias("bits"), F.count("*").alias("n"))
    own = F.map_from_entries(F.collect_list(F.struct((F.col("w") % WORDS).cast("int").alias("k"), "bits")))
    blocks = words.groupBy(F.floor(F.col("w") / WORDS).alias("block")).agg(own.alias("m"), F.sum("n").alias("size"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return _counted(blocks.select("block", filled.alias("words"), "size"))


def _up_to(words: Column, r: Column) -> Column:
    """Bits set among the first r + 1 of a superblock."""
    k = F.floor(r / WORD).cast("int")
    whole = F.aggregate(F.slice(words, 1, k), F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))
    return whole + F.bit_count(F.get(words, k).bitwiseAND(_lowest(r % WORD + 1)))


def _met(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, ..) with its superblock's columns, null beyond the end, and _r, the place within it."""
    at = wanted.withColumns({"block": F.floor(F.col("pos") / SUPERBLOCK), "_r": F.col("pos") % SUPERBLOCK})
    met = at.join(p, "block", "left")
    inside = (F.col("pos") >= 0) & (F.col("_r") < F.col("size"))
    return met.select(*wanted.columns, "_r", *[F.when(inside, F.col(c)).alias(c) for c in ("words", "before")])


def rank1(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, ..) with rank1, the bits set up to there, this one included; null beyond the end."""
    return _met(p, wanted).select(*wanted.columns, (F.col("before") + _up_to(F.col("words"), F.col("_r"))).alias("rank1"))


def access(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, ..) with bit; null beyond the end."""
    word = F.get("words", F.floor(F.col("_r") / WORD).cast("int"))
    return _met(p, wanted).select(*wanted.columns, F.getbit(word, (F.col("_r") % WORD).cast("int")).cast("int").alias("bit"))


def _selected(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, pos) of the x-th bit set of (block, words, ones, before); null where there is none."""
    some = blocks.where("ones > 0")
    keys = F.sequence(F.floor((F.col("before") + 1) / NEAR), F.floor((F.col("before") + F.col("ones")) / NEAR))
    asked = wanted.select("x").distinct().withColumn("key", F.floor(F.col("x") / NEAR))
    met = asked.join(some.withColumn("key", F.explode(keys)), "key").where((F.col("before") < F.col("x")) & (F.col("x") <= F.col("before") + F.col("ones")))
    # the word that holds it: the bits of the words before, one after the other
    sums = F.transform(F.sequence(F.lit(0), F.lit(WORDS)), lambda k: _ones(F.slice("words", 1, k)))
    met = met.withColumn("left", F.col("x") - F.col("before")).withColumn("sums", sums)
    k = F.size(F.filter("sums", lambda s: s < F.col("left"))) - 1
    met = met.withColumn("k", k).withColumn("word", F.get("words", F.col("k"))).withColumn("nth", (F.col("left") - F.get("sums", F.col("k"))).cast("int"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(F.col("word"), b) == 1)
    found = met.select("x", (F.col("block") * SUPERBLOCK + F.col("k") * WORD + F.element_at(bits, F.col("nth"))).alias("pos"))
    return wanted.join(found, "x", "left")


def select1(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, pos) for each wanted x: the place of the x-th set bit, -1 where there is none."""
    return _selected(p, wanted).select("x", F.coalesce("pos", F.lit(-1).cast("long")).alias("pos"))


def select0(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """The place of the x-th bit that isn't set; 0 for x = 0, -1 where there is none."""
    # the words turned round, without bits beyond the end
    mask = lambda k: _lowest(F.least(F.lit(WORD).cast("long"), F.col("size") - k * WORD))
    turned = p.select("block", F.transform("words", lambda w, k: F.bitwise_not(w).bitwiseAND(mask(k))).alias("words"), (F.col("size") - F.col("ones")).alias("ones"), (F.col("block") * SUPERBLOCK - F.col("before")).alias("before"))
    return _selected(turned, wanted).select("x", F.when(F.col("x") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("pos", F.lit(-1).cast("long"))).alias("pos"))


def with_bits(p: DataFrame, setting: DataFrame) -> DataFrame:
    """The vector with the bits at setting (pos) set; positions beyond the end are left out."""
    one = _power(F.col("pos") % WORD)
    words = setting.where("pos >= 0").groupBy(F.floor(F.col("pos") / WORD).alias("w")).agg(F.bit_or(one).alias("bits"))
    new = words.groupBy(F.floor(F.col("w") / WORDS).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % WORDS).cast("int").alias("k"), "bits"))).alias("m"))
    mask = lambda k: _lowest(F.least(F.lit(WORD).cast("long"), F.col("size") - k * WORD))
    both = F.transform("words", lambda w, k: w.bitwiseOR(F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")).bitwiseAND(mask(k))))
    return _counted(p.select("block", "words", "size").join(new, "block", "left").select("block", both.alias("words"), "size"))


def ranked(df: DataFrame, bit: str, order: list[str]) -> DataFrame:
    """Adds pos (from 0), rank1 (bits set up to here, this one included) and rank0 to each row."""
    placed = stored(positions(df, order), "placed")
    return rank1(packed(placed, bit), placed).withColumn("rank0", F.col("pos") + 1 - F.col("rank1"))


def gaps(p: DataFrame) -> DataFrame:
    """(gap, n): how many bits lie between a set bit and the next one."""
    each = F.filter(F.sequence(F.lit(0), F.lit(SUPERBLOCK - 1)), lambda b: F.getbit(F.get("words", F.floor(b / WORD).cast("int")), b % WORD) == 1)
    own = p.where("ones > 0").select("before", "ones", F.transform(each, lambda b: b + F.col("block") * SUPERBLOCK).alias("set"))
    inner = own.select(F.explode(F.zip_with(F.slice("set", 2, SUPERBLOCK), F.slice("set", 1, F.greatest(F.size("set") - 1, F.lit(0))), lambda b, a: b - a - 1)).alias("gap"))
    # between blocks: the last bit of one and the first of the next that has any, which meet by rank
    last = own.select((F.col("before") + F.col("ones")).alias("rank"), F.element_at("set", -1).alias("a"))
    outer = last.join(own.select(F.col("before").alias("rank"), F.col("set")[0].alias("b")), "rank").select((F.col("b") - F.col("a") - 1).alias("gap"))
    return inner.unionByName(outer).groupBy("gap").agg(F.count("*").alias("n"))
