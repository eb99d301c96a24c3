"""The order of all contexts of all sequences, whole ones: what precedes each symbol, back to the sequence's beginning.

A sequence of n symbols has n + 1 contexts, ordered by their symbols from the last to the first; equal ones by the order
of their sequences. Ranks come from doubling: contexts are ranked by their last SEED symbols, then those that still share a
rank by the rank of what precedes these symbols, which doubles the symbols that count; only rows that share a rank go on.
Ranks are positions in range order, so no task sees a whole rank. What neighbours of different keys have in common their
keys tell; of those that share one, the ranks of all rounds tell it without looking at symbols again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.operators.edges import STRETCH
from seqweft.operators.order import in_ranges, numbered, running, with_positions
from seqweft.operators.shared import stored

#: Symbols by which contexts are ranked first.
SEED = 32


def _places(seqs: DataFrame) -> DataFrame:
    """(s, e, color, W, key) of every context of (s, color, seq): the e symbols before W; key has the last SEED of them, the
    last one first. Sequences are cut into stretches by byte, so reaching a place costs the same everywhere."""
    b = seqs.select("s", "color", F.coalesce("seq", F.lit("")).cast("binary").alias("b"))
    cut = b.select("s", "color", "b", F.octet_length("b").alias("n"), F.explode(F.sequence(F.lit(0), F.octet_length("b"), F.lit(STRETCH))).alias("base"))
    lead = F.least("base", F.lit(SEED))
    piece = cut.select("s", "color", "n", "base", lead.alias("lead"), F.expr(f"substring(b, base - least(base, {SEED}) + 1, {SEED + STRETCH + 1})").alias("x"))
    at = piece.select("s", "color", "n", "lead", "x", "base", F.explode(F.sequence(F.col("base"), F.least(F.col("base") + STRETCH - 1, F.col("n")))).alias("e"))
    own, end = F.least("e", F.lit(SEED)), F.col("e") - F.col("base") + F.col("lead")
    key = F.reverse(F.substr("x", end - own + 1, own).cast("string"))
    return at.select("s", F.col("e").cast("long").alias("e"), "color", F.when(F.col("e") >= F.col("n"), "$").otherwise(F.substr("x", end + 1, F.lit(1)).cast("string")).alias("W"), key.alias("key"))


def _ranked(rows: DataFrame, keys: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """(groups, rows): with `rank`, how many rows have smaller keys, and many, how many have the same ones."""
    groups = running(rows.groupBy(*keys).agg(F.count("*").alias("many")), keys, "many").withColumnRenamed("before", rank)
    return groups, rows.join(groups, keys)


def _common(df: DataFrame, a: str, b: str | Column, name: str) -> DataFrame:
    """df with `name`: how many first symbols a and b share, SEED at most."""
    df = df.withColumn(name, F.lit(0))
    h = SEED
    while h:
        end = F.col(name) + h
        piece = lambda c: F.substr(c, F.col(name) + 1, F.lit(h))  # noqa: B023, E731
        df = df.withColumn(name, F.when((F.length(a) >= end) & (F.length(b) >= end) & (piece(a) == piece(b)), end).otherwise(F.col(name)))
        h //= 2
    return df


def context_order(seqs: DataFrame, read: list[str]) -> DataFrame:
    """(rank, W, lcp, sl, color) of every context of (color, seq, and the columns `read`, which tell sequences of a colour
    apart and order them). Symbols are single bytes; a null sequence is empty.

    rank counts from 0. lcp is how many last symbols a context shares with the one before it, sl its length and one.
    """
    reads = with_positions(numbered(in_ranges(seqs, ["color", *read], ["color", *read]), "reads")).select(F.col("pos").alias("s"), "color", "seq")
    places = stored(_places(reads), "places")
    groups, _ = _ranked(places, ["key"], "first")
    # a key's first context shares with the one before it what the two keys share
    keys = groups.select("key", "many", "first").join(groups.select((F.col("first") + F.col("many")).alias("first"), F.col("key").alias("_k")), "first", "left")
    keys = _common(keys, "key", F.coalesce("_k", F.lit("")), "lcp").drop("_k")
    now = stored(places.join(keys, "key"), "ranks")
    tied, long = now.where("many > 1"), F.col("e") >= SEED
    # from here on only sequences go on that have contexts which share SEED symbols with others; a shorter one is equal to
    # all that share its key, so a key never has both
    part = stored(now.join(tied.where(long).select("s").distinct(), "s", "left_semi").select("s", "e", "key", "first", "many", F.col("first").alias("rank"), (F.col("many") > 1).alias("tied")), "ranks")
    state, levels, h = part, [(SEED, part)], SEED
    while True:
        open_ = state.where((F.col("many") > 1) & (F.col("e") >= h))
        if open_.isEmpty():
            break
        # what precedes the h symbols: one that begins its sequence has rank 0 there, the empty context
        before = state.select("s", (F.col("e") + h).alias("e"), F.col("rank").alias("second"))
        pairs = stored(open_.select("s", "e", "first", "rank", "tied").join(before, ["s", "e"]), "pairs")
        fine, placed = _ranked(pairs, ["rank", "second"], "place")
        base = fine.groupBy("rank").agg(F.min("place").alias("base"))
        moved = placed.join(base, "rank").select("s", "e", "first", (F.col("rank") + F.col("place") - F.col("base")).alias("rank"), "many", "tied")
        state = stored(state.where((F.col("many") == 1) | (F.col("e") < h)).select(moved.columns).unionByName(moved), "ranks")
        h *= 2
        levels.append((h, state))
    # equal contexts follow the order of their sequences
    short = tied.where(~long).select("s", "e", "first", F.col("first").alias("rank"))
    whole = short.unionByName(state.where(long & F.col("tied")).select("s", "e", "first", "rank"))
    order = stored(with_positions(numbered(in_ranges(whole, ["rank", "s"], ["rank", "s"]), "order")).select("s", "e", "first", "pos"), "order")
    start = order.groupBy("first").agg(F.min("pos").alias("start"))
    order = stored(order.join(start, "first").select("s", "e", "first", (F.col("first") + F.col("pos") - F.col("start")).alias("rank")), "order")
    after = order.where(long).select("first", (F.col("rank") + 1).alias("rank"), F.col("s").alias("t"), F.col("e").alias("f"))
    state = stored(order.where(long).join(after, ["first", "rank"]).select("rank", "s", "e", "t", "f", F.lit(0).cast("long").alias("lcp")), "neighbours")
    rank_of = lambda table, s, e, name: table.where("many > 1").select(F.col("s").alias(s), F.col("e").alias(e), F.col("rank").alias(name))
    for h, table in reversed(levels):
        met = state.join(rank_of(table, "s", "e", "_a"), ["s", "e"], "left").join(rank_of(table, "t", "f", "_b"), ["t", "f"], "left")
        step = F.when(F.col("_a") == F.col("_b"), F.least(F.lit(h), "e")).otherwise(0)
        state = stored(met.select("rank", "s", (F.col("e") - step).alias("e"), "t", (F.col("f") - step).alias("f"), (F.col("lcp") + step).alias("lcp")), "neighbours")
    key_of = lambda s, e, name: part.select(F.col("s").alias(s), F.col("e").alias(e), F.col("key").alias(name))
    ends = state.join(key_of("s", "e", "_a"), ["s", "e"]).join(key_of("t", "f", "_b"), ["t", "f"])
    walked = _common(ends, "_a", "_b", "_more").select("rank", (F.col("lcp") + F.col("_more")).alias("walked"))
    out = order.join(tied.select("s", "e", "color", "W", "lcp"), ["s", "e"]).join(walked, "rank", "left")
    lcp = F.when(F.col("rank") == F.col("first"), F.col("lcp")).when(long, F.col("walked")).otherwise(F.col("e"))
    of = lambda df, rank, lcp: df.select(F.col(rank).alias("rank"), "W", lcp.cast("long").alias("lcp"), (F.col("e") + 1).alias("sl"), "color")
    return of(now.where("many = 1"), "first", F.col("lcp")).unionByName(of(out, "rank", lcp))
