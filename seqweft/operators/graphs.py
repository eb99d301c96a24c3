"""Graphs as edge tables (u, v, w); undirected ones hold both directions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seqweft.operators import packed
from seqweft.operators.shared import forget, ready_checkpoints, stored

#: The weight of an edge that doesn't exist.
NO_EDGE = 2.2250738585072014e-308


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in e.columns if c not in "uv"]).select(e.columns))


def degrees(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.count("*").alias("degree"))


def largest_degree(e: DataFrame) -> DataFrame:
    """The vertex of the largest degree, the least of several."""
    return degrees(e).groupBy().agg(F.max(F.struct(F.col("degree"), (-F.col("u")).alias("m"))).alias("top")).select((-F.col("top.m")).alias("u"), "top.degree")


def neighbours(e: DataFrame) -> DataFrame:
    """(u, list): distinct neighbours, ascending, as text."""
    return e.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda x: x.cast("string")), ",").alias("list"))


def internal(e: DataFrame) -> DataFrame:
    """Edges u < v whose ends both have a degree over 1."""
    d = degrees(e).where("degree > 1").select("u")
    return e.where("u < v").join(d, "u", "left_semi").join(d.withColumnRenamed("u", "v"), "v", "left_semi").select(e.columns)


def weights(e: DataFrame, wanted: DataFrame) -> DataFrame:
    """Weights of wanted (u, v), NO_EDGE where there is none."""
    return wanted.join(e, ["u", "v"], "left").select("u", "v", F.coalesce("w", F.lit(NO_EDGE)).alias("w"))


def without(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges that touch none of the vertices (u)."""
    return e.join(vertices, "u", "left_anti").join(vertices.withColumnRenamed("u", "v"), "v", "left_anti").select(e.columns)


def without_edges(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the edges (u, v) of gone, in both directions."""
    out = gone.select("u", "v").union(gone.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return e.join(out, ["u", "v"], "left_anti").select(e.columns)


def exchanged(e: DataFrame, a: int, b: int) -> DataFrame:
    """The graph with two vertices' numbers exchanged."""
    swap = lambda c: F.when(F.col(c) == a, b).when(F.col(c) == b, a).otherwise(F.col(c)).cast(e.schema[c].dataType).alias(c)
    return e.select(swap("u"), swap("v"), *[c for c in e.columns if c not in "uv"])


def _hung(e: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """The links (u, v, c) between vertices that are no leaves, and the leaves (leaf, at, out, in) with the weights from and
    to the one vertex they are joined with. Of two vertices joined with each other alone the greater is the leaf."""
    links = stored(e.select("u", "v", weight.alias("c")).groupBy("u", "v").agg(F.min("c").alias("c")), "links")
    ends = links.select("u", "v", F.col("c").alias("out"), F.lit(None).cast("double").alias("in")).unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(None).cast("double").alias("out"), F.col("c").alias("in")))
    one = ends.groupBy("u").agg(F.min("v").alias("at"), F.max("v").alias("other"), F.max("out").alias("out"), F.max("in").alias("in")).where("at = other and at <> u").drop("other")
    pair = one.select(F.col("at").alias("u"), F.col("u").alias("at"))
    leaves = stored(one.join(pair.where("u < at"), ["u", "at"], "left_anti").withColumnRenamed("u", "leaf"), "leaves")
    gone = leaves.select(F.col("leaf").alias("u"))
    return without(links, gone), leaves


def _origins(sources: DataFrame, leaves: DataFrame) -> DataFrame:
    """(source, u, up, hung): where the search from each source begins among the vertices that are no leaves."""
    asked = sources.select(F.col("u").alias("source")).distinct()
    found = asked.join(leaves, asked["source"] == leaves["leaf"], "left")
    return stored(found.where("leaf is null or out is not null").select("source", F.coalesce("at", "source").alias("u"), F.coalesce("out", F.lit(0.0)).alias("up"), F.col("leaf").isNotNull().alias("hung")), "origins")


#: Sources of a block that is broadcast.
_BLOCK = 131_072


def _blocks(origins: DataFrame) -> list[DataFrame]:
    """Origins in blocks of about `_BLOCK`, each to be broadcast: the rows of a result are made where they are read."""
    blocks = max(1, -(-origins.count() // _BLOCK))
    place = F.pmod(F.xxhash64("source"), F.lit(blocks))
    return [F.broadcast(origins.where(place == b).withColumnRenamed("u", "start")) for b in range(blocks)]


def _dealt(leaves: DataFrame) -> DataFrame:
    """Leaves that are reached, dealt evenly: each is a row for every source."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return leaves.where(F.col("in").isNotNull()).repartition(parts, "leaf")


def hops(e: DataFrame, sources: DataFrame, weight: str | None = None, parents: bool = False) -> DataFrame:
    """(source, u, dist[, far][, parent]) of all vertices that each source (u) reaches: breadth first, all sources at once.

    With `weight`, far is the sum along the path by which a vertex was first reached (in a tree, the only one); of paths
    that reach it at once the lightest counts. parent is the vertex before on that path (the least of several), null at a
    source.

    Leaves are left out of the search, and follow from the vertex each hangs on when the rows are read: nothing that is
    stored grows with sources times leaves.
    """
    ready_checkpoints(e)
    links, leaves = _hung(e, F.col(weight).cast("double") if weight else F.lit(0.0))
    links = links.select("u", F.col("v").alias("to"), "c")
    kind = e.schema["u"].dataType
    origins = _origins(sources, leaves)
    seen = origins.select(F.col("u").alias("start")).distinct().select("start", F.col("start").alias("u"), F.lit(0).alias("dist"), F.lit(0.0).alias("far"), F.lit(None).cast(kind).alias("parent")).checkpoint()
    front, d = seen, 0
    while not front.isEmpty():
        d += 1
        way = F.min(F.struct((F.col("far") + F.col("c")).alias("far"), F.col("u").alias("parent"))).alias("way")
        step = front.select("start", "u", "far").join(links, "u").groupBy("start", F.col("to").alias("u")).agg(way)
        front = step.join(seen, ["start", "u"], "left_anti").select("start", "u", F.lit(d).alias("dist"), "way.far", "way.parent").checkpoint()
        seen = seen.unionByName(front)  # each front is stored once
    core = stored(seen, "hops")
    up = F.col("hung").cast("int")
    hanging = _dealt(leaves).join(core.withColumnRenamed("u", "at"), "at")
    out = []
    for begin in _blocks(origins):
        out.append(core.join(begin, "start").select("source", "u", (F.col("dist") + up).alias("dist"), (F.col("up") + F.col("far")).alias("far"), F.coalesce("parent", F.when(F.col("hung"), F.col("source"))).alias("parent")))
        outer = hanging.join(begin, "start").where("leaf <> source")
        out.append(outer.select("source", F.col("leaf").alias("u"), (F.col("dist") + up + 1).alias("dist"), (F.col("up") + F.col("far") + F.col("in")).alias("far"), F.col("at").alias("parent")))
    own = sources.select("u").distinct().join(leaves, F.col("u") == F.col("leaf"), "left_semi").select(F.col("u").alias("source"), "u", F.lit(0).alias("dist"), F.lit(0.0).alias("far"), F.lit(None).cast(kind).alias("parent"))
    return reduce(DataFrame.unionByName, [*out, own]).drop(*([] if weight else ["far"]), *([] if parents else ["parent"]))


def components(e: DataFrame) -> DataFrame:
    """(u, component) of all vertices of an undirected graph; component is its least vertex. Links move to the least
    neighbour, from larger and from smaller vertices in turn, until none moves."""
    ready_checkpoints(e)
    now = e.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    found = now.select(F.col("a").alias("u"), F.col("b").alias("component"))
    every = e.select("u").union(e.select(F.col("v").alias("u"))).distinct()
    return every.join(found.groupBy("u").agg(F.min("component").alias("component")), "u", "left").select("u", F.coalesce("component", "u").alias("component"))


#: Words of 64 sources in a row of `eccentricities`, and sources of one pass.
_WORDS, _PASS = 16, 16_384


def eccentricities(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(u, far): the largest distance from each vertex to any of the sources (u) that it is connected with; vertices that
    no source reaches are left out. links are the edges of an undirected graph, once in each direction.

    Searches run side by side: a row of a vertex has a bit for each of 1,024 sources that reach it, and a round passes on
    the bits that are new. Passes of about 16,384 sources bound what is stored; a round replaces the one before.
    """
    words = range(_WORDS)
    passes = -(-sources.count() // _PASS)
    dealt = stored(sources.select("u", F.pmod(F.xxhash64("u"), F.lit(max(1, passes))).alias("p")), "sources")
    out = dealt.select("u", F.lit(0).alias("far")).limit(0)
    for p in range(passes):
        own = stored(dealt.where(F.col("p") == p).select("u").coalesce(1).withColumn("n", F.monotonically_increasing_id()), "numbered")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") % 64).cast("int"))
        word = F.floor(F.col("n") / 64) % _WORDS
        first = own.select("u", F.floor(F.col("n") / (64 * _WORDS)).cast("int").alias("chunk"), *[F.when(word == i, bit).otherwise(0).alias(f"m{i}") for i in words])
        seen = stored(first.groupBy("u", "chunk").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in words], *[F.bit_or(f"m{i}").alias(f"f{i}") for i in words], F.lit(0).alias("far")), "reached")
        d = 0
        while not seen.where(F.col("far") == d).isEmpty():
            front = seen.where(F.col("far") == d).select("u", "chunk", *[f"f{i}" for i in words])
            d += 1
            step = front.join(links, "u").groupBy(F.col("v").alias("u"), "chunk").agg(*[F.bit_or(f"f{i}").alias(f"s{i}") for i in words])
            old, got = [F.coalesce(f"m{i}", F.lit(0)) for i in words], [F.coalesce(f"s{i}", F.lit(0)) for i in words]
            fresh = [g.bitwiseAND(F.bitwise_not(o)) for o, g in zip(old, got, strict=True)]
            some = reduce(Column.bitwiseOR, fresh) != 0
            columns = [o.bitwiseOR(g).alias(f"m{i}") for i, (o, g) in enumerate(zip(old, got, strict=True))] + [x.alias(f"f{i}") for i, x in enumerate(fresh)]
            now = stored(seen.drop(*[f"f{i}" for i in words]).join(step, ["u", "chunk"], "full").select("u", "chunk", *columns, F.when(some, d).otherwise(F.col("far")).alias("far")), "reached")
            forget(seen)
            seen = now
        out = out.unionByName(stored(seen.groupBy("u").agg(F.max("far").alias("far")), "far"))
        forget(seen)
    return out.groupBy("u").agg(F.max("far").alias("far"))


def diameters(e: DataFrame) -> DataFrame:
    """(component, diameter) of every component of an undirected graph, in hops: the fringe method.

    Searches from a vertex of the largest degree, from what lies farthest from it (a), what lies farthest from that (b) and
    the middle between give a lower bound, the distance of a and b; in a component that is a tree it is the diameter. Of
    the four, the root is the vertex with the fewest others beyond half the bound. Two vertices within i hops of the root
    are at most 2 * i apart, so levels are searched from the outermost inwards until the bound reaches that.

    Where many vertices lie beyond half the bound, hubs are searched from before: each vertex names the one of largest
    degree of itself and its neighbours. All vertices lie within one hop of a hub, so a vertex is at most one hop further
    from any other than from its furthest hub, and those for which that isn't above the bound are settled.

    Up to `packed.MOST` vertices with whole numbers as names are searched in memory, see there; others by joins of rows.
    """
    if isinstance(e.schema["u"].dataType, IntegralType):
        found = packed.diameters(e)
        if found is not None:
            return found
    edges = stored(e.where("u <> v").select("u", "v").distinct(), "graph")
    part = stored(components(edges.unionByName(e.where("u = v").select("u", "v").distinct())), "components")
    size = edges.join(part, "u").groupBy("component").agg((F.count("*") / 2).alias("m")).join(part.groupBy("component").agg(F.count("*").alias("n")), "component", "right")
    trees = size.where("coalesce(m, 0) <= n - 1").select("component")

    def search(sources: DataFrame) -> DataFrame:
        return stored(hops(edges, sources.select("u")).join(part, "u"), "hops")

    def farthest(found: DataFrame) -> DataFrame:
        return found.groupBy("component").agg(F.max(F.struct(F.col("dist"), (-F.col("u")).alias("m"))).alias("x")).select("component", (-F.col("x.m")).alias("u"), F.col("x.dist").alias("far"))

    def raised(bound: DataFrame, found: DataFrame) -> DataFrame:
        most = found.join(part, "u").groupBy("component").agg(F.max("far").alias("most"))
        return stored(bound.join(most, "component", "left").select("component", F.greatest("low", F.coalesce("most", "low")).alias("low")), "bounds")

    degree = part.join(degrees(edges).withColumnRenamed("degree", "d"), "u", "left")
    start = degree.groupBy("component").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-F.col("u")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("u"))
    first = search(start)
    one = search(farthest(first))
    other = farthest(one)
    bound = stored(other.select("component", F.col("far").alias("low")), "bounds")
    two = search(other)
    half = F.floor(F.col("low") / 2)
    between = one.select("component", "u", F.col("dist").alias("x")).join(two.select("u", F.col("dist").alias("y")), "u").join(bound, "component")
    middle = search(between.where((F.col("x") == half) & (F.col("x") + F.col("y") == F.col("low"))).groupBy("component").agg(F.min("u").alias("u")))
    roots = first.unionByName(one).unionByName(two).unionByName(middle).join(trees, "component", "left_anti").distinct()
    beyond = roots.join(bound, "component").groupBy("component", "source").agg(F.count_if(2 * F.col("dist") > F.col("low")).alias("many"))
    best = beyond.groupBy("component").agg(F.min(F.struct("many", "source")).alias("x")).where("x.many > 0").select("component", "x.source")
    levels = stored(roots.join(best, ["component", "source"]).join(bound, "component").where("2 * dist > low").select("component", "u", "dist"), "levels")
    rank = degree.join(levels.select("component").distinct(), "component", "left_semi").select("u", F.struct("d", (-F.col("u")).alias("m")).alias("x"))
    near = edges.join(rank.withColumnRenamed("u", "v"), "v").select("u", "x").unionByName(rank)
    hubs = stored(near.groupBy("u").agg(F.max("x").alias("x")).select((-F.col("x.m")).alias("u")).distinct(), "hubs")
    if hubs.count() < levels.count():
        found = stored(eccentricities(edges, hubs), "far")
        bound = raised(bound, found)
        levels = stored(levels.join(hubs, "u", "left_anti").join(found, "u").join(bound, "component").where("far + 1 > low").select("component", "u", "dist"), "levels")
    for level in range(levels.agg(F.max("dist")).first()[0] or 0, 0, -1):
        open_ = levels.where(F.col("dist") == level).join(bound.where(2 * level > F.col("low")), "component").select("u")
        if not open_.isEmpty():
            bound = raised(bound, eccentricities(edges, open_))
    return bound.withColumnRenamed("low", "diameter")


def diameter(e: DataFrame) -> DataFrame:
    """(diameter): the largest finite distance of an undirected graph, in hops; null without vertices."""
    return diameters(e).agg(F.max("diameter").alias("diameter"))


def _ends(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hops from both ends of a longest path of a tree: what is farthest from any vertex, and what is farthest from that."""
    start, out = tree.agg(F.min("u").alias("u")).where("u is not null"), []
    for _ in range(3):
        dist = hops(tree, start)
        start = dist.orderBy(F.desc("dist"), "u").limit(1).select("u")
        out.append(dist)
    return out[1], out[2]


def tree_centers(tree: DataFrame) -> DataFrame:
    """(u, ecc): the vertices of a tree whose largest distance is least, one or two. In a tree the vertex that is farthest
    away is an end of a longest path, so searches from its two ends give all largest distances."""
    a, b = _ends(tree)
    ecc = a.select("u", F.col("dist").alias("a")).join(b.select("u", F.col("dist").alias("b")), "u").select("u", F.greatest("a", "b").alias("ecc"))
    return ecc.join(F.broadcast(ecc.agg(F.min("ecc").alias("ecc"))), "ecc").select("u", "ecc")


def shortest(e: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(u, v, d): the length of the shortest path from each source u (a column u; all vertices if none are given) to every
    v that it reaches. Each round extends only distances that the round before made smaller, by one edge, until none is
    or paths of as many edges as there are vertices are covered: as many rounds as shortest paths have edges.

    Negative weights are allowed, negative cycles are not. Repeated edges count once, at their least weight; a source
    without edges reaches itself. Leaves follow from the vertex each hangs on when the rows are read, as in `hops`.
    """
    ready_checkpoints(e)
    v = e.select("u").union(e.select(F.col("v").alias("u"))).distinct()
    wanted = v if sources is None else sources.select("u").distinct()
    links, leaves = _hung(e, F.col("w").cast("double"))
    links = links.select(F.col("u").alias("m"), F.col("v").alias("to"), F.col("c").alias("w"))
    origins = _origins(wanted, leaves)
    now = origins.select("u").distinct().select("u", F.col("u").alias("v"), F.lit(0.0).alias("d")).checkpoint()
    front = now
    for _ in range(v.count()):
        step = front.select("u", F.col("v").alias("m"), "d").join(links, "m").groupBy("u", F.col("to").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        front = step.join(now.withColumnRenamed("d", "old"), ["u", "v"], "left").where("old is null or d < old").select("u", "v", "d").checkpoint()
        if front.isEmpty():
            break
        now = now.join(front, ["u", "v"], "left_anti").unionByName(front).checkpoint()
    core = stored(now.select(F.col("u").alias("start"), "v", "d"), "shortest")
    hanging = _dealt(leaves).join(core.withColumnRenamed("v", "at"), "at")
    out = []
    for begin in _blocks(origins):
        out.append(core.join(begin, "start").select(F.col("source").alias("u"), "v", (F.col("up") + F.col("d")).alias("d")))
        outer = hanging.join(begin, "start").where("leaf <> source")
        out.append(outer.select(F.col("source").alias("u"), F.col("leaf").alias("v"), (F.col("up") + F.col("d") + F.col("in")).alias("d")))
    own = wanted.join(leaves, F.col("u") == F.col("leaf"), "left_semi").select("u", F.col("u").alias("v"), F.lit(0.0).alias("d"))
    return reduce(DataFrame.unionByName, [*out, own])


def _closed(e: DataFrame) -> DataFrame:
    """(u, v, t, dv, dt) of every triangle: u has the least degree (of equal ones the least number), v < t, and dv and dt
    are their degrees. Edges point from the lesser degree to the greater, which bounds the lists."""
    d = degrees(e)
    one = e.where("u < v").select("u", "v").distinct().join(d, "u").withColumnRenamed("degree", "du").join(d.select(F.col("u").alias("v"), F.col("degree").alias("dv")), "v")
    ahead, back = F.struct("u", "v", "dv"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("du").alias("dv"))
    up = one.select(F.when(F.struct("du", "u") < F.struct("dv", "v"), ahead).otherwise(back).alias("x")).select("x.*")
    two = up.join(up.select("u", F.col("v").alias("t"), F.col("dv").alias("dt")), "u").where("v < t")
    return two.join(one.select(F.col("u").alias("v"), F.col("v").alias("t")), ["v", "t"])


def triangles(e: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, all joined."""
    t = F.array_sort(F.array("u", "v", "t"))
    return _closed(stored(e.select("u", "v"), "graph")).select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _cliques(near: list[int], r: list[int], p: int, x: int) -> Iterator[list[int]]:
    """Bron-Kerbosch with a pivot, within one vertex's later neighbours. Sets are bits by place; near[v] has the places that
    v is joined with, of a place that is in x from the start only those that are in p."""
    if not p:
        if not x:
            yield r
        return
    pivot = max((near[v] & p for v in _bits(p | x)), key=int.bit_count)
    for v in _bits(p & ~pivot):
        yield from _cliques(near, [*r, v], p & near[v], x & near[v])
        p ^= 1 << v
        x |= 1 << v


def _cliques_of(u: int, later: np.ndarray, before: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """The maximal cliques of u and later neighbours; (a, b) are the edges between neighbours of which one at least is later."""
    later = np.unique(later)
    before = np.setdiff1d(np.unique(before), later)
    if len(later):  # others can't stand against a clique
        before = before[np.isin(before, np.concatenate([a, b]))]
    names = np.concatenate([later, before])
    order = np.argsort(names)
    at = lambda x: order[np.searchsorted(names, x, sorter=order)]
    i, j = at(np.concatenate([a, b])), at(np.concatenate([b, a]))
    own = np.lexsort((j, i))
    i, j = i[own], j[own]
    cut, near = np.searchsorted(i, np.arange(len(names) + 1)).tolist(), []
    for v in range(len(names)):
        row = np.zeros(len(names), bool)
        row[j[cut[v] : cut[v + 1]]] = True
        near.append(int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little"))
    p = (1 << len(later)) - 1
    return [sorted([u, *names[r].tolist()]) for r in _cliques(near, [], p, (1 << len(names)) - 1 ^ p)]


def maximal_cliques(e: DataFrame) -> DataFrame:
    """(size, clique as text) of all maximal cliques. Each vertex is searched with its neighbours of greater degree only;
    a task holds the edges between these, and from them to the others, which come from the triangles of the graph."""
    e = stored(e.select("u", "v"), "graph")  # it is read several times
    d = degrees(e)
    plain = e.distinct()
    own = plain.join(d, "u").join(d.select(F.col("u").alias("v"), F.col("degree").alias("dv")), "v").select("u", "v", F.when(F.struct("degree", "u") < F.struct("dv", "v"), 1).otherwise(0).alias("later"))
    # a triangle's edge is needed where one of its ends is later: at the first and the second of its vertices
    of = lambda x, y, z: F.struct(F.col(x).alias("u"), F.col(y).alias("a"), F.col(z).alias("b"))
    second = F.when(F.struct("dv", "v") < F.struct("dt", "t"), of("v", "u", "t")).otherwise(of("t", "u", "v"))
    inside = _closed(plain).select(F.explode(F.array(of("u", "v", "t"), second)).alias("t")).select("t.*", F.lit(2).alias("later"))
    rows = own.select("u", F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), "later").unionByName(inside.select("u", "a", F.col("b").cast("long").alias("b"), "later"))

    def search(table: pa.Table) -> pa.Table:
        kind, a = table["later"].to_numpy(), table["a"].to_numpy()
        edge = kind == 2
        b = table["b"].fill_null(0).to_numpy()[edge]
        found = _cliques_of(table["u"][0].as_py(), a[kind == 1], a[kind == 0], a[edge], b)
        return pa.table({"size": pa.array([len(c) for c in found], pa.int32()), "clique": pa.array([",".join(map(str, c)) for c in found], pa.string())})

    return rows.groupBy("u").applyInArrow(search, "size int, clique string")


def nearest_leaf(e: DataFrame) -> DataFrame:
    """(u, leaf, dist): the nearest vertex of degree 1, itself included, the least of several; vertices that reach none
    are left out. All leaves are searched from at once, and each vertex takes over the least leaf of what reaches it first."""
    ready_checkpoints(e)
    links = e.select("u", F.col("v").alias("to")).distinct()
    seen = degrees(e).where("degree = 1").select("u", F.col("u").alias("leaf"), F.lit(0).alias("dist")).checkpoint()
    front, d = seen, 0
    while not front.isEmpty():
        d += 1
        step = front.join(links, "u").groupBy(F.col("to").alias("u")).agg(F.min("leaf").alias("leaf"))
        front = step.join(seen, "u", "left_anti").select("u", "leaf", F.lit(d).alias("dist")).checkpoint()
        seen = seen.unionByName(front)
    return seen
