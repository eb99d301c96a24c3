"""Neighbour joining and its outputs. A distance matrix has one row for each pair of collections. `joined` works by rounds of
relations, whatever its size; `neighbour_joining` holds a matrix (n * n numbers, n ** 3 steps; some thousand collections)
in the task of its key, side by side with others, and gives the text of the tree."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.operators.graphs import hops
from seqweft.operators.shared import stored

#: (parent vertex, child vertex, length)
Branch = tuple[int, int, float]


def join_neighbours(d: np.ndarray) -> list[Branch]:
    """Branches of the tree over the taxa 0 to n - 1; inner vertices are numbered from n on.

    The pair with the least corrected distance is joined, the first one by larger and then smaller index of several; the
    new vertex takes the smaller one's place and the last one moves to the larger one's. Negative lengths stay.
    """
    d = np.array(d, float)
    n = len(d)
    names = list(range(n))
    if n < 2:
        return []
    if n == 2:
        return [(0, 1, float(d[0, 1]))]
    out: list[Branch] = []
    new = n
    while len(names) > 3:
        m = len(names)
        r = d[:m, :m].sum(1)
        q = (m - 2) * d[:m, :m] - r[:, None] - r[None]
        i, j = (int(x) for x in divmod(int(np.where(np.tri(m, m, -1, bool), q, np.inf).argmin()), m))
        left = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2))
        out += [(new, names[i], float(left)), (new, names[j], float(d[i, j] - left))]
        row = (d[i, :m] + d[j, :m] - d[i, j]) / 2
        d[j, :m] = d[:m, j] = row
        d[j, j] = 0
        names[j] = new
        last = m - 1
        if i != last:
            d[i, :m] = d[last, :m]
            d[:m, i] = d[:m, last]
            d[i, i] = 0
            names[i] = names[last]
        names.pop()
        d = d[:last, :last]
        new += 1
    a, b, c = d[0, 1], d[0, 2], d[1, 2]
    return [*out, (new, names[0], float((a + b - c) / 2)), (new, names[1], float((a + c - b) / 2)), (new, names[2], float((b + c - a) / 2))]


def adjacency(branches: list[Branch]) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in branches:
        out.setdefault(a, []).insert(0, (b, w))
        out.setdefault(b, []).insert(0, (a, w))
    return out


def _walk(near: dict[int, list[tuple[int, float]]], start: int) -> tuple[list[int], dict[int, int]]:
    order, parent, todo = [], {start: -1}, deque([start])
    while todo:
        u = todo.popleft()
        order.append(u)
        for v, _ in near.get(u, []):
            if v not in parent:
                parent[v] = u
                todo.append(v)
    return order, parent


def center(branches: list[Branch]) -> int:
    """The middle vertex of a longest path by number of branches, nearer to its end of two."""
    near = adjacency(branches)
    end = _walk(near, min(near))[0][-1]
    order, parent = _walk(near, end)
    path, u = [], order[-1]
    while u != -1:
        path.append(u)
        u = parent[u]
    return path[(len(path) - 1) // 2]


def newick(branches: list[Branch], labels: list[str]) -> str:
    """The tree in Newick form, rooted at its center."""
    if len(labels) <= 1:
        return f"({labels[0]});" if labels else ";"
    near = adjacency(branches)
    if len(labels) == 2:
        return f"({labels[0]},{labels[1]}):{branches[0][2]:.16e};"
    root = center(branches)
    order, parent = _walk(near, root)
    text: dict[int, str] = {}
    for u in reversed(order):
        inner = [f"{text[v]}:{w:.16e}" for v, w in near[u] if v != parent[u]]
        text[u] = f"({','.join(inner)})" if inner else labels[u]
    return text[root] + ":0.00;"


def path_lengths(branches: list[Branch], n: int) -> np.ndarray:
    """Sums of lengths between the first n vertices."""
    near, out = adjacency(branches), np.zeros((n, n))
    for s in range(n):
        far, todo = {s: 0.0}, [s]
        while todo:
            u = todo.pop()
            for v, w in near.get(u, []):
                if v not in far:
                    far[v] = far[u] + w
                    todo.append(v)
        out[s] = [far.get(t, np.inf) for t in range(n)]
    return out


def matrix(rows: list[tuple[str, str, float]]) -> tuple[list[str], np.ndarray]:
    """Labels in byte order and the symmetric matrix of (i, j, d) rows."""
    labels = sorted({x for i, j, _ in rows for x in (i, j)}, key=lambda s: s.encode())
    at = {x: k for k, x in enumerate(labels)}
    d = np.zeros((len(labels), len(labels)))
    for i, j, x in rows:
        d[at[i], at[j]] = d[at[j], at[i]] = x
    return labels, d


def neighbour_joining(distances: DataFrame, key: str, value: str) -> DataFrame:
    """(key, newick, n_branches) of one matrix for each key: rows (key, i, j, value)."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, d = matrix(list(pdf[["i", "j", value]].itertuples(index=False, name=None)))
        b = join_neighbours(d)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "newick": [newick(b, labels)], "n_branches": [len(b)]}).astype({key: object, "newick": object})

    return distances.groupBy(key).applyInPandas(tree, f"{key} string, newick string, n_branches int")


def joined(distances: DataFrame, key: str, value: str) -> DataFrame:
    """(key, u, v, w, label): the branches of the tree of each key's distances (key, i, j, value), by rounds of relations;
    label names a taxon where v is one. Gives the tree of join_neighbours.

    In each round, for all keys at once, sums of the rows and the least corrected distance (rounded to 9 places, so that no
    order of summing decides; the first pair by larger and then smaller place of several) name the pair to be joined, and the
    distances are derived anew. There are as many rounds as the largest matrix has taxa, less three; each is stored.
    """
    both = distances.select(key, "i", "j", F.col(value).cast("double").alias("d"))
    both = both.unionByName(both.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    taxa = both.select(key, F.col("i").alias("label")).distinct()
    taxa = stored(taxa.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("label")) - 1), "taxa")  # a row for each taxon of a matrix
    slot = lambda name, out: taxa.select(key, F.col("label").alias(name), F.col("slot").alias(out))
    d = stored(both.join(slot("i", "a"), [key, "i"]).join(slot("j", "b"), [key, "j"]).select(key, "a", "b", "d"), "distances")
    names = taxa.select(key, "slot", F.col("slot").alias("vertex"))
    size = taxa.groupBy(key).agg(F.count("*").cast("int").alias("n")).withColumn("m", F.col("n"))
    most, out = size.agg(F.max("n")).first()[0] or 0, None
    size, names = stored(size, "sizes"), stored(names, "names")
    for _ in range(most - 3):
        open_ = size.where("m > 3")
        sums = d.join(open_, key).groupBy(key, "a").agg(F.sum("d").alias("r"))
        pairs = d.where("a > b").join(open_, key).join(sums, [key, "a"]).join(sums.select(key, F.col("a").alias("b"), F.col("r").alias("s")), [key, "b"])
        q = F.round((F.col("m") - 2) * F.col("d") - F.col("r") - F.col("s"), 9)
        best = pairs.groupBy(key).agg(F.min(F.struct(q.alias("q"), F.col("a").alias("i"), F.col("b").alias("j"), F.col("d").alias("d_ij"), "r", "s", "m", "n")).alias("x"))
        best = stored(best.select(key, "x.*").withColumns({"left": F.col("d_ij") / 2 + (F.col("r") - F.col("s")) / (2 * (F.col("m") - 2)), "new": 2 * F.col("n") - F.col("m")}), "pairs")
        ends = best.select(key, "new", F.explode(F.array(F.struct(F.col("i").alias("slot"), F.col("left").alias("w")), F.struct(F.col("j").alias("slot"), (F.col("d_ij") - F.col("left")).alias("w")))).alias("x"))
        made = ends.select(key, "new", "x.*").join(names, [key, "slot"]).select(key, F.col("new").alias("u"), F.col("vertex").alias("v"), "w")
        out = made if out is None else out.unionByName(made)
        last = F.col("m") - 1
        moved = lambda c: F.when(F.col("i").isNotNull() & (F.col(c) == last), F.col("i")).otherwise(F.col(c)).alias(c)
        # the distances to the pair's first member, which both ends of a row need
        gone = d.join(best.select(key, "i"), key).where(F.col("a") == F.col("i"))
        to = lambda c, name: gone.select(key, F.col("b").alias(c), F.col("d").alias(name))
        rest = d.join(best.select(key, "i", "j", "d_ij", "m"), key, "left").where("i is null or (a <> i and b <> i)").join(to("a", "x"), [key, "a"], "left").join(to("b", "y"), [key, "b"], "left")
        far = F.when(F.col("a") == F.col("j"), (F.col("d") + F.col("y") - F.col("d_ij")) / 2).when(F.col("b") == F.col("j"), (F.col("d") + F.col("x") - F.col("d_ij")) / 2).otherwise(F.col("d"))
        d = stored(rest.select(key, moved("a"), moved("b"), far.alias("d")), "distances")
        own = names.join(best.select(key, "i", "j", "new", "m"), key, "left").where("i is null or slot <> i")
        names = stored(own.select(key, moved("slot"), F.when(F.col("slot") == F.col("j"), F.col("new")).otherwise(F.col("vertex")).alias("vertex")), "names")
        size = stored(size.withColumn("m", F.when(F.col("m") > 3, F.col("m") - 1).otherwise(F.col("m"))), "sizes")
    at = F.map_from_entries(F.collect_list(F.struct((10 * F.col("a") + F.col("b")).alias("k"), "d")))
    three = d.where("a < b").join(size, key).groupBy(key, "n", "m").agg(at.alias("x"))
    x = lambda k: F.try_element_at("x", F.lit(k))
    length = F.when(F.col("slot") == 0, (x(1) + x(2) - x(12)) / 2).when(F.col("slot") == 1, (x(1) + x(12) - x(2)) / 2).otherwise((x(2) + x(12) - x(1)) / 2)
    star = three.where("m = 3").join(names, key).select(key, (2 * F.col("n") - 3).alias("u"), F.col("vertex").alias("v"), length.alias("w"))
    two = three.where("m = 2").select(key, F.lit(0).alias("u"), F.lit(1).alias("v"), x(1).alias("w"))
    out = star.unionByName(two) if out is None else out.unionByName(star).unionByName(two)
    return out.join(taxa.select(key, F.col("slot").alias("v"), "label"), [key, "v"], "left").select(key, F.col("u").cast("int"), F.col("v").cast("int"), "w", "label")


def paths_between(branches: DataFrame, key: str) -> DataFrame:
    """(key, i, j, d): sums of lengths between the taxa (branches' v with a label) of each key's tree, each to itself too."""
    named = F.struct(F.col(key), "x")
    flat = stored(branches.select(key, "u", "v", "w", "label"), "branches")
    e = flat.select(named_vertex(key, "u"), named_vertex(key, "v"), "w")
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    two = flat.where("u = 0 and label is not null").select(key, F.col("u").alias("x"))  # of two taxa the first is no child
    taxa = flat.where("label is not null").select(key, F.col("v").alias("x")).union(two).distinct().select(named.alias("u"))
    found = hops(e, taxa, "w").join(taxa, "u", "left_semi")
    return found.select(F.col("source")[key].alias(key), F.col("source")["x"].alias("i"), F.col("u")["x"].alias("j"), F.col("far").alias("d"))


def named_vertex(key: str, c: str):
    return F.struct(F.col(key), F.col(c).alias("x")).alias(c)


def folded(tree: DataFrame, root: DataFrame, places: int = 1) -> DataFrame:
    """(source, newick) of a tree (u, v, w both ways) for each root (u): numbered vertices, children in ascending order,
    lengths with `places` decimals. Texts are folded from the leaves upwards, one aggregation for each level."""
    walk = stored(hops(tree.select("u", "v", "w"), root, "w", parents=True).join(tree.select(F.col("u").alias("parent"), F.col("v").alias("u"), "w"), ["parent", "u"], "left"), "walk")
    below = None
    for level in range(walk.agg(F.max("dist")).first()[0] or 0, -1, -1):
        own = walk.where(F.col("dist") == level).select("source", "parent", "u", "w")
        text = F.col("u").cast("string")
        if below is not None:
            own = own.join(below, ["source", "u"], "left")
            text = F.when(F.col("inner").isNotNull(), F.concat(F.lit("("), "inner", F.lit(")"), text)).otherwise(text)
        if not level:
            return own.select("source", F.concat(text, F.lit(f":{0:.{places}f};")).alias("newick"))
        entry = F.struct("u", F.concat(text, F.format_string(f":%.{places}f", "w")).alias("t"))
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ",")
        below = stored(own.groupBy("source", F.col("parent").alias("u")).agg(inner.alias("inner")), "texts")
