"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The terms are the words, and the beginnings of words, that tell the classes of the labelled sample apart, for either
class; how clearly they must do so is chosen by cross-validation over the sample. Their document frequencies are counted
over all documents. The index holds a bounded number of labelled examples in blocks with each term's largest weight, so that blocks which can't
hold a nearest example are skipped; the neighbours found are exact. Sample, vocabulary and index have fixed bounds and
are broadcast; documents are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm._arrow import LOWER, id_and_text, mix, powers, slices, utf8, words, written
from seqweft.llm.quality import held_out, pool_adjacent

#: Labelled rows that are learnt at most (those with the smallest hashes of their ids), words and beginnings that are
#: terms at most (each), learnt rows that the index holds at most (again by hash), neighbours, examples in a block.
SAMPLE, TERMS, EXAMPLES, NEIGHBOURS, BLOCK = 20_000, 2_000, 5_000, 15, 64
#: Least z-scores of a term that cross-validation chooses from, its folds, least score of a text that is called toxic.
LEAST_ZS, FOLDS, TOXIC = (3.0, 4.0, 5.0, 6.0), 4, 0.3
#: Blocks whose scores are taken at once at first, examples that calibrate the scores (or validate a fold) at most.
_AT_ONCE, CALIBRATING = 8, 500

#: Lengths in bytes of the beginnings of words that are terms too.
PREFIXES = (4, 5, 6, 7, 8, 9)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Index(NamedTuple):
    """Examples in blocks. A term's postings in a block are places[start[term, block] : start[term, block + 1]], with
    their weights; block_max[term, block] is the largest of them."""

    terms: np.ndarray
    idf: np.ndarray
    start: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray
    labels: np.ndarray
    ids: list
    base: float
    edges: np.ndarray
    levels: np.ndarray


class Postings(NamedTuple):
    """Terms of examples, unnormalised weights, sorted by example."""

    doc: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def unit(self, keep: np.ndarray, n: int) -> Postings:
        """Only the kept terms (renumbered), each of the n examples scaled to length 1."""
        own = keep[self.term]
        doc, term, w = self.doc[own], (np.cumsum(keep) - 1)[self.term[own]], self.weight[own]
        return Postings(doc, term, w / np.sqrt(np.bincount(doc, w * w, n))[doc])

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.doc, [d, d + 1])
        return self.term[a:b], self.weight[a:b]


def term_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The words of all texts, then their beginnings of PREFIXES bytes, as hashes, with the texts that they are in, and
    how many are words."""
    data, off = utf8(array)
    first, stop, ids, at = words(data, off, LOWER, _WORD)
    owner = np.repeat(np.arange(len(array)), np.diff(at))
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes, owners = [ids], [owner]
    for k in PREFIXES:
        own = stop - first > k
        f = first[own]
        hashes.append(mix((total[f + k] - total[f]) * down[f] + np.uint64(k << 32)))
        owners.append(owner[own])
    return np.concatenate(hashes), np.concatenate(owners), len(ids)


def term_counts(array: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often) for the known terms; terms: sorted hashes."""
    hashes, owner, _ = term_hashes(array)
    place = np.searchsorted(terms, hashes)
    place[place == len(terms)] = 0
    known = np.flatnonzero(terms[place] == hashes) if len(terms) else np.zeros(0, np.int64)
    key, n = np.unique(owner[known] * np.int64(max(1, len(terms))) + place[known], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), n


def vectors(array: pa.Array, terms: np.ndarray, idf: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF vectors of the texts that have any of the terms."""
    doc, term, n = term_counts(array, terms)
    w = (1 + np.log(n)) * idf[term]
    out = {}
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        v = w[a:b]
        out[d] = (term[a:b], v / np.sqrt((v * v).sum()))
    return out


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
    """The k examples with the largest cosine above 0, equal ones by their place; blocks that can't hold one are skipped.

    skip: an example that doesn't count (the query itself).
    """
    bound = weights @ index.block_max[terms]
    blocks = np.argsort(-bound, kind="stable")
    blocks = blocks[bound[blocks] > 0]
    best_score, best_place = np.zeros(0), np.zeros(0, np.int64)
    at, many = 0, _AT_ONCE
    while at < len(blocks):
        own = blocks[at : at + many]
        if len(best_score) == k and bound[own[0]] < best_score[-1] - 1e-12:
            break
        at, many = at + many, many * 2
        first = index.start[terms[:, None], own[None]].ravel()
        n = index.start[terms[:, None], own[None] + 1].ravel() - first
        posting = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        local = np.repeat(np.tile(np.arange(len(own)) * BLOCK, len(terms)), n) + index.places[posting] % BLOCK
        score = np.bincount(local, np.repeat(np.repeat(weights, len(own)), n) * index.weights[posting], len(own) * BLOCK).reshape(-1, BLOCK)
        b, i = np.nonzero(score > 0)
        place = own[b] * BLOCK + i
        found = place != skip
        best_score, best_place = np.concatenate([best_score, score[b, i][found]]), np.concatenate([best_place, place[found]])
        order = np.lexsort((best_place, -best_score))[:k]
        best_score, best_place = best_score[order], best_place[order]
    return list(zip(best_score.tolist(), best_place.tolist(), strict=True))


def vote(index: Index, near: list[tuple[float, int]]) -> float:
    """Votes weighted by closeness, with one vote of the base rate at the distance of an orthogonal example."""
    num, den = index.base * 0.05, 0.05
    for s, i in near:
        w = 1 / (1.05 - min(s, 1.0))
        num += w * index.labels[i]
        den += w
    return num / den


def build(terms: np.ndarray, idf: np.ndarray, unit: Postings, y: np.ndarray, ids: list) -> Index:
    """Index over the examples of `unit`, calibrated by votes of which each example's own is left out."""
    top = np.lexsort((unit.term, -unit.weight, unit.doc))
    own, first = np.unique(unit.doc[top], return_index=True)
    own = own[np.lexsort((own, unit.term[top][first]))]  # alike examples share blocks
    rank, n_blocks = np.zeros(len(y), np.int64), -(-len(own) // BLOCK)
    rank[own] = np.arange(len(own))
    order = np.lexsort((rank[unit.doc], unit.term))
    term, place, w = unit.term[order], rank[unit.doc][order], unit.weight[order]
    start = np.searchsorted(term * (n_blocks + 1) + place // BLOCK, np.arange(len(terms))[:, None] * (n_blocks + 1) + np.arange(n_blocks + 1)[None])
    block_max = np.zeros((len(terms), n_blocks))
    np.maximum.at(block_max, (term, place // BLOCK), w)
    none = np.setdiff1d(np.arange(len(y)), own)
    base = float((y[none].sum() + 0.01) / (len(none) + 1))
    index = Index(terms, idf, start, place, w, block_max, y[own], [ids[d] for d in own], base, np.zeros(0), np.zeros(1))
    some = np.arange(0, len(own), max(1, -(-len(own) // CALIBRATING)))
    votes = np.array([vote(index, nearest(index, *unit.of(own[i]), NEIGHBOURS, i)) for i in some.tolist()])
    bins = np.minimum((votes * 20).astype(int), 19)
    p, c = np.bincount(bins, index.labels[some], 20), np.bincount(bins, minlength=20)
    used = c > 0
    return index._replace(edges=(np.flatnonzero(used) + 0.5) / 20, levels=pool_adjacent(p[used] + 1e-9, c[used].astype(float)))


def rated(index: Index, terms: np.ndarray, weights: np.ndarray) -> tuple[float, list]:
    """The score of a text with these terms, and the nearest examples."""
    near = nearest(index, terms, weights, NEIGHBOURS)
    v = vote(index, near)
    return float(np.interp(v, index.edges, index.levels)) if len(index.edges) else v, [index.ids[i] for _, i in near[:3]]


def clear(z: np.ndarray, word: np.ndarray, least: float) -> np.ndarray:
    """Which terms to keep: TERMS words and TERMS beginnings at most, the clearest, of either class."""
    keep = np.zeros(len(z), bool)
    for own in (np.flatnonzero(word), np.flatnonzero(~word)):
        own = own[np.abs(z[own]) >= least]
        keep[own[np.lexsort((own, -np.abs(z[own])))[:TERMS]]] = True
    return keep


def chosen_z(all_terms: Postings, y: np.ndarray, fold: np.ndarray, z: dict[int, np.ndarray], word: np.ndarray) -> float:
    """The least z with the largest sum of recall and share of clean examples left alone, over folds that neither chose
    the terms nor are in the index; of equal ones the lowest, with which most texts have terms."""
    best = (-1.0, LEAST_ZS[0])
    for least in LEAST_ZS:
        right, count = np.zeros(2), np.zeros(2)
        for f, own_z in z.items():
            keep = clear(own_z, word, least)
            unit = all_terms.unit(keep, len(y))
            out = fold[unit.doc] != f
            learnt, rows = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            at = np.cumsum(fold != f) - 1
            index = build(np.flatnonzero(keep), np.zeros(0), Postings(at[unit.doc[out]], unit.term[out], unit.weight[out]), y[learnt], learnt.tolist())
            for d in rows[:: max(1, -(-len(rows) // CALIBRATING))].tolist():
                terms, weights = unit.of(d)
                called = (rated(index, terms, weights)[0] if len(terms) else index.base) >= TOXIC
                right[int(y[d])] += called == (y[d] > 0)
                count[int(y[d])] += 1
        worth = float((right / np.maximum(count, 1)).sum())
        if worth > best[0] + 1e-12:
            best = (worth, least)
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, least_z: float | None) -> Index:
    """Choose terms, count their document frequencies over all of docs (id, text), build the index and calibrate it."""
    spark = docs.sparkSession
    rows = labels.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so its broadcast is
    known = docs.join(F.broadcast(rows), "id").dropDuplicates(["text"]).select("id", "text", "y").orderBy(F.xxhash64("id"), "id").limit(sample)
    # the limit leaves one partition: deal the examples out before their terms are taken
    known = known.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    known = written(known.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "examples")
    sizes = {r["fold"]: (r["n"], r["pos"]) for r in known.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    n, pos = (sum(x) for x in zip(*sizes.values(), strict=True)) if sizes else (0, 0.0)
    if not 0 < pos < n:
        return Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), np.zeros(0), [], (pos + 0.5) / (n + 1), np.zeros(0), np.zeros(1))

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, owner, n_words = term_hashes(batch.column("text"))
            at = np.lexsort((hashes, owner))
            at = at[np.append(True, (hashes[at][1:] != hashes[at][:-1]) | (owner[at][1:] != owner[at][:-1]))[: len(at)]]
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False)[owner[at]] for c in ("y", "fold"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(at < n_words), pa.array(y), pa.array(fold)], ["term", "word", "y", "fold"])

    def z_score(p, c, pos: float, n: int):
        a, b = p / pos, (c - p) / (n - pos)
        mid = (a + b) / 2
        return (a - b) / F.sqrt(mid * (1 - mid) * (1 / pos + 1 / (n - pos)) + 1e-9)

    seen = known.select("text", "y", "fold").mapInArrow(occurring, "term long, word boolean, y double, fold int")
    parts = [g for f in range(FOLDS) for g in (F.sum(F.when(F.col("fold") == f, F.col("y")).otherwise(0.0)).alias(f"p{f}"), F.sum((F.col("fold") == f).cast("double")).alias(f"c{f}"))]
    counts = seen.groupBy("term", "word").agg(F.sum("y").alias("p"), F.count("*").cast("double").alias("c"), *parts)
    left = {f: (pos - b, n - a) for f, (a, b) in sorted(sizes.items()) if 0 < pos - b < n - a} if least_z is None else {}
    scores = [z_score(F.col("p"), F.col("c"), pos, n).alias("z")] + [z_score(F.col("p") - F.col(f"p{f}"), F.col("c") - F.col(f"c{f}"), *left[f]).alias(f"z{f}") for f in left]
    lowest = LEAST_ZS[0] if least_z is None else least_z
    clearest = F.array_max(F.array(*[F.abs(F.col(c)) for c in ("z", *(f"z{f}" for f in left))]))
    counts = written(counts.select("term", "word", *scores).withColumn("clearest", clearest).where(F.col("clearest") >= lowest), "terms")
    # The full sample's own choice whole, and the clearest of the folds' beside it: a bounded number in all.
    some = [counts.where(F.col("word") == w).orderBy(F.desc(c), "term").limit(TERMS * k) for w in (True, False) for c, k in ((F.abs(F.col("z")), 1), (F.col("clearest"), 2))]
    rows = some[0].unionByName(some[1]).unionByName(some[2]).unionByName(some[3]).distinct().collect()
    rows.sort(key=lambda r: r["term"] % (1 << 64))
    terms = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    word = np.array([r["word"] for r in rows], bool)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(terms), np.int64), 0
        for batch in slices(batches):
            total += batch.num_rows
            df += np.bincount(term_counts(batch.column("text"), terms)[1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(terms))], pa.int64()), pa.array([total, *df.tolist()], pa.int64())], ["term", "n"])

    df = dict(docs.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    idf = np.array([np.log((1 + df[-1]) / (1 + df[t])) + 1 for t in range(len(terms))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, term, times = term_counts(batch.column("text"), terms)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            cols = [[x[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:], strict=False)] for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), *(pa.array(c, pa.binary()) for c in cols)], ["id", "y", "fold", "terms", "times"])

    kind = known.schema["id"].dataType.simpleString()
    indexed = written(known.orderBy(F.xxhash64("id"), "id").limit(EXAMPLES), "indexed").select("id", "text", "y", "fold").repartition(8)
    rows_of = indexed.mapInArrow(counted, f"id {kind}, y double, fold int, terms binary, times binary").orderBy("id").collect()  # EXAMPLES rows at most
    held = [np.frombuffer(bytes(r["terms"]), np.int32).astype(np.int64) for r in rows_of]
    times = np.concatenate([np.frombuffer(bytes(r["times"]), np.int32) for r in rows_of])
    term = np.concatenate(held)
    all_terms = Postings(np.repeat(np.arange(len(held)), [len(x) for x in held]), term, (1 + np.log(times)) * idf[term])
    y, fold = np.array([r["y"] for r in rows_of]), np.array([r["fold"] for r in rows_of])
    if least_z is None:
        least_z = chosen_z(all_terms, y, fold, {f: np.array([r[f"z{f}"] for r in rows]) for f in left}, word)
    keep = clear(np.array([r["z"] for r in rows]), word, least_z)
    return build(terms[keep], idf[keep], all_terms.unit(keep, len(y)), y, [r["id"] for r in rows_of])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, least_z: float | None = None) -> DataFrame:
    """Per row of docs: id, held_out, score (0 to 1, higher: label 1 likelier), evidence (ids of the nearest examples).

    least_z: least z-score of a term; None: chosen from LEAST_ZS by cross-validation over what may be learnt.
    Labels of held-out ids, null labels and null ids aren't learnt; of equal labelled texts one is an example. Null and
    empty texts, and texts without any of the terms, get the rate of the examples without terms and no evidence.
    """
    source = id_and_text(docs, id_col, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fit(source, known, label_col, sample, least_z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        kept: dict[tuple[bytes, bytes], tuple[float, list]] = {}
        for batch in slices(batches):
            scores, evidence = np.full(batch.num_rows, index.base), [[] for _ in range(batch.num_rows)]
            for d, (t, w) in vectors(batch.column("text"), index.terms, index.idf).items():
                key = (t.tobytes(), np.round(w, 9).tobytes())
                if key not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    kept[key] = rated(index, t, w)
                scores[d], evidence[d] = kept[key]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.clip(scores, 0, 1)), pa.array(evidence, pa.list_(batch.schema.field("id").type))], ["id", "score", "evidence"])

    return source.mapInArrow(run, f"id {kind}, score double, evidence array<{kind}>").select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "evidence")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
