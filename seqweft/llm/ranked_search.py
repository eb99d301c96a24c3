"""Ranked lexical search with Block-Max MaxScore over a written index.

The index is a folder of segments, each an inverted index of some thousand documents: terms as 64-bit hashes, and for each
term its postings in blocks of 128, packed to as many bits as they need, with the block's first document and the largest
part that a posting of it can give to a score. A search takes the lists of an item's terms by falling bound. As long as
the bounds of the lists left could lift a document over the threshold, the tenth best score so far, a list is essential
and read whole. After that only documents met so far count; sums of block maxima reject most of them before any block of
the other lists is unpacked. Each task keeps a heap of ten for each item over its segments, so the threshold rises from
one segment to the next; the heaps of all tasks are merged in two steps.

Scores are whole numbers, exact and the same however documents are dealt to segments.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweft.llm._arrow import LOWER, give_back, id_and_text, opened, shared_folder, slices, small_batches, utf8, words, written

#: Results for an item; documents and postings of a segment at most (one slice of texts may exceed them); postings of a block.
TOP, SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK = 10, 8192, 1 << 19, 128
#: Bytes of items that are searched for in one pass, and parts into which heaps are dealt before the last merge.
ITEM_BYTES, HEAP_PARTS = 4 << 20, 64

_INSIDE = np.ones(256, bool)
_INSIDE[0x00:0x30] = _INSIDE[0x3A:0x41] = _INSIDE[0x5B:0x61] = _INSIDE[0x7B:0x80] = False
_NO_ID = np.iinfo(np.int64).max


class Corpus(NamedTuple):
    """Documents with at least one term, and the terms of all documents with repeats."""

    documents: int
    terms: int


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for batch in slices(batches):
            data, off = utf8(batch.column("text"))
            mask = _INSIDE[data]
            begin = mask.copy()
            begin[1:] &= ~mask[:-1]
            edge = off[:-1][off[:-1] < len(data)]
            begin[edge] = mask[edge]
            n = np.diff(np.append(0, np.cumsum(begin))[off])
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["some", "total"])

    r = id_and_text(docs, id_col, text_col).select("text").mapInArrow(run, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    return Corpus(r[0] or 0, r[1] or 0)


def weight(corpus: Corpus, df: int) -> int:
    return math.floor(1000 * math.log((2 * corpus.documents + 2) / (2 * df + 1)))


def part(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What tf occurrences in a document of n terms give for each unit of a term's weight."""
    m = 25 + 75 * n * corpus.documents // max(1, corpus.terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def unpack(data: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes as rows of whole numbers; a row holds BLOCK of them."""
    bits = np.unpackbits(data, axis=1).reshape(len(data), BLOCK, width)
    return bits @ (1 << np.arange(width))


#: What a segment's row holds. The postings of list t begin at byte places[t]: its blocks' gaps, then their counts.
_SEGMENT = "ids binary, lengths binary, terms binary, counts binary, widths binary, places binary, bounds binary, firsts binary, maxima binary, postings binary"


def segment(ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, corpus: Corpus) -> list[bytes]:
    """The row of documents (ids, lengths) with postings (doc, term, tf) by ascending document."""
    order = np.argsort(term, kind="stable")
    term = term[order]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
    terms, counts = term[first], np.diff(np.append(first, len(term)))
    del term
    doc, tf = doc[order].astype(np.int32), tf[order].astype(np.int32)
    del order
    give = part(tf.astype(np.int64), lengths[doc], corpus).astype(np.int32)
    blocks = -(-counts // BLOCK)
    starts = np.cumsum(blocks) - blocks
    within = (np.arange(len(doc)) - np.repeat(first, counts)).astype(np.int32)
    opens = np.flatnonzero(within % BLOCK == 0)
    maxima, firsts = (np.maximum.reduceat(give, opens), doc[opens]) if len(opens) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    del give
    gap = np.append(np.int32(0), np.diff(doc)) if len(doc) else doc
    gap[opens] = 0
    bits = lambda x: np.ceil(np.log2(np.maximum(x, 1) + 1)).astype(np.int64)
    gap_width = bits(np.maximum.reduceat(gap, first)) if len(first) else counts
    tf_width = bits(np.maximum.reduceat(tf, first)) if len(first) else counts
    size = (gap_width + tf_width) * (BLOCK // 8) * blocks
    places = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    # lists of equal widths are packed together
    kind = gap_width * 64 + tf_width
    for w in np.unique(kind).tolist():
        own = np.flatnonzero(kind == w)
        rows = np.repeat(own, counts[own])
        at = np.repeat(first[own], counts[own]) + np.arange(len(rows)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        block_of = np.repeat(np.cumsum(blocks[own]) - blocks[own], counts[own]) + within[at] // BLOCK
        for values, width, skip in ((gap, w // 64, 0), (tf, w % 64, 1)):
            grid = np.zeros((int(blocks[own].sum()), BLOCK), np.int32)
            grid[block_of, within[at] % BLOCK] = values[at]
            for a in range(0, len(grid), 1024):
                packed = np.packbits(((grid[a : a + 1024, :, None] >> np.arange(width, dtype=np.int32)) & 1).astype(np.uint8).reshape(-1, BLOCK * width), axis=1)
                k = np.arange(a, a + len(packed))
                owner = np.searchsorted(np.cumsum(blocks[own]), k, "right")
                inner = k - (np.cumsum(blocks[own]) - blocks[own])[owner]
                base = places[own][owner] + skip * (w // 64) * (BLOCK // 8) * blocks[own][owner] + inner * width * (BLOCK // 8)
                out[base[:, None] + np.arange(packed.shape[1])] = packed
    bounds = np.maximum.reduceat(maxima, starts) if len(starts) else maxima
    columns = (ids.astype("<i8"), lengths.astype("<i4"), terms.astype("<u8"), counts.astype("<i4"), kind.astype("<u2"), places.astype("<i8"), bounds.astype("<i4"), firsts.astype("<i4"), maxima.astype("<i4"), out)
    return [c.tobytes() for c in columns]


class Segment:
    """An inverted index of some documents."""

    def __init__(self, row: dict[str, bytes | pa.Buffer], corpus: Corpus):
        kinds = {"ids": "<i8", "lengths": "<i4", "terms": "<u8", "counts": "<i4", "widths": "<u2", "places": "<i8", "bounds": "<i4", "firsts": "<i4", "maxima": "<i4", "postings": "u1"}
        self.__dict__.update({c: np.frombuffer(row[c], k) for c, k in kinds.items()})
        self.corpus, self.lengths = corpus, self.lengths.astype(np.int64)
        blocks = -(-self.counts.astype(np.int64) // BLOCK)
        self.ends = np.cumsum(blocks)
        self.starts, self.kept = self.ends - blocks, {}

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms occur, and their lists."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        known = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        return known, at[known]

    def blocks(self, t: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, parts) of the blocks `which` of list t, or of all of them, which are kept for other items."""
        if t in self.kept:
            return self.kept[t]
        start, end, count = int(self.starts[t]), int(self.ends[t]), int(self.counts[t])
        own = np.arange(end - start) if which is None else which
        gw, tw = divmod(int(self.widths[t]), 64)
        step, place = BLOCK // 8, int(self.places[t])
        total = (end - start) * step
        gaps = self.postings[place : place + total * gw].reshape(end - start, step * gw)[own]
        tfs = self.postings[place + total * gw : place + total * (gw + tw)].reshape(end - start, step * tw)[own]
        doc = self.firsts[start:end][own].astype(np.int64)[:, None] + np.cumsum(unpack(gaps, gw), 1)
        full = own[:, None] * BLOCK + np.arange(BLOCK) < count
        doc = doc[full]
        made = doc, part(unpack(tfs, tw)[full], self.lengths[doc], self.corpus)
        if which is None:
            self.kept[t] = made
        return made

    def search(self, lists: np.ndarray, weights: np.ndarray, heap: tuple[np.ndarray, np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids) of the heap and of this segment's documents for the weighted lists."""
        bound = self.bounds[lists].astype(np.int64) * weights
        order = np.argsort(-bound, kind="stable")
        lists, weights, bound = lists[order], weights[order], bound[order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the lists from here on give at most
        least = int(heap[0].min()) if len(heap[0]) == top else 1
        if left[0] < least:
            return heap
        score, k = np.zeros(len(self.ids), np.int64), 0
        while k < len(lists) and left[k] >= least:
            doc, give = self.blocks(int(lists[k]))
            score[doc] += weights[k] * give
            k += 1
            if k % 2 == 0 and len(score) > top:  # scores so far are lower bounds
                least = max(least, int(np.partition(score, len(score) - top)[len(score) - top]))
        found = np.flatnonzero((score > 0) & (score + left[k] >= least))
        score = score[found]
        if k < len(lists) and len(found):
            # block maxima of the other lists, before anything of them is unpacked
            place, most = [], []
            for t, w in zip(lists[k:].tolist(), weights[k:].tolist(), strict=True):
                firsts = self.firsts[self.starts[t] : self.ends[t]]
                at = np.searchsorted(firsts, found, "right") - 1
                place.append(at)
                most.append(np.where(at < 0, 0, self.maxima[self.starts[t] : self.ends[t]][at].astype(np.int64) * w))
            place, most = np.array(place), np.array(most)
            rest = most.sum(0)
            for j, (t, w) in enumerate(zip(lists[k:].tolist(), weights[k:].tolist(), strict=True)):
                stays = score + rest >= least
                if not stays.all():
                    found, score, rest, place, most = found[stays], score[stays], rest[stays], place[:, stays], most[:, stays]
                if not len(found):
                    break
                rest = rest - most[j]
                need = np.unique(place[j][place[j] >= 0])
                if len(need):
                    doc, give = self.blocks(t, need)
                    at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                    score = score + np.where(doc[at] == found, give[at] * w, 0)
        own = np.flatnonzero(score >= least)
        return _best(np.append(heap[0], score[own]), np.append(heap[1], self.ids[found[own]]), top)


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def index(docs: DataFrame, corpus: Corpus, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(name): the files of an index of all documents that have a term, below `folder`, which executors share.

    Each task makes segments of its own rows, which bounds what it holds, and writes them to a file of its attempt, a
    record batch each; nothing is shuffled, and segments don't pass through the JVM. The names of files that count are
    written last; one row for each task goes through the driver.
    """
    spark = docs.sparkSession
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    source = id_and_text(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    names = [c.split()[0] for c in _SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs_held = postings_held = 0
        name, file, out = f"{uuid.uuid4().hex}.arrow", None, None

        def add() -> None:
            nonlocal file, out
            ids, lengths, doc, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            row = segment(ids, lengths, doc, term, tf, corpus)
            del ids, lengths, doc, term, tf
            batch = pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names)
            if out is None:
                store, place = opened(folder)
                file = store.open_output_stream(f"{place}/{name}", compression=None)
                out = pa.ipc.new_file(file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(batch)
            give_back()

        for batch in slices(batches):
            data, off = utf8(batch.column("text"))
            _, _, term, at = words(data, off, LOWER, _INSIDE)
            n = np.diff(at)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            doc = np.repeat(np.arange(len(some)), n[some])
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))
            if docs_held and (docs_held + len(some) > SEGMENT_DOCS or postings_held + len(first) > SEGMENT_POSTINGS):
                add()
                docs_held = postings_held = 0
            ids = batch.column("id").fill_null(_NO_ID).to_numpy()[some]
            held.append((ids, n[some], (doc[first] + docs_held).astype(np.int32), term[first], np.diff(np.append(first, len(doc))).astype(np.int32)))
            docs_held, postings_held = docs_held + len(some), postings_held + len(first)
        if held:
            add()
        if out is not None:
            out.close()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    made = written(source.mapInArrow(run, "name string"), "index").collect()
    return spark.createDataFrame(made, "name string").repartition(max(1, len(made)))


def _segments(folder: str, batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, pa.Buffer]]:
    """The segments of the files named, one after the other, with some of their columns."""
    store, place = opened(folder)
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    wanted = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns])
    for batch in batches:
        for name in batch.column("name").to_pylist():
            with store.open_input_file(f"{place}/{name}") as f:
                reader = pa.ipc.open_file(f, options=wanted)
                for k in range(reader.num_record_batches):
                    own = reader.get_batch(k)
                    yield {c: own.column(c)[0].as_buffer() for c in columns}


class Items(NamedTuple):
    """Items that are searched for in one pass: different terms, and for each item which it has, and how often."""

    numbers: list[int]
    terms: np.ndarray
    which: list[np.ndarray]
    times: list[np.ndarray]


def _parsed(rows: list[tuple[int, str]]) -> Items:
    data, off = utf8(pa.array([t for _, t in rows], pa.string()))
    _, _, term, at = words(data, off, LOWER, _INSIDE)
    terms, place = np.unique(term, return_inverse=True)
    own = [np.unique(place[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
    return Items([k for k, _ in rows], terms, [w for w, _ in own], [n for _, n in own])


def _frequencies(files: DataFrame, folder: str, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each term, from two columns of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _segments(folder, batches, ["terms", "counts"]):
            known, counts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["counts"], "<i4")
            at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            total += np.where(known[at] == terms, counts[at], 0)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in files.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # no more rows than the pass has terms
    return out


def _heaps(files: DataFrame, folder: str, items: Items, corpus: Corpus, top: int) -> DataFrame:
    """(item, part, id, score): the best documents of each task for each item of one pass."""
    df = _frequencies(files, folder, items.terms)
    weights = np.array([weight(corpus, d) if d else 0 for d in df.tolist()], np.int64)
    shared = files.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, weights = shared.value
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.numbers)
        for row in _segments(folder, batches, [c.split()[0] for c in _SEGMENT.split(", ")]):
            own = Segment(row, corpus)
            known, lists = own.find(items.terms)
            list_of = np.full(len(items.terms), -1)
            list_of[known] = lists
            for q, (which, times) in enumerate(zip(items.which, items.times, strict=True)):
                w = weights[which] * times
                ok = (list_of[which] >= 0) & (w > 0)
                if ok.any():
                    heaps[q] = own.search(list_of[which][ok], w[ok], heaps[q], top)
            del own, row
            give_back()
        n = [len(s) for s, _ in heaps]
        ids = np.concatenate([i for _, i in heaps]) if heaps else np.zeros(0, np.int64)
        scores = np.concatenate([s for s, _ in heaps]) if heaps else ids
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(items.numbers, np.int64), n)), pa.array(np.full(len(ids), TaskContext.get().partitionId() % HEAP_PARTS)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "part", "id", "score"])

    return files.mapInArrow(run, "item long, part long, id long, score long")


def _passes(items: DataFrame, text_col: str, item_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """(number, text) of the items in lists of bounded size; the driver holds one list at a time."""
    held, size = [], 0
    for number, text in items.where(F.length(text_col) > 0).select("_number", text_col).toLocalIterator():
        if held and size + len(text) > item_bytes:
            yield held
            held, size = [], 0
        held.append((number, text))
        size += len(text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, id, score): for each row of items its `top` documents with a score above 0, equal scores by ascending id.

    Null and blank texts have no terms: such documents aren't counted, and such items find nothing. Rows that repeat an id
    are documents, or items, of their own; a document without an id comes after others with its score. Ids of documents
    are whole numbers. Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    corpus = counted(docs, id_col, text_col)
    folder = f"{shared_folder(spark)}-index"
    files = index(docs, corpus, folder, id_col, text_col)
    numbered = written(items.select(F.col(item_col).alias("_item"), F.col(item_text_col).cast("string").alias("_text")).withColumn("_number", F.monotonically_increasing_id()), "items")
    found = None
    for rows in _passes(numbered, "_text", item_bytes):
        heaps = _heaps(files, folder, _parsed(rows), corpus, top)
        for keys in (["item", "part"], ["item"]):
            best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
            heaps = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        own = written(heaps.select("item", "rank", "id", "score"), "found")
        found = own if found is None else found.unionByName(own)
    system, path = opened(folder)
    system.delete_dir(path)  # what was found is written
    kinds = f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, rank int, `{id_col}` long, score long"
    if found is None:
        return spark.createDataFrame([], kinds)
    named = found.join(numbered.select(F.col("_number").alias("item"), "_item"), "item")
    return named.select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], top: int = TOP) -> list[tuple[int, int, int, int]]:
    """The contract document by document, for tests on small tables."""
    import re
    from collections import Counter

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    own = [(d, Counter(split(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    df = Counter(w for _, c, _ in own for w in c)
    n, total = len(own), sum(x for _, _, x in own)
    out = []
    for k, t in items:
        scored = []
        for d, c, size in own:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in split(t) if w in c)
            if s > 0:
                scored.append((-s, d))
        out += [(k, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top])]
    return out
