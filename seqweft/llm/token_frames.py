"""Token ids of documents in seekable files: one independent zstandard frame for each document, and a trailing seek table.

A file is a row of zstandard frames as any decoder reads them. After the frames of the documents come two skippable
frames: a table of documents (id, number of ids) and the seek table of the public seekable format, whose entries hold the
compressed size, the size and a checksum of each frame. A reader takes the tables from the end of a file and then only the
frames of the documents it is asked for.

Rows are dealt to tasks by ranges of their ids, so the files in order hold all documents in ascending order. A task cuts
its texts into the pieces that the tokenizer treats one by one, encodes each different piece once with the tokenizers
library, and puts the ids of a text together from those. Files of tasks that failed are no part of a folder: the manifest,
written last by Spark, names the files that are.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.llm._arrow import BASE, id_and_text, mix, opened, powers, release, shared_folder, slices, utf8
from seqweft.llm.bpe import byte_symbols

#: The id that ends a document, most bytes of a tokenizer file (it is sent to all executors), places for the pieces that a
#: worker keeps, as a power of two, and most ids of them.
END, MOST_SPEC, SLOT_BITS, KEPT_IDS = 0, 64 << 20, 22, 12 << 20
#: Bytes of frames that a reader takes from a file at once, and rows of one batch of results.
READ_BYTES, BATCH_ROWS = 4 << 20, 8192

# Fixed values of the zstandard formats: skippable frame, seek table, end of a seek table; flag of checksums.
_SKIPPABLE, _SEEK_FRAME, _SEEK_END, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("stored", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOCUMENT = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "<u4")])
_NO_ID = 1

# Pieces: 1 letters, 2 numbers, 3 other characters, 0 white space.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _kind(c: int) -> int:
    return _SPACE if c in _WHITE else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)


_ASCII = np.array([_kind(c) if c < 128 else 0 for c in range(256)], np.uint8)
_KINDS: dict[int, int] = {}


def _kinds_of(points: np.ndarray) -> np.ndarray:
    different, at = np.unique(points, return_inverse=True)
    for c in different.tolist():
        if c not in _KINDS:
            _KINDS[c] = _kind(c)
    return np.array([_KINDS[c] for c in different.tolist()], np.uint8)[at]


def _character_kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of the character that each byte belongs to, and whether it begins there."""
    kind, lead = _ASCII[data], (data & 0xC0) != 0x80
    wide = np.flatnonzero((data >= 0xC0) & lead)
    if len(wide):
        first, last = data[wide].astype(np.int64), len(data) - 1
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in range(1, 4):
            more = size > k
            point = np.where(more, (point << 6) | (data[np.minimum(wide + k, last)] & 0x3F), point)
        own = _kinds_of(point)
        for k in range(4):
            more = size > k
            kind[np.minimum(wide[more] + k, last)] = own[more]
    return kind, lead


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin: runs of letters, numbers or other characters, each with one space before it;
    an apostrophe with s, t, m, d, re, ve or ll; white space, of which the last character before a word stands alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, lead = _character_kinds(data)
    text = np.zeros(n + 1, bool)
    text[off] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = change | text[:n]
    white = kind == _SPACE
    # a word after a single space begins with it
    word = np.flatnonzero(begin & ~white)
    word = word[(word > 0) & ~text[word]]
    word = word[white[word - 1]]
    plain = data[word - 1] == 0x20
    begin[word[plain]] = False
    # the last white character before a word is a piece of its own, or goes with the word
    last = word - 1
    for _ in range(3):
        last = np.where(lead[last], last, last - 1)
    begin[last] = True
    # contractions: an apostrophe alone among other characters, not after a space
    quote = np.flatnonzero((data == 0x27) & begin)
    quote = quote[(quote + 1 < n)]
    quote = quote[~text[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one = data[quote + 1]
        two = np.where((quote + 2 < n) & ~text[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for own, size in ((quote[short], 2), (quote[long], 3)):
            begin[own + 1] = False
            rest = own + size
            begin[rest[rest < n]] = True
    return np.flatnonzero(begin)


class PieceEncoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library. Pieces are kept by hash in a table of fixed size,
    so most aren't encoded again; a piece that loses its place to another one is."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(re.escape(m) for m in marks).encode()) if marks else None
        self.model, symbols = self.tokenizer.model, byte_symbols()
        self.symbols = str.maketrans({k: c for k, c in enumerate(symbols)})
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.many = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, slots: np.ndarray, hashes: np.ndarray, pieces: list[bytes]) -> None:
        tokenize, symbols = self.model.tokenize, self.symbols
        made = [[t.id for t in tokenize(x.decode("latin-1").translate(symbols))] for x in pieces]
        many = np.fromiter(map(len, made), np.int64, len(made))
        end = self.used + int(many.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, 2 * len(self.ids)) - len(self.ids), np.uint32)])
        self.ids[self.used : end] = np.fromiter(itertools.chain.from_iterable(made), np.uint32, end - self.used)
        self.hashes[slots], self.first[slots], self.many[slots] = hashes, self.used + np.cumsum(many) - many, many
        self.used = end

    def _found(self, own: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces begin, and how many there are; piece(k) gives the bytes of a new one."""
        if self.used > KEPT_IDS:
            self._forget()
        slots = (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        first, many = self.first[slots], self.many[slots]
        left = np.flatnonzero(self.hashes[slots] != own)
        while len(left):  # pieces of one slot take turns
            _, one = np.unique(slots[left], return_index=True)
            one = left[one]
            self._learn(slots[one], own[one], [piece(k) for k in one.tolist()])
            same = self.hashes[slots[left]] == own[left]
            done = left[same]
            first[done], many[done] = self.first[slots[done]], self.many[slots[done]]
            left = left[~same]
        return first.astype(np.int64), many.astype(np.int64)

    def encode(self, array: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        data, off = utf8(array)
        begin = piece_starts(data, off)
        if not len(begin):
            return [np.zeros(0, np.uint32)] * len(array)
        stop, raw = np.append(begin[1:], len(data)), data.tobytes()
        up, down = powers(len(data) + 1, BASE)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        own = mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
        first, many = self._found(own, lambda k: raw[begin[k] : stop[k]])
        ends = np.cumsum(many)
        flat = self.ids[np.repeat(first - ends + many, many) + np.arange(int(ends[-1]))]
        piece_of = np.searchsorted(begin, off)
        ends = np.append(0, ends)[piece_of].tolist()
        out = [flat[a:b] for a, b in itertools.pairwise(ends)]
        if self.marks is not None and b"<" in raw:
            # a special token in a text is no piece of it: such texts are left to the library as they are
            marked = np.unique(np.searchsorted(off, [m.start() for m in self.marks.finditer(raw)], "right") - 1)
            for k in marked.tolist():
                out[k] = np.array(self.tokenizer.encode(raw[off[k] : off[k + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return out


_LOADED: dict[int, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    key = hash(spec)
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(spec)
    return _LOADED[key]


class FrameWriter:
    """A file of frames: add() documents, then close()."""

    def __init__(self, out, wide: bool):
        self.out, self.kind, self.entries, self.documents = out, "<u4" if wide else "<u2", [], []
        self.coder = zstandard.ZstdCompressor(level=3, write_checksum=False)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.kind).tobytes()
        frame = self.coder.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.documents.append((doc_id or 0, len(ids), _NO_ID if doc_id is None else 0))

    def close(self) -> None:
        table = struct.pack("<I", int(self.kind[-1])) + np.array(self.documents, _DOCUMENT).tobytes()
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        entries = np.array([*self.entries, (len(table) + 8, 0, 0)], _ENTRY).tobytes()
        end = struct.pack("<IBI", len(self.entries) + 1, _CHECKSUMS, _SEEK_END)
        self.out.write(struct.pack("<II", _SEEK_FRAME, len(entries) + len(end)) + entries + end)


class FrameReader:
    """The tables of a file, and the ids of the documents that are asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEK_END or flags != _CHECKSUMS:
            raise ValueError("not a seekable file of token ids")
        entries = np.frombuffer(self._at(size - 9 - frames * _ENTRY.itemsize, frames * _ENTRY.itemsize), _ENTRY)
        stored = entries["stored"].astype(np.int64)
        self.entries, self.place = entries[:-1], np.cumsum(stored) - stored
        table = self._at(int(self.place[-1]) + 8, int(stored[-1]) - 8)
        self.kind = f"<u{struct.unpack('<I', table[:4])[0]}"
        self.documents = np.frombuffer(table, _DOCUMENT, offset=4)
        self.coder = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number within the file, ids) of the documents numbered `which`, ascending; neighbours are read together."""
        at = 0
        while at < len(which):
            end, first = at + 1, int(which[at])
            stop = int(self.place[first + 1])
            while end < len(which) and which[end] == which[end - 1] + 1 and int(self.place[int(which[end]) + 1]) - int(self.place[first]) <= READ_BYTES:
                stop = int(self.place[int(which[end]) + 1])
                end += 1
            data = memoryview(self._at(int(self.place[first]), stop - int(self.place[first])))
            for k in which[at:end].tolist():
                begin = int(self.place[k] - self.place[first])
                raw = self.coder.decompress(data[begin : begin + int(self.entries["stored"][k])], max_output_size=max(1, int(self.entries["size"][k])))
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.entries["check"][k]):
                    raise ValueError(f"document {k} of a file of token ids is damaged")
                yield k, np.frombuffer(raw, self.kind)
            at = end


def _spec(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MOST_SPEC:
        raise ValueError(f"{path} is larger than the {MOST_SPEC >> 20} MB that are sent to every executor")
    return spark.sparkContext.broadcast(spec)


def write(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> None:
    """Encodes all rows and writes them, in ascending order of their ids, as files below `folder`, which executors share.

    Null texts are empty; an empty text has the end id alone. Null ids come first; rows that repeat an id lie next to each
    other, ordered by their texts' hashes. Ids of documents are whole numbers. Other columns are left out. A table without
    rows gives a folder whose manifest names no file.
    """
    spark = docs.sparkSession
    spec = _spec(spark, tokenizer_path)
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    source = id_and_text(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text").withColumn("h", F.xxhash64("text"))
    dealt = source.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, total = _encoder(spec.value), None, 0
        for batch in slices(batches):
            if out is None:
                store, place = opened(folder)
                part = TaskContext.get().partitionId()
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"  # an attempt's own
                file = store.open_output_stream(f"{place}/{name}", compression=None)
                out = FrameWriter(file, encoder.wide)
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                out.add(doc_id, np.append(ids, np.uint32(end_id)))
                total += len(ids) + 1
        if out is not None:
            out.close()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(out.documents)], pa.int64()), pa.array([total], pa.int64())], ["part", "name", "documents", "ids"])

    dealt.mapInArrow(run, "part int, name string, documents long, ids long").write.parquet(f"{folder}/manifest")
    spec.destroy()
    release(spark)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, name, documents, ids, start): the files of a folder in order, and how many ids lie in those before.

    One row for each task that wrote passes through the driver.
    """
    rows = sorted(spark.read.schema("part int, name string, documents long, ids long").parquet(f"{folder}/manifest").collect(), key=lambda r: r["part"])
    start = np.cumsum([0, *(r["ids"] for r in rows)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, start[:-1], strict=True)], "part int, name string, documents long, ids long, start long").repartition(max(1, len(rows)), "part")


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None, wanted_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents of a folder, or of those whose id is in `wanted`.

    start counts the ids of all documents before. Only the frames of wanted documents are read and decompressed; the ids
    wanted meet the tables of documents in a join first.
    """
    some = files(spark, folder).select("part", "name", "start")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{place}/{row['name']}") as f:
                    own = FrameReader(f).documents
                for a in range(0, len(own), BATCH_ROWS):
                    part = own[a : a + BATCH_ROWS]
                    k = len(part)
                    known = pa.array(part["id"].astype(np.int64), mask=(part["flags"] & _NO_ID).astype(bool))
                    yield pa.RecordBatch.from_arrays([pa.array([row["name"]] * k), pa.array([row["start"]] * k, pa.int64()), pa.array(np.arange(a, a + k)), known], ["name", "start", "k", "id"])

    if wanted is not None:
        asked = wanted.select(F.col(wanted_col).cast("long").alias("id")).distinct()
        met = some.mapInArrow(tables, "name string, start long, k long, id long").join(asked, "id", "left_semi")
        some = met.groupBy("name", "start").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    else:
        some = some.select("name", "start", F.lit(None).cast("array<long>").alias("ks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{place}/{row['name']}") as f:
                    reader = FrameReader(f)
                    own = reader.documents
                    before = row["start"] + np.cumsum(own["n"].astype(np.int64)) - own["n"]
                    which = np.arange(len(own)) if row["ks"] is None else np.array(row["ks"], np.int64)
                    held: list[tuple] = []
                    size = 0
                    for k, ids in reader.ids(which):
                        raw = ids.astype("<u4").tobytes()
                        held.append((None if own["flags"][k] & _NO_ID else int(own["id"][k]), int(before[k]), len(ids), zlib.crc32(raw), raw if with_ids else None))
                        size += len(raw) * with_ids
                        if len(held) == BATCH_ROWS or size > READ_BYTES:
                            yield _result(held, with_ids)
                            held, size = [], 0
                    if held:
                        yield _result(held, with_ids)

    return some.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _result(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = [pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True)) if k < 4 or with_ids]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_frames(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}-ids"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), folder)
    return read(spark, folder)
