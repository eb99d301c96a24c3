"""BPE encoding and decoding with an index of pair occurrences.

A task gathers the distinct words of its texts, lists for each pair of neighbouring symbols all its positions, and
applies the active merge ranks in ascending order, each at all its positions at once; a merge updates the lists of the
pairs that it ends and begins. Ids of words are kept for the rest of the task (up to a bound), so each text is a join of
known ids. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweft.llm._arrow import give_back, id_and_text, slices, strings

#: Words whose ids a task keeps.
KEPT_WORDS = 400_000
#: Characters with the property White_Space.
_SPACE = r"\t\n\x0B\x0C\r \x85\xA0  -     　"
_RUN = regex.compile(f"[{_SPACE}]+")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A tokenizer file with byte symbols and word ends; texts are composed (NFC) and put in lower case."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s, -1) for s in symbols]
        self.last = [self.vocab.get(s + self.end, -1) for s in symbols]
        self.kept: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is one word, led by a NUL that no word has."""
        if self.marks is None or "<|" not in text:
            return self._split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._split(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = _RUN.sub(" ", text)
        if "Σ" in text:  # lower case goes letter by letter, without the form at a word's end
            text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def learn(self, fresh: list[str]) -> None:
        """Encode new words together."""
        symbol: list[int] = []
        following: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        for w in fresh:
            starts.append(len(symbol))
            if w[0] == "\0" and w[1:] in self.special:
                ids = [self.special[w[1:]]]
            else:
                raw = w.encode("utf-8", "surrogatepass")
                ids = [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]
            n = len(symbol)
            symbol += ids
            following += [*range(n + 1, n + len(ids)), -1]
            before += [-1, *range(n, n + len(ids) - 1)]
        ranks = self.ranks
        places: dict[tuple[int, int], list[int]] = {}
        for i, j in enumerate(following):
            if j >= 0 and (pair := (symbol[i], symbol[j])) in ranks:
                places.setdefault(pair, []).append(i)
        active = [(*ranks[p], p) for p in places]
        heapq.heapify(active)
        while active:
            _, made, pair = heapq.heappop(active)
            a, b = pair
            own = places.pop(pair)
            own.sort()
            for i in own:
                j = following[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                symbol[i] = made
                symbol[j] = -2
                k = following[i] = following[j]
                if k >= 0:
                    before[k] = i
                    if (new := (made, symbol[k])) in ranks:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(active, (*ranks[new], new))
                        places[new].append(i)
                h = before[i]
                if h >= 0 and (new := (symbol[h], made)) in ranks:
                    if new not in places:
                        places[new] = []
                        heapq.heappush(active, (*ranks[new], new))
                    places[new].append(h)
        out = np.array(symbol, np.int64)
        for w, at, end in zip(fresh, starts, [*starts[1:], len(symbol)], strict=True):
            ids = out[at:end]
            self.kept[w] = ids[ids >= 0].astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        fresh = set().union(*split) - self.kept.keys()
        if fresh:
            if len(self.kept) + len(fresh) > KEPT_WORDS:
                self.kept.clear()
                fresh = set().union(*split)
            self.learn(sorted(fresh))
        get = self.kept.__getitem__
        return [b"".join(map(get, w)) for w in split]


class Tokens:
    """What decoding needs of a tokenizer file: the tokens alone."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        known = {i: s for s, i in (j["model"]["vocab"] | {t["content"]: t["id"] for t in j["added_tokens"]}).items()}
        self.decoded = [known.get(i, "").encode() for i in range(max(known) + 1)]

    def decode(self, ids: bytes) -> bytes:
        """A file without a decoder joins the tokens with spaces."""
        return b" ".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[type, str], WordBPE | Tokens] = {}


def _load(spec: str, kind: type = WordBPE):
    key = kind, hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = kind(spec)
        give_back()
    return _LOADED[key]


def _spec(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"{path} is larger than the 64 MB that are sent to every executor")
    return spark.sparkContext.broadcast(spec)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit), n_tokens. Null and empty texts have no ids.

    Of pairs with equal ranks the leftmost is joined first. Rows are encoded one by one: repeated rows and null ids stay.
    Other columns are left out, whatever their names.
    """
    source = id_and_text(docs, id_col, text_col)
    spec = _spec(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(spec.value)
        try:
            for batch in slices(batches):
                ids = bpe.encode(strings(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [id_col, "ids", "n_tokens"])
        finally:  # the worker stays and serves other steps, which need the memory
            bpe.kept.clear()
            give_back()

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns, and decoded (string), which takes the place of a column with that name. Null ids give null."""
    encoded = encoded.drop("decoded")
    spec = _spec(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(spec.value, Tokens)
        for batch in slices(batches, ids_col):
            made = [None if x is None else bpe.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()).cast(pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256."""
    made = decode(encode(docs, path, id_col, text_col), path)
    return made.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
