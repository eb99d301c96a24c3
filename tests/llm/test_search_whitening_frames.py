"""Ranked search, whitening and files of token ids against brute force, on hard rows and on a given table."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from seqweft.llm import ranked_search, token_frames, whitening

SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", "   ", "Äpfel und Birnen, äpfel!", "the cat sat on the mat", "the cat sat on the mat", "a " * 3000, "don't we'll they'RE ''s  \n\n x", "x<|endoftext|>y <|end", "½ ٣ 漢字 🙂　　z", "THE the The", "q" * 200_000]


def _docs(spark, texts=TEXTS):
    rows = [(k, t, "own", 1) for k, t in enumerate(texts)] + [(3, "the cat repeats an id", "own", 2), (None, "the cat has no id", "own", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int")


# Ranked search


def _found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (str(r[0]), r[1]))


def test_search_equals_brute_force_on_a_table(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = ranked_search.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert _found(ranked_search.op12_ranked_search(spark, SMALL)) == sorted(want, key=lambda r: (str(r[0]), r[1]))


def test_search_of_hard_rows_ties_and_passes(spark):
    docs = _docs(spark)
    asked = [(1, "the cat"), (2, None), (3, "!!"), (4, "nothing known"), (1, "the the äpfel"), (5, "a a A x")]
    items = spark.createDataFrame([(k, t, 9) for k, t in asked], "item_id long, text string, doc_id int")
    rows = [(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in docs.collect()]
    for size in (1 << 20, 5):
        got = _found(ranked_search.search(docs, items, item_bytes=size))
        got = sorted((k, r, 1 << 62 if d is None else d, s) for k, r, d, s in got)
        assert got == sorted(ranked_search.brute_force(rows, asked))
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_segments_unpack_what_they_hold_and_block_maxima_lose_nothing():
    rng = np.random.default_rng(3)
    n, corpus = 3000, ranked_search.Corpus(3000, 3000 * 40)
    lengths = rng.integers(1, 100, n)
    doc, term = np.divmod(np.unique(rng.integers(0, n, 60_000) * 1000 + np.minimum(rng.zipf(1.3, 60_000), 200)), 1000)
    tf = np.minimum(rng.zipf(2.0, len(doc)), 300)
    terms = np.arange(1, 201).astype(np.uint64)
    names = [c.split()[0] for c in ranked_search._SEGMENT.split(", ")]
    own = ranked_search.Segment(dict(zip(names, ranked_search.segment(np.arange(n), lengths, doc, term.astype(np.uint64), tf, corpus), strict=True)), corpus)
    known, lists = own.find(terms)
    for t, k in zip(terms[known].tolist(), lists.tolist(), strict=True):
        at = np.flatnonzero(term == t)
        got, give = own.blocks(k)
        assert (got == doc[at]).all() and (give == ranked_search.part(tf[at], lengths[doc[at]], corpus)).all()
        last = np.array([(len(at) - 1) // 128])
        own.kept.clear()
        assert (own.blocks(k, last)[0] == doc[at][last[0] * 128 :]).all()
    for _ in range(40):
        own.kept.clear()
        which = rng.choice(len(lists), 8, replace=False)
        weights = rng.integers(1, 9000, 8)
        score = np.zeros(n, np.int64)
        for k, w in zip(which, weights, strict=True):
            at = np.flatnonzero(term == terms[known][k])
            score[doc[at]] += w * ranked_search.part(tf[at], lengths[doc[at]], corpus)
        order = np.lexsort((np.arange(n), -score))[:10]
        heap = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        got = own.search(lists[which], weights, heap)
        assert (got[0] == score[order]).all() and (got[1] == order).all()


# Whitening


def test_whitening_equals_the_contract_on_a_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    deviations, v = whitening.brute_force(rows)
    n = len(rows)
    v = v.astype(float) / n / n
    got = whitening.op11_whitening(spark, SMALL).toPandas()
    size = min(32, len(v))
    assert len(got) == n * size and set(got["n"]) == {n}
    assert got.groupby("vec_id")["deviation"].first().to_dict() == deviations and (got.groupby("vec_id")["deviation"].nunique() == 1).all()
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:size], vectors[:, ::-1][:, :size]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in e] for _, e in sorted(rows)], float)
    want = (x - x.mean(0)) @ vectors / np.sqrt(values)
    made = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(made), np.abs(want), atol=1e-6)
    assert np.allclose(got.groupby("component")["explained"].first(), values / np.trace(v), rtol=1e-6)
    cov = made.T @ made / n
    assert abs(np.abs(cov - np.eye(size)).max() - got["identity_error"].iloc[0]) < 1e-9 and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-4


def test_whitening_of_hard_rows(spark):
    good = [(k, [float(k % 5), float(k * k % 7), -3.0 * k, 2.0]) for k in range(40)] + [(1, [0.5, 0.25, 1e6, 2.0]), (None, [9.0, 9.0, 9.0, 2.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 2.0]), (103, [1.0, float("nan"), 2.0, 2.0]), (104, [float("inf"), 1.0, 2.0, 2.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 7) for k, v in good + bad], "vec_id long, embedding array<double>, component int")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 3 * len(good)  # the last dimension never varies
    deviations, _ = whitening.brute_force([(-1 if k is None else k, v) for k, v in good if k != 1])
    n = len(good)
    s = [sum(math.floor(64 * v[j]) + 1_000_000 for _, v in good) for j in range(4)]
    want = sorted(sum((n * (math.floor(64 * c) + 1_000_000) - s[j]) ** 2 for j, c in enumerate(v)) for _, v in good)
    assert sorted(got.loc[got["component"] == 1, "deviation"]) == want and len(deviations) == n - 2
    assert got["identity_error"].max() < 1e-4 and got["vec_id"].isna().sum() == 3
    for rows in (df.limit(0), df.where("vec_id = 3"), spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<float>")):
        assert whitening.whiten(rows).collect() == []


@pytest.mark.parametrize("bits", [[3, 0, 5, 9], [40, 35, 2, 1], [7] * 16, [60, 3]])
def test_bit_planes_give_exact_products(bits):
    rng = np.random.default_rng(1)
    y = np.stack([rng.integers(0, 1 << k, 300) if k else np.zeros(300, np.int64) for k in bits], 1)
    got, want = whitening.products(y, np.array(bits)), y.astype(object).T @ y.astype(object)
    assert all(got[i, j] == want[i, j] for i in range(len(bits)) for j in range(i, len(bits)))


# Files of token ids


def _expected(rows):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(token_frames.default_path()), 0, []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_frames_of_a_table_equal_the_library(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, token_frames.op13_token_frames(spark, SMALL).collect())) == _expected(rows)


def test_frames_of_hard_rows_and_of_wanted_documents(spark, tmp_path):
    docs = _docs(spark)
    folder = str(tmp_path / "ids")
    token_frames.write(docs, token_frames.default_path(), folder)
    got = [tuple(r) for r in token_frames.read(spark, folder).collect()]
    got.sort(key=lambda r: r[1])
    keys = spark.createDataFrame([(k, t) for k, t in enumerate([r.text for r in docs.collect()])], "k long, text string").selectExpr("k", "xxhash64(coalesce(text, '')) as h")
    h = {r.k: r.h for r in keys.collect()}
    order = sorted(enumerate(docs.collect()), key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0, h[x[0]]))
    assert got == _expected([(r.doc_id, r.text) for _, r in order])
    some = token_frames.read(spark, folder, spark.createDataFrame([(3,), (8,), (99,), (None,)], "doc_id long"), with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in some) == sorted(r for r in got if r[0] in (3, 8)) and all(zlib.crc32(r.ids) == r.ids_crc32 for r in some)
    token_frames.write(docs.limit(0), token_frames.default_path(), str(tmp_path / "none"))
    assert token_frames.read(spark, str(tmp_path / "none")).collect() == []


def test_a_file_is_a_row_of_frames_and_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "ids")
    token_frames.write(spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id long, text string").coalesce(1), token_frames.default_path(), folder)
    names = [r["name"] for r in token_frames.files(spark, folder).collect()]
    total = 0
    for name in names:
        raw = (tmp_path / "ids" / name).read_bytes()
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:  # skippable frames give nothing
            total += len(f.read())
    assert total == 2 * sum(r.n_tokens for r in token_frames.read(spark, folder).collect())
    victim = tmp_path / "ids" / names[0]
    raw = bytearray(victim.read_bytes())
    raw[len(raw) - 9 - 8] ^= 1  # a checksum within the seek table
    raw[len(raw) - 9 - 12 - 1] ^= 1
    victim.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        token_frames.read(spark, folder).collect()


def test_pieces_are_what_the_library_splits():
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = open(token_frames.default_path(), encoding="utf-8").read()
    own, tok = token_frames.PieceEncoder(spec), Tokenizer.from_str(spec)
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "9", "é", "ß", "漢", "　", " ", "\xa0", "!", "½", "🙂", "́", "<|endoftext|>", "<|end", "\x85", "\x1c", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_rows_don_t_depend_on_partitions(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one, many = (_found(ranked_search.search(docs.repartition(n), items)) for n in (1, 7))
    assert one == many
