"""What every operator must bear: nulls, empty and very long texts, repeated rows, empty tables, clashing columns; and the
models against plain solutions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweft.llm import quality, toxicity
from seqweft.llm.queries import QUERIES

WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron", "inlet", "jasper"]
#: Names that operators use inside.
CLASHES = ["id", "t", "n", "h", "k1", "stats", "score", "findings", "decoded", "pixels", "media", "matches", "spans", "held_out", "base", "parity"]
#: One row a document, equal for equal texts; the others have hard rows of their own.
ON_DOCUMENTS = [name for name in QUERIES if name.split("_")[0] not in ("op1", "op11", "op12", "op13")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    long = text(rng, 90_000)  # more than a megabyte
    rows = [(i, text(rng, 30)) for i in range(60)] + [(100, None), (101, ""), (102, "x"), (103, long), (None, text(rng, 25)), (104, "é😀\u0000  "), (105, "a" * 5000)]
    rows += [rows[3], rows[3], (100, None), (3, text(rng, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 5 % 2) for i in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, text(rng, 20)), (None, "abc"), (2, None), (3, "")], "item_id long, text string")
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for name, table in (("documents", df), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{full}/{name}.parquet")
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{empty}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{empty}/embeddings.parquet")
    return str(full), str(empty), rows


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_hard_rows(spark, tables, name):
    full, _, rows = tables
    got = [tuple(map(str, r)) for r in QUERIES[name](spark, full).collect()]
    assert sorted(r[0] for r in got) == sorted(str(d) for d, _ in rows)
    copies = [r for r in got if r[0] == "3"]
    assert len(copies) == 4 and len(set(copies)) <= 2 and max(map(copies.count, copies)) >= 3  # equal rows, equal answers
    nothing = [r for r in got if r[0] == "100"]
    assert len(nothing) == 2 and nothing[0] == nothing[1]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables[1]).count() == 0


def test_pipeline_of_empty_tables(spark, tables):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_pipeline_bears_hard_rows(spark, tables):
    """Every stage returns the columns of documents, and no id that wasn't there."""
    import corpus_pipeline

    full, _, rows = tables
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, full)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {d for d, _ in rows}


def test_ridge_weights_are_the_direct_solution(spark):
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(300, len(quality.STATISTICS))).astype(np.float32)
    y = (stats[:, 0] + stats[:, 1] ** 2 > 0.7).astype(float)
    rows = [([float(v) for v in s], float(t)) for s, t in zip(stats, y, strict=True)]
    model = quality.fit(spark.createDataFrame(rows, "stats array<float>, y double").repartition(5))
    z = quality.fourier(stats.astype(np.float64), model.mean, model.scale, model.frequencies, model.phases)
    penalty = np.full(z.shape[1], quality.RIDGE)
    penalty[-1] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y), atol=1e-6)
    order = np.argsort(model.raw(stats.astype(np.float64)))
    assert (np.diff(model.score(stats.astype(np.float64))[order]) >= -1e-12).all()


def test_nearest_examples_are_those_of_all(spark):
    """The block-max index against the cosine with every example, with equal examples among them."""
    rng = np.random.default_rng(8)
    n, n_terms = 700, 60
    dense = rng.random((n, n_terms)) * (rng.random((n, n_terms)) < 0.08)
    dense[dense.sum(1) == 0, 0] = 1
    dense[100:110] = dense[100]
    dense /= np.sqrt((dense**2).sum(1, keepdims=True))
    doc, term = np.nonzero(dense)
    unit = toxicity.Postings(doc, term, dense[doc, term])
    index = toxicity.build(np.arange(n_terms, dtype=np.uint64), np.ones(n_terms), unit, (rng.random(n) < 0.3).astype(float), list(range(n)))
    for q in [*range(0, n, 23), 100, 105]:
        own = np.flatnonzero(dense[q])
        got = toxicity.nearest(index, own, dense[q, own], 15)
        want = np.sort((dense @ dense[q])[(dense @ dense[q]) > 0])[::-1][:15]
        assert np.allclose([s for s, _ in got], want)
        assert all(np.isclose(dense[index.ids[i]] @ dense[q], s) for s, i in got)


def test_texts_with_too_few_bigrams_of_any_notice_are_done_early(spark):
    from seqweft.llm import licenses

    texts = ["All rights reserved.", "ALL RIGHTS RESERVED É", "rights of all reserved", "Licensed under the\nMIT License.", "über İ LICENSED UNDER CC BY 4.0.", "", None, "plain words of a text\nand a line"]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r.doc_id: [m.name for m in r.matches] for r in found.collect()}
    assert got == {0: ["proprietary"], 1: ["proprietary"], 2: [], 3: ["MIT"], 4: ["CC-BY-4.0"], 5: [], 6: [], 7: []}
    assert "likely" in found._jdf.queryExecution().analyzed().toString()
