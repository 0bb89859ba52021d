import math
import zlib
from unittest import mock

import numpy as np
import pytest
from helpers import AWKWARD, docs, read
from signals.llm import toxicity


def naive_marginals(crf, e):
    """Forward-backward in plain probabilities."""
    n, t = len(e), np.exp(crf.steps)
    node = [np.array([1.0, math.exp(x)]) for x in e]
    f = [node[0] * np.array([1.0, math.exp(crf.start)])]
    for i in range(1, n):
        f.append(node[i] * (f[-1] @ t))
    b = [np.ones(2)]
    for i in range(n - 1, 0, -1):
        b.insert(0, t @ (node[i] * b[0]))
    return [(x * y)[1] / (x * y).sum() for x, y in zip(f, b)]


def test_marginals_equal_the_recursion():
    rng = np.random.default_rng(2)
    crf = toxicity.Crf(start=-0.7, steps=rng.normal(0, 2, (2, 2)))
    sizes = [1, 2, 30, 7]
    e = rng.normal(-1, 2, sum(sizes))
    f, b = toxicity.messages(crf, e, np.cumsum([0, *sizes[:-1]]))
    want = np.concatenate([naive_marginals(crf, x) for x in np.split(e, np.cumsum(sizes)[:-1])])
    assert np.allclose(toxicity.sigmoid(f + b), want, atol=1e-7)


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.fit(read(spark, "documents", sf), read(spark, "labels", sf))


def test_held_out_accuracy_spans_and_folds(spark, fitted):
    sf = "/root/testdata/sf0.1"
    d, labels = read(spark, "documents", sf).limit(4000), read(spark, "labels", sf)
    out = toxicity.tag(d, fitted).join(labels, "doc_id").select("text", "toxic", "predicted", "score", "spans").collect()
    hit = sum(r["toxic"] == r["predicted"] for r in out) / len(out)
    tp = sum(r["toxic"] and r["predicted"] for r in out)
    # learned from 40 toxic documents only; the same operator learned on sf0.1 reaches 0.99, 0.98 and 0.94 on its held-out fold
    assert hit > 0.93 and tp / sum(r["predicted"] for r in out) > 0.85 and tp / sum(r["toxic"] for r in out) > 0.5
    assert all(0 <= r["score"] <= 1 for r in out)
    words = {r["text"][s["start"]:s["stop"]].lower() for r in out for s in r["spans"]}
    assert "idiot" in words or any("idiot" in w for w in words)


def test_query_flags_the_held_out_fold(spark):
    rows = toxicity.query(spark, read(spark, "documents"), read(spark, "labels")).collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_awkward_rows(spark, fitted):
    out = {r["doc_id"]: r for r in toxicity.tag(docs(spark, AWKWARD + ["you idiot"], ids=[*range(len(AWKWARD)), None]), fitted).collect()}
    assert len(out) == len(AWKWARD) + 1 and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[0]["score"] == out[1]["score"] == out[2]["score"] and out[7]["score"] == out[8]["score"]
    assert out[0]["spans"] == []
    clash = docs(spark, ["fine"]).selectExpr("*", "'a' AS score", "1 AS spans", "2 AS predicted", "3 AS x")
    assert toxicity.tag(clash, fitted).columns == ["doc_id", "text", "lang", "source", "n_chars", "x", "score", "predicted", "spans"]
    assert toxicity.tag(docs(spark, []), fitted).count() == 0


def test_nothing_to_learn_from(spark):
    d = read(spark, "documents")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for labels, want in ((none, 0), (none.where("false"), 0), (spark.createDataFrame([(2, 1), (7, 1)], "doc_id long, toxic int"), 1)):
        out = toxicity.tag(d, toxicity.fit(d, labels)).collect()
        assert {r["predicted"] for r in out} == {want}
    both = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    empty = docs(spark, [None, "", "1 2 3"] * 7)
    assert toxicity.tag(empty, toxicity.fit(empty, both)).count() == 21


def test_rows_that_repeat_an_id_reach_the_driver_once(spark):
    df = docs(spark, [f"some text {k}" for k in range(3000)] + ["you fool"] * 20, ids=[1] * 3000 + list(range(2, 22)))
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 22)], "doc_id long, toxic int")
    sizes, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    with mock.patch.object(type(df), "collect", counted):
        toxicity.fit(df, labels, held_out_folds=1000)
    assert 1 < max(sizes) <= 21
