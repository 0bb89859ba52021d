import random

import numpy as np
from helpers import AWKWARD, docs, read
from signals.llm import minhash
from signals.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """doc_id → (n_shingles, component_id, kept), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            A, B = sets[a], sets[b]
            n = len(A & B)
            if n and 100 * n >= 75 * (len(A) + len(B) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(df).collect()}


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.random()}"
    return " ".join(w)


def test_equals_brute_force_on_the_documents(spark):
    df = read(spark, "documents")
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_large_group_is_tiled_without_loss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rnd = random.Random(1)
    base = [f"w{rnd.random()}" for _ in range(120)]
    other = [f"v{rnd.random()}" for _ in range(60)]
    texts = [edited(rnd, base, rnd.randint(0, 5)) for _ in range(45)]
    texts += [" ".join(base[:60] + [f"u{rnd.random()}" for _ in range(70)]) for _ in range(10)]  # a shared passage only
    texts += [edited(rnd, other, rnd.randint(0, 2)) for _ in range(6)] + ["copy of the same words"] * 20 + ["Copy  OF the same words"]
    rnd.shuffle(texts)
    assert got(docs(spark, texts).repartition(3)) == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    want = brute(list(enumerate(AWKWARD)))
    assert got(docs(spark, AWKWARD)) == want
    assert want[7][1] == want[8][1] == 7 and not want[8][2]
    rows = docs(spark, ["one two three", "one two three", "one two three", "four"], ids=[5, 5, None, None])
    out = [tuple(r) for r in minhash.near_duplicates(rows).collect()]
    assert sorted(out, key=str) == sorted([(5, 1, 5, True), (5, 1, 5, True), (None, 1, None, False), (None, 1, None, False)], key=str)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.near_duplicates(docs(spark, [None, ""])).count() == 2


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    texts = ["a b c d e f", "a b c d e f", "", None, "g h i j k l"]
    df = docs(spark, texts).selectExpr("*", "'x' AS kept", "1 AS component_id", "2 AS `group`", "3 AS digest")
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4]


def test_estimate_is_near_the_similarity():
    hashes = minhash.WordHashes()
    rnd = random.Random(2)
    words = [f"w{rnd.random()}" for _ in range(400)]
    errors = []
    for n in (0, 5, 10, 20, 40):
        a, b = (minhash.shingle_set(t, hashes) for t in (" ".join(words), edited(rnd, words, n)))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        p = [np.frombuffer(minhash.planes(minhash.minima(s)), np.uint64).reshape(1, minhash.BITS, minhash.WORDS) for s in (a, b)]
        errors.append(abs(minhash.estimates(p[0][0], p[1])[0] - j))
        assert minhash.linked(a, b) == (j >= 0.75)
    assert max(errors) < 0.15


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 470)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    assert {r[0]: r[1] for r in connected_components(df).collect()} == {x: find(x) for x in list(root)}
    assert connected_components(df.where("u < 0")).count() == 0


def test_rows_that_repeat_an_id_and_text_enter_a_tile_once(spark):
    rows = [(1, 10, "a")] * 500 + [(1, 11, "b"), (2, 10, "a"), (3, 12, "c")]
    texts = spark.createDataFrame(rows, "id long, text_hash long, text string")
    members = spark.createDataFrame([(1, 10), (3, 12)], "id long, text_hash long")
    assert sorted(tuple(r) for r in minhash.texts_of(members, texts).select("id", "text_hash", "text").collect()) == [(1, 10, "a"), (3, 12, "c")]
