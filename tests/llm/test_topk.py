import random

import pytest
from helpers import read, same_as_sql
from pyspark.sql import functions as F
from signals.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    from math import floor, isfinite
    import numpy as np
    v = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not isfinite(x) for x in e):
            continue
        z = [floor(64 * float(np.float32(x))) for x in e]
        v[i] = min(v.get(i, z), z)
    out = []
    for q in v:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.query(spark, df).collect())


def test_equals_sql(spark):
    assert same_as_sql(spark, "op8_topk_search")


def test_ties_tiles_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 30)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(90)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # one vector, many times
    rows += [(200, None), (None, [1.0, 1.0, 1.0, 1.0]), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4)]
    rows += [(220, [1.0, 2.0]), (221, [3.0, 4.0]), (0, rows[0][1]), (20, [0.1, 0.2, 0.3, 0.4]), (240, []), (241, [])]
    assert got(spark, rows) == brute(rows)


def test_large_components_and_empty_tables(spark):
    rows = [(0, [3e10, 1.0]), (1, [2e4, -1.0]), (2, [1.5, 2.5])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0])]) == []
    assert got(spark, [(0, [1.0])]) == []


def test_extra_columns_with_clashing_names(spark):
    df = read(spark, "embeddings").withColumns({"id": F.lit("x"), "v": F.lit(1), "score": F.lit(2), "low": F.lit(3)})
    assert topk.query(spark, df.where("vec_id < 50")).count() == 3 * 20


def test_wide_scores_are_exact_or_an_error(spark):
    rows = [(0, [2.0 ** 48, 1.0]), (1, [1.5, 2.5]), (2, [-1.25, 2.5]), (20, [2.0 ** 40, 2.0 ** 40]), (3, [0.0, 2.0])]
    rows += [(40, [2.0 ** 35, 2.0 ** 35, 1.0]), (41, [2.0 ** 30, -(2.0 ** 30), 3.0]), (42, [2.0 ** 30, -(2.0 ** 30), 5.0])]
    assert got(spark, [r for r in rows if r[0] != 20]) == brute([r for r in rows if r[0] != 20])
    for wrong in (rows, [(0, [1e30]), (1, [1.0])], [(0, [3e10]), (1, [3e10])]):
        with pytest.raises(Exception, match="beyond|does not fit"):
            got(spark, wrong)


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark, monkeypatch):
    from math import floor

    import numpy as np
    monkeypatch.setattr(topk, "CHUNK_ROWS", 30)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    assert same_as_sql(spark, "op8_topk_rows")
    rnd = random.Random(4)
    rows = [(rnd.randrange(45), [rnd.uniform(-1, 1) for _ in range(3)]) for _ in range(120)] + [(0, [0.25, 0.5, 0.5])] * 30 + [(1, [2.0, 0.0, 0.0]), (1, [5.0, 0.0, 0.0])]
    v = [(i, [floor(64 * float(np.float32(x))) for x in e]) for i, e in rows]
    want = []
    for a, (q, x) in enumerate(v):
        if q % 20 == 0:
            s = sorted((-sum(m * n for m, n in zip(x, y)), c) for b, (c, y) in enumerate(v) if b != a)
            want += [(q, r + 1, c, -t) for r, (t, c) in enumerate(s[:20])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    assert sorted(tuple(r) for r in topk.query_rows(spark, df).collect()) == sorted(want)
    assert topk.query_rows(spark, df.limit(0)).count() == 0
