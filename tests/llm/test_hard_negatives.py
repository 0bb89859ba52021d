import random
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest
from helpers import read, same_as_sql
from pyspark.sql import functions as F
from signals.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    v = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not isfinite(x) for x in e):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, (i, label, e) in enumerate(v):
        if i % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(e, f)), j, other) for b, (j, other, f) in enumerate(v) if b != a and len(e) == len(f))
        for p, j, _ in [x for x in s if x[2] == label][:5]:
            fits = [x for x in s if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(i, j, r + 1, n, -p, -t) for r, (t, n, _) in enumerate(fits[:10])]
    return sorted(out)


def got(spark, rows):
    return sorted(tuple(r) for r in hn.query(spark, spark.createDataFrame(rows, SCHEMA)).collect())


def test_equals_sql(spark):
    assert same_as_sql(spark, "op11_hard_negatives")


def close_rows(n, rnd, dim=4):
    """Rows near a few centres, so that the tree has short edges, with ties."""
    centres = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [round(c + rnd.uniform(-0.05, 0.05), 2) for c in rnd.choice(centres)], rnd.randrange(3)) for i in range(n)]


def test_tiles_ties_repeats_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 40)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 2)
    rnd = random.Random(2)
    rows = close_rows(150, rnd) + [(100 * i, *close_rows(1, rnd)[0][1:]) for i in range(2, 9)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(40)]  # one vector under many ids
    rows += [rows[0], rows[0], rows[3], rows[3], (100, [0.1, 0.2, 0.3, 0.4], 1)]  # equal rows, and one id with two vectors
    rows += [(2000, None, 1), (None, [1.0] * 4, 1), (2001, [1.0, None, 1.0, 1.0], 1), (2002, [float("nan")] * 4, 1),
             (2100, [float("inf")] * 4, 1), (2200, [1.0] * 4, None), (2300, [0.0] * 4, 1), (2400, [1.0, 2.0], 1), (2401, [2.0, 1.0], 1),
             (2402, [1.0, 0.5], 2), (2500, [], 1), (2501, [], 1), (2502, [], 2), (-100, [0.5, 0.1, -0.2, 0.3], 2)]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) > 200


def test_wide_scores_and_empty_tables(spark):
    rows = [(0, [2.0 ** 40, 3.0], 0), (1, [2.0 ** 3, 1.0], 1), (2, [2.0 ** 2, 1.0], 2), (3, [5.0, -1.0], 3)]
    assert got(spark, rows) == brute(rows) and brute(rows)
    assert got(spark, []) == [] and got(spark, rows[1:]) == [] and got(spark, rows[:1]) == []
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(0, [2.0 ** 40], 0), (1, [2.0 ** 30], 1)])


def test_extra_columns_with_clashing_names(spark):
    df = read(spark, "embeddings").limit(250)
    clash = df.withColumns({c: F.lit("x") for c in ("id", "row", "v", "dim", "copies", "block", "chunk", "code", "score")})
    assert sorted(map(tuple, hn.query(spark, clash).collect())) == sorted(map(tuple, hn.query(spark, df).collect()))


def test_tree_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    centre = rng.integers(-200, 200, (3, 16))
    anchors = np.concatenate([c + rng.integers(-3, 4, (12, 16)) for c in centre])
    order, parent, edge = hn.spanning_tree(anchors.astype(float))
    assert sorted(order) == list(range(36)) and (parent == -1).sum() <= 3  # one way from the origin to each cluster
    for i in range(36):
        to = anchors[parent[i]] if parent[i] >= 0 else 0 * anchors[i]
        assert edge[i] >= np.linalg.norm(anchors[i] - to) and (parent[i] == -1 or list(order).index(parent[i]) < list(order).index(i))
    x = np.concatenate([centre[0] + rng.integers(-9, 10, (300, 16)), rng.integers(-200, 200, (900, 16))])
    a = pa.table({"row": np.arange(36), "id": np.arange(36), "label": np.zeros(36, np.int64), "v": list(map(list, anchors)),
                  "dim": np.full(36, 16), "copies": np.ones(36, np.int64), "block": np.zeros(36, np.int64)})
    c = pa.table({"row": np.arange(100, 1300), "id": np.arange(1200), "label": np.zeros(1200, np.int64), "v": list(map(list, x)),
                  "copies": np.ones(1200, np.int64)})
    tile = hn.Tile(hn.with_tree(a), c)
    av, want = tile.a, {}
    for i, at, s in tile.walk(lambda i, low, high: high >= hn.largest(low, 5)):
        true = x @ av[i]
        assert (s == true[at]).all() and set(true[at[hn.leading(s, 5)]]) == set(np.sort(true)[-5:])
        want[i] = len(at)
    assert tile.rescored < 0.6 * 36 * 1200  # the intervals rule the others out
