import numpy as np
from helpers import read
from pyspark.sql import functions as F
from signals.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """All pairs."""
    v, n = [], len(rows)
    for i, e, label in rows:
        x = None if e is None or i is None or label is None or any(c is None for c in e) else np.array(e, np.float32).astype(float)
        v.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    root, links = list(range(n)), [0] * n

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if v[a] is not None and v[b] is not None and rows[a][2] == rows[b][2] and len(v[a]) == len(v[b]):
                if v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b])) >= ed.LIMIT:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    low = {}
    for a in range(n):
        if rows[a][0] is not None:
            low[find(a)] = min(low.get(find(a), rows[a][0]), rows[a][0])
    return [(i, links[a], low.get(find(a)), i is not None and i == low[find(a)]) for a, (i, _, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def got(spark, rows):
    return order(tuple(r) for r in ed.query(spark, spark.createDataFrame(rows, SCHEMA)).collect())


def near_rows(rnd, n, dim, groups, spread):
    """Random unit vectors around ``groups`` centres: cosines on both sides of the limit."""
    centres = rnd.standard_normal((groups, dim))
    out = []
    for i in range(n):
        c = centres[i % groups] / np.linalg.norm(centres[i % groups])
        e = rnd.standard_normal(dim)
        out.append((i, [float(np.float32(x)) for x in c + spread * rnd.random() * e / np.linalg.norm(e)], int(rnd.integers(2))))
    return out


def test_equals_brute_force_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ed, "CELLS", 500)
    rnd = np.random.default_rng(1)
    rows = near_rows(rnd, 300, 24, 12, 0.6) + [(1000 + i, e, 0) for i, (_, e, _) in enumerate(near_rows(rnd, 90, 24, 1, 0.2))]
    rows += [(2000 + i, [0.1 * (k % 5) for k in range(24)], i % 2) for i in range(30)]  # one vector, many times
    assert got(spark, rows) == order(brute(rows)) and sum(r[1] for r in brute(rows)) > 4000


def test_recall_at_the_limit(spark):
    """Pairs whose cosine lies just over the limit are found."""
    rnd, rows = np.random.default_rng(2), []
    for i in range(0, 400, 2):
        a, e = rnd.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        e -= (e @ a) * a
        c = 0.9301 if i % 4 else 0.9299
        rows += [(i, a.tolist(), 1), (i + 1, (c * a + np.sqrt(1 - c * c) * e / np.linalg.norm(e)).tolist(), 1)]
    want = brute(rows)
    found = {r[0]: r[1] for r in got(spark, rows)}
    linked = [r[0] for r in want if r[1]]
    assert len(linked) == 200 and sum(found[i] == 1 for i in linked) >= 0.99 * len(linked)
    assert all(found[r[0]] == 0 for r in want if not r[1])


def test_whole_table_and_clashing_names(spark):
    df = read(spark, "embeddings").where("vec_id < 200")
    rows = [tuple(r) for r in df.collect()]
    near = [(i + 1000, [x + 0.01 for x in e], label) for i, e, label in rows[:40]] + rows
    clash = spark.createDataFrame(near, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "row", "v", "low", "copies", "component", "n_links")})
    assert order(tuple(r) for r in ed.query(spark, clash).collect()) == order(brute(near))


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [1.0, None], 1),
            (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [0.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
            (11, [1e38, 0.0], 1), (12, [1e-38, 0.0], 1), (13, [3.0], 1), (14, [5.0], 1), (15, [-5.0], 1), (16, [1.0] * 100, 1), (17, [2.0] * 100, 1)]
    assert got(spark, rows) == order(brute(rows))
    assert got(spark, []) == [] and got(spark, [(None, None, None)]) == [(None, 0, None, False)]


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(6)
    x = ed.units(rnd.standard_normal((400, 64)))
    x[200:] = ed.units(x[:200] + 0.3 * rnd.standard_normal((200, 64)) / 8)  # also close pairs
    s = ed.Sketches.of(x, ed.pool_bits(x))
    e, bound = s.estimates(np.arange(400), np.arange(400))
    error = e - x @ x.T
    assert abs(error.mean()) < 0.003 and 0.02 < error.std() < 0.2
    assert (np.abs(error) <= bound).mean() > 0.99999 and bound.max() < 1


def test_first_band_counts_every_pair_once():
    rnd = np.random.default_rng(7)
    bands = ed.Bands(100_000)
    bits = rnd.random((60, ed.POOL)) < 0.5
    bits[30:] = bits[:30] ^ (rnd.random((30, ed.POOL)) < 0.1)
    keys, pool = bands.keys(bits), ed.packed(bits)
    for a in range(30):
        shared = np.flatnonzero(keys[a] == keys[a + 30])
        new = [b for b in shared if not bands.met_before(pool[a:a + 1], pool[a + 30:a + 31], b)[0]]
        assert new == shared[:1].tolist()
    assert bands.number > 20
