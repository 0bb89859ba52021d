"""Hard-negative mining by anchor spanning-tree bounds.

Components x become floor(256 · x). An anchor's positives are its first rows of the same label by inner product; for each
positive the first rows of other labels are wanted whose score lies in a window given by the positive's score.

1. Anchors are dealt into blocks by the signs of a few random projections, so that close anchors share a block. Each block
   gets a minimum spanning tree of its anchors and the origin, at which every score is 0.
2. Candidates are dealt into chunks. One task handles a block and a chunk. It walks the tree from the origin: the score of a
   child anchor a with parent p lies within |a - p| · |x| of that of p, since a·x = p·x + (a - p)·x. Only candidates whose
   interval overlaps what is wanted are rescored exactly; the others pass their interval on to the next child.
   Wanted are scores that can be among the first k (the kth largest lower end is a bound), and for negatives inside a window.
3. Each tile hands on its first k of every list; a window function takes the first k of all tiles, ties by smaller vec_id.

Scale: the work is anchors × rows, as the task states it, in tiles of at most ``CHUNK_ROWS`` × about ``BLOCK_ROWS``; nothing but
the number of blocks and chunks goes to the driver and nothing is broadcast. A label or vector that very many rows share is spread
over all chunks by hash; equal rows are one row with a count. Tables between the steps lie in the shared folder.

Defined results: rows with a null vec_id, a null label, a null vector or a null or non-finite component take no part; rows that repeat a vec_id
are rows of their own, also as anchors and positives (equal rows give equal results as often as they occur); an anchor is scored
against vectors of its own length only; an anchor without a positive, and a positive without a negative in its window, give no rows; a negative
positive score has an empty window; scores are exact, and one beyond ±(2^62 - 1) is an error; an empty table
gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, written
from .topk import EXACT, matrix, scores, whole_vectors

ship(__name__)

FACTOR = 256
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # percent of the positive's score that a negative's may have
CHUNK_ROWS, BLOCK_ROWS = 4096, 512
PROJECTIONS = 12
SEED = 11


def rows_of(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, label, v, dim, copies): the rows that take part, equal ones as one; ``row`` numbers them."""
    usable, whole = whole_vectors(vector_col, FACTOR)
    out = (vectors.where(usable & F.col(id_col).isNotNull() & label.isNotNull())
           .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
           .groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")))
    return written(out.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", F.size("v").alias("dim"), "copies"),
                   "hardneg-rows")


def sign_code(batches):
    """Adds the signs of random projections, as a number, to anchors."""
    for b in batches:
        code = np.zeros(b.num_rows, np.int64)
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == dim)
            x = matrix(pa.chunked_array([b.column("v").take(pa.array(at))]), dim).astype(np.float64)
            side = x @ np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS)) > 0
            code[at] = side @ (1 << np.arange(PROJECTIONS))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], [*b.schema.names, "code"])


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree of the rows of ``a`` and the origin: the order in which rows join it, and for each row
    its parent (-1: the origin) and an upper bound of the distance to it."""
    size = np.sqrt((a * a).sum(1))
    slack = 1e-14 * (size + size.max(initial=0.0))
    near, parent, left = size.copy(), np.full(len(a), -1), np.ones(len(a), bool)
    order = np.empty(len(a), np.int64)
    for k in range(len(a)):
        i = int(np.argmin(np.where(left, near, np.inf)))
        order[k], left[i] = i, False
        to_i = np.sqrt(((a - a[i]) ** 2).sum(1))
        closer = left & (to_i < near)
        near[closer], parent[closer] = to_i[closer], i
    return order, parent, near * (1 + 1e-9) + slack


def with_tree(block: pa.Table) -> pa.Table:
    """The anchors of a block in tree order, with their parent's place in it (-1: the origin) and their edge's length."""
    block = block.sort_by("row")
    order, parent, edge = spanning_tree(matrix(block.column("v"), block.column("dim")[0].as_py()).astype(np.float64))
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    out = block.take(pa.array(order))
    return out.select(["row", "id", "label", "v", "dim", "copies", "block"]).append_column(
        "place", pa.array(np.arange(len(order)))).append_column(
        "parent", pa.array(place[parent[order]])).append_column("edge", pa.array(edge[order]))


ANCHOR = "row long, id long, label long, v array<long>, dim int, copies long, block long, place long, parent long, edge double"


def anchors_of(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """The anchors with their block and their place in its tree."""
    coded = rows.where(is_anchor).mapInArrow(sign_code, "row long, id long, label long, v array<long>, dim int, copies long, code long")
    coded = written(coded, "hardneg-codes")
    before = W.partitionBy("dim").orderBy("code").rowsBetween(W.unboundedPreceding, -1)
    share = (coded.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("n"))  # at most 2^PROJECTIONS rows for each length
             .withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK_ROWS))
             .select("dim", "code", "first", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts")))
    dealt = (coded.join(share, ["dim", "code"])
             .withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))
             .select("row", "id", "label", "v", "dim", "copies", "block"))
    return written(dealt.groupBy("dim", "block").applyInArrow(with_tree, ANCHOR), "hardneg-anchors")


class Tile:
    """Candidates of one chunk, and the exact scores and intervals of a block's anchors in tree order."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        self.anchors = anchors = anchors.sort_by("place")
        self.candidates = c = candidates.sort_by([("id", "ascending"), ("row", "ascending")])
        dim = anchors.column("dim")[0].as_py()
        self.a, self.x = matrix(anchors.column("v"), dim), matrix(c.column("v"), dim)
        self.af, self.xf = self.a.astype(np.float64), self.x.astype(np.float64)
        self.safe = np.abs(self.af).max(initial=0) * np.abs(self.xf).max(initial=0) * max(1, dim) < EXACT
        self.length = np.sqrt((self.xf * self.xf).sum(1)) * (1 + 1e-9)
        self.size = np.sqrt((self.af * self.af).sum(1))
        self.row, self.id, self.label, self.copies = (c.column(n).to_numpy() for n in ("row", "id", "label", "copies"))
        self.rescored = 0

    def exact(self, i: int, at: np.ndarray) -> np.ndarray:
        self.rescored += len(at)
        if self.safe:
            return (self.xf[at] @ self.af[i]).astype(np.int64)
        return scores(self.a[i:i + 1], self.x[at], np.zeros((1, len(at)), bool))[0]

    def walk(self, wanted):
        """For each anchor, in tree order: its place, the candidates that were rescored, and their scores.

        ``wanted(i, low, high)`` tells which candidates are to be rescored by their scores' intervals.
        """
        places, parents, edges = (self.anchors.column(n).to_numpy() for n in ("place", "parent", "edge"))
        place = {int(p): i for i, p in enumerate(places)}
        low, high = np.zeros((len(places), len(self.id))), np.zeros((len(places), len(self.id)))
        for i in range(len(places)):
            p = place[int(parents[i])] if parents[i] >= 0 else -1
            reach = self.length * (edges[i] + 1e-12 * (self.size[i] + (self.size[p] if p >= 0 else 0.0))) + 1e-6
            low[i], high[i] = (low[p] - reach, high[p] + reach) if p >= 0 else (-reach, reach)
            at = np.flatnonzero(wanted(i, low[i], high[i]))
            s = self.exact(i, at)
            low[i, at] = high[i, at] = s
            yield i, at, s


def largest(x: np.ndarray, k: int) -> float:
    """The kth largest of ``x``, minus infinity with fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def leading(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by place."""
    at = np.flatnonzero(s >= largest(s, k))
    return at[np.argsort(-s[at], kind="stable")][:k]


def table_of(columns: dict[str, list]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for n, x in columns.items()})


def first_positives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"row": [], "id": [], "score": [], "copies": []}
        if anchors.num_rows and candidates.num_rows:
            tile = Tile(anchors, candidates)
            own, label = tile.anchors.column("row").to_numpy(), tile.anchors.column("label").to_numpy()

            def others(i):
                return tile.copies - (tile.row == own[i])

            def wanted(i, low, high):
                like = (tile.label == label[i]) & (others(i) > 0)
                return like & (high >= largest(low[like], k))

            for i, at, s in tile.walk(wanted):
                best = leading(s, k)
                for n, x in zip(out, (np.full(len(best), own[i]), tile.id[at[best]], s[best], np.minimum(others(i)[at[best]], k))):
                    out[n].append(x)
        return table_of(out)

    return run


def window_of(score: int) -> tuple[int, int]:
    """The scores s with LEAST · score ≤ 100 · s ≤ MOST · score."""
    return -(-LEAST * score // 100), MOST * score // 100


def first_negatives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"row": [], "nth": [], "id": [], "score": [], "copies": []}
        if anchors.num_rows and candidates.num_rows:
            tile = Tile(anchors, candidates)
            own, label = tile.anchors.column("row").to_numpy(), tile.anchors.column("label").to_numpy()
            windows = [[window_of(p) for p in ps] for ps in tile.anchors.column("positive_scores").to_pylist()]

            def wanted(i, low, high):
                other, need = tile.label != label[i], np.zeros(len(low), bool)
                for least, most in set(windows[i]):
                    overlap = other & (high >= least) & (low <= most)
                    inside = overlap & (low >= least) & (high <= most)
                    need |= overlap & (high >= largest(low[inside], k))
                return need

            for i, at, s in tile.walk(wanted):
                for nth, (least, most) in enumerate(windows[i]):
                    fits = np.flatnonzero((s >= least) & (s <= most))
                    best = fits[leading(s[fits], k)]
                    for n, x in zip(out, (np.full(len(best), own[i]), np.full(len(best), nth), tile.id[at[best]], s[best],
                                          np.minimum(tile.copies[at[best]], k))):
                        out[n].append(x)
        return table_of(out)

    return run


def tiles(anchors: DataFrame, rows: DataFrame, chunks: int, blocks: int):
    """Every block with every chunk of the same length of vectors."""
    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    a = anchors.withColumn("chunk", every(chunks))
    b = (rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks).cast("long")))
         .withColumn("block", every(blocks)))
    return a.groupBy("dim", "chunk", "block").cogroup(b.groupBy("dim", "chunk", "block"))


def first(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k first rows of each key by score and id, counting a row as often as it occurs."""
    order = W.partitionBy(*key).orderBy(F.desc("score"), "id")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("copy", "copies")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``rows``: frame from ``rows_of``. For each anchor and positive its first negatives:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    anchors = anchors_of(rows, is_anchor)
    blocks = int((anchors.agg(F.max("block")).first()[0] or 0) + 1)
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    like = first(tiles(anchors, rows, chunks, blocks).applyInArrow(
        first_positives(positives), "row long, id long, score long, copies long"), ["row"], positives)
    best = like.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most ``positives``
    known = written(anchors.join(best, "row").select(
        anchors["*"], F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "hardneg-positives")
    # a parent without positives is gone: its children start from the origin
    here = known.select("dim", "block", F.col("place").alias("parent"), F.lit(True).alias("__here"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) * (1 + 1e-9)
    rooted = (known.join(here, ["dim", "block", "parent"], "left")
              .withColumn("edge", F.when(F.col("__here"), F.col("edge")).otherwise(length))
              .withColumn("parent", F.when(F.col("__here"), F.col("parent")).otherwise(F.lit(-1).cast("long"))).drop("__here"))
    unlike = first(tiles(rooted, rows, chunks, blocks).applyInArrow(
        first_negatives(negatives), "row long, nth long, id long, score long, copies long"), ["row", "nth"], negatives)
    told = known.select("row", F.col("id").alias("anchor_id"), "positive_ids", "positive_scores", "copies")
    return (unlike.join(told, "row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("anchor_id", F.get("positive_ids", F.col("nth").cast("int")).alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                    F.get("positive_scores", F.col("nth").cast("int")).alias("positive_score"), F.col("score").alias("negative_score")))


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows_of(vectors, label), F.pmod("id", F.lit(100)) == 0)


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.id AS anchor_id, c.rid, c.id, a.label = c.label AS alike,
         list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM r a JOIN r c ON a.rid <> c.rid AND len(a.v) = len(c.v) WHERE a.id % 100 = 0),
p AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS nth FROM s WHERE alike),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
