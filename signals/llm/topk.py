"""Exact top-k search by inner product: distributed histogram selection.

Components x become floor(64 · x). Every query is scored against every row, tile by tile: candidates are dealt into
chunks and queries into blocks, and one task scores one block against one chunk by a matrix product. Scores are not kept.
Each round, a tile counts its scores in ``BINS`` equal bins of the interval that holds the query's kth value, and hands on its
highest bins until they hold k scores, which is all that the kth value can depend on; the counts are added up per query and bin, and
the bin in which they reach k becomes the next interval. With a width of 1 the kth value is known exactly. A last round
hands on the scores above it, all of them, and of those equal to it the k smallest vec_ids of each tile; the ranks break ties by vec_id.

Scale: the work is queries × rows, as the task states, spread over tiles of at most ``CHUNK_ROWS`` × ``BLOCK_ROWS`` whose two
sides meet by a shuffle; nothing is broadcast or sent to the driver but one flag per round. Rounds: the logarithm of the range of scores to
base ``BINS`` (two or three). One vector that very many rows share fills one bin, not one task: a tile hands on at most k
of equal scores. The prepared vectors and the intervals are tables in the shared folder.

Defined results: a null vec_id, a null vector, or one that holds a null or non-finite component takes no part; rows that
repeat a vec_id count once, with the smallest vector, in ``op8_topk_search``, and are rows of their own in ``op8_topk_rows``; a query is scored against vectors of its own length only; a query with fewer than k candidates gets all; scores
are exact, and one beyond ±(2^62 - 1), or a component with 64 · |x| ≥ 2^63, is an error; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, written

ship(__name__)

K = 20
BINS = 256
CHUNK_ROWS, BLOCK_ROWS = 2048, 1024
EXACT = 1 << 53  # whole numbers that doubles hold
LARGEST = (1 << 62) - 1  # score: twice it and one, the width of the first interval, is a 64-bit integer
AT_ONCE = 4096


def whole_vectors(vector_col: str, factor: int) -> tuple[Column, Column]:
    """Whether a row's vector can take part, and its components times ``factor`` as whole numbers."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c):
        error = F.raise_error(F.lit("a vector's component does not fit a 64-bit integer")).cast("long")
        return F.when(F.abs(c * factor) < float(1 << 63), F.floor(c * factor)).otherwise(error)

    return F.coalesce(finite, F.lit(False)), F.transform(x, whole)


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(id, v, dim): whole-number vectors of the rows that take part; an id's smallest one."""
    return each_row(vectors, id_col, vector_col, factor).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def each_row(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(id, v, dim) of all rows that take part, those that repeat an id included."""
    usable, whole = whole_vectors(vector_col, factor)
    return (vectors.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
            .withColumn("dim", F.size("v")))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point while its whole numbers are exact, else by 64-bit integers, and by unbounded ones
    where these could wrap. Those of a query with itself (``own``) are not used and may be anything."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    s = q @ c.T
    size = np.abs(q).astype(np.float64) @ np.abs(c).astype(np.float64).T  # no sum of the products' parts is larger
    row, col = np.nonzero((size >= LARGEST * (1 - 1e-6)) & ~own)
    for at in range(0, len(row), AT_ONCE):
        r, k = row[at:at + AT_ONCE], col[at:at + AT_ONCE]
        exact = (q[r].astype(object) * c[k].astype(object)).sum(1)
        if max(abs(e) for e in exact) > LARGEST:
            raise OverflowError(f"a score is beyond {LARGEST}")
        s[r, k] = exact.astype(np.int64)
    return s


def highest_bins(s: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray, wanted: np.ndarray):
    """(query row, bin, count) of the highest bins of each query's interval [low, low + width) until they hold the
    wanted number of scores."""
    over = s - low[:, None]
    inside = (over >= 0) & (over < width[:, None]) & ~own
    bins = over // -(-width // BINS)[:, None]
    flat = (bins + np.arange(len(s))[:, None] * BINS)[inside]
    count = np.bincount(flat, minlength=len(s) * BINS).reshape(len(s), BINS)
    above = np.cumsum(count[:, ::-1], 1)[:, ::-1] - count
    row, b = np.nonzero((count > 0) & (above < wanted[:, None]))
    return row, b, count[row, b]


def last_candidates(s: np.ndarray, own: np.ndarray, kth: np.ndarray, ids: np.ndarray, k: int):
    """(query row, candidate) with a score above the kth value, and of those equal to it the k smallest ids; ``ids`` ascend."""
    equal = (s == kth[:, None]) & ~own
    equal &= np.cumsum(equal, 1) <= k
    return np.nonzero(((s > kth[:, None]) & ~own) | equal)


def tiles(queries: DataFrame, rows: DataFrame, chunks: int, blocks: int):
    """The two sides of all tiles, grouped by (dim, chunk, block)."""
    def deal(n, salt):
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n).cast("long")).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = queries.withColumn("block", deal(blocks, "block")).select("*", every(chunks).alias("chunk"))
    b = rows.withColumn("chunk", deal(chunks, "chunk")).select("row", "id", "v", "dim", "chunk", every(blocks).alias("block"))
    key = ["dim", "chunk", "block"]
    return a.groupBy(*key).cogroup(b.groupBy(*key))


def pair(q: pa.Table, c: pa.Table):
    """The queries' rows, the candidates' ids in their order, the scores of a tile, and which score is a query's own."""
    c = c.sort_by([("id", "ascending"), ("row", "ascending")])
    dim = q.column("dim")[0].as_py()
    qr, ci = q.column("row").to_numpy(), c.column("id").to_numpy()
    own = qr[:, None] == c.column("row").to_numpy()[None, :]
    return qr, ci, scores(matrix(q.column("v"), dim), matrix(c.column("v"), dim), own), own


def count_bins(q: pa.Table, c: pa.Table) -> pa.Table:
    row, b, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    qr = np.empty(0, np.int64)
    if q.num_rows and c.num_rows:
        qr, _, s, own = pair(q, c)
        row, b, n = highest_bins(s, own, *(q.column(x).to_numpy() for x in ("low", "width", "wanted")))
    return pa.table({"row": pa.array(qr[row] if len(row) else qr[:0], pa.int64()), "bin": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def gather(k: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 4
        if q.num_rows and c.num_rows:
            qr, ci, s, own = pair(q, c)
            row, col = last_candidates(s, own, q.column("low").to_numpy(), ci, k)
            out = [qr[row], q.column("id").to_numpy()[row], ci[col], s[row, col]]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("row", "query_id", "vec_id", "score"), out)})
    return run


def top_k(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``rows``: frame from ``quantized`` or ``each_row``. Each query's k highest scores: query_id, rank, vec_id, score."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")  # numbered once, in the table
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("square")).first()
    chunks, blocks = max(1, -(-total["n"] // CHUNK_ROWS)), max(1, -(-total["q"] // BLOCK_ROWS))
    # by Cauchy-Schwarz all scores lie within the largest squared length
    bound = min(int((total["square"] or 0) * (1 + 1e-9)) + 1, LARGEST)
    width = 2 * bound + 1
    state = rows.where(is_query).withColumns({"low": F.lit(-bound).cast("long"), "wanted": F.lit(k).cast("long")})
    while width > 1:
        step = -(-width // BINS)
        counted = (tiles(state.withColumn("width", F.lit(width).cast("long")), rows, chunks, blocks)
                   .applyInArrow(count_bins, "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n")))
        down = W.partitionBy("row").orderBy(F.desc("bin"))
        with_sum = counted.withColumn("reached", F.sum("n").over(down)).join(state.select("row", F.col("wanted").alias("w")), "row")
        hit = (with_sum.where(F.col("reached") >= F.col("w")).groupBy("row")
               .agg(F.max(F.struct("bin", "reached", "n")).alias("hit")))
        # with fewer candidates than wanted there is no kth value: the interval stays at its lower end
        state = written(state.join(hit, "row", "left").select(
            "row", "id", "v", "dim",
            F.when(F.col("hit").isNotNull(), F.col("low") + F.col("hit.bin") * step).otherwise(F.col("low")).alias("low"),
            F.when(F.col("hit").isNotNull(), F.col("wanted") - (F.col("hit.reached") - F.col("hit.n")))
            .otherwise(F.col("wanted")).alias("wanted")), "topk-state")
        width = step
    found = tiles(state, rows, chunks, blocks).applyInArrow(gather(k), "row long, query_id long, vec_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return top_k(quantized(vectors), F.pmod(F.col("id"), F.lit(20)) == 0)


def query_rows(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Every row is a candidate, and a query if its id says so, also where rows repeat an id."""
    return top_k(each_row(vectors), F.pmod(F.col("id"), F.lit(20)) == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
SQL_ROWS = (SQL.replace("SELECT vec_id, list_transform", "SELECT row_number() OVER () AS rid, vec_id, list_transform")
            .replace("SELECT q.vec_id AS query_id,", "SELECT q.rid, q.vec_id AS query_id,")
            .replace("q.vec_id <> c.vec_id", "q.rid <> c.rid").replace("PARTITION BY query_id", "PARTITION BY rid"))
