"""Near-duplicate embeddings by randomised-rotation binary codes, with links confirmed by exact cosines.

1. Classes. Rows with equal label and vector are one class with a count; only classes go on.
2. Sketches. A unit vector, padded with zeros to a power of two of at least 64 components, is rotated at random (three rounds of random signs and a
   Hadamard transform). Kept are the signs of its D components (the code), the correction factor f (inner product of vector and code), the
   components in four bits, randomly rounded (the planes), and a pool of ``POOL`` signs from further rotations.
3. Buckets. ``bands`` subsets of the pool, of ``bits`` signs each, are keys; vectors of one label meet where they share a key. ``bits`` grows with the logarithm of
   the largest label so that unrelated vectors share a bucket with few others, and ``bands`` so that a pair at the limit shares none with
   a probability of ``MISS``. Buckets are dealt into blocks, and one task handles a pair of blocks, a *tile*.
4. Estimates. <code, planes> / f is an unbiased estimate of the cosine; with its confidence bound (``SIGMAS`` standard deviations, of code and rounding) it tells
   which pairs can reach the limit. A pair that already met in an earlier band is left to that one. Only codes take part; what
   is handed on is which rows of a tile hold such a pair.
5. Exact cosines. The vectors of these rows alone meet again in their tiles. A tile hands on the number of links of each row, and a spanning forest.
6. Components of the forests, and back from classes to rows.

Pairs found are exact: a link has a cosine of at least ``LIMIT`` in double precision. A pair right at the limit is lost with a probability of about ``MISS`` (buckets)
and 1e-6 (bound); the tests equal brute force and, of 200 vectors right at the limit, ask for 99 %.

Skew: equal copies collapse in a partial aggregate; a label, bucket or group of near copies of any size is tiled, and nothing lists its pairs.
Tables between the steps lie in the shared folder; the driver gets one number, the size of the largest label.

Defined results: a null vec_id takes part in nothing (no links, null component, not kept); null labels and vectors that are null, empty, zero or hold null or
non-finite components are linked with nothing and kept; vectors of unequal lengths are not linked; rows that repeat a vec_id are vectors of their own, and
each counts the others that it is linked with; an empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, written
from .components import connected_components

ship(__name__)

LIMIT = 0.93
MISS = 1e-6
SIGMAS = 5.0
POOL = 512  # signs that the bucket keys are chosen from
PLANES = 4  # bits of a rounded component
BUCKET_ROWS = 64  # unrelated vectors of the largest label in a bucket, about
BLOCK_ROWS = 1024
CELLS = 1 << 20  # of a table of pairs, at one time
SEED = 13


def padded(dim: int) -> int:
    return max(64, 1 << max(0, dim - 1).bit_length())


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """The rows of ``x`` (their number of components is a power of two) under a random rotation."""
    n, d = x.shape
    rng = np.random.default_rng([SEED, seed, d])
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
            h *= 2
        x = x.reshape(n, d) / math.sqrt(d)
    return x


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pool_bits(x: np.ndarray) -> np.ndarray:
    """POOL signs of padded unit vectors, of as many rotations as that takes."""
    turns = -(-POOL // x.shape[1])
    return np.concatenate([rotated(x, 1 + t) > 0 for t in range(turns)], 1)[:, :POOL]


class Sketches:
    """What is kept of vectors; as bytes, a row is the words of the pool, the code and the planes, and four numbers."""

    def __init__(self, words: np.ndarray):
        self.words = words
        w = (words.shape[1] - POOL // 64 - 4) // (1 + PLANES)
        self.d = 64 * w
        a, b = POOL // 64, POOL // 64 + w
        self.pool, self.code = words[:, :a], words[:, a:b]
        self.planes = words[:, b:b + PLANES * w].reshape(-1, PLANES, w)
        self.factor, self.low, self.step, self.total = np.ascontiguousarray(words[:, -4:]).view(np.float64).T
        self.ones = np.bitwise_count(self.code).sum(1).astype(np.float64)
        spread = np.sqrt(np.maximum(0.0, 1 - self.factor ** 2)) / self.factor / math.sqrt(self.d - 1)
        self.of_code, self.of_rounding = SIGMAS * spread, SIGMAS / 2 / self.factor

    @classmethod
    def of(cls, x: np.ndarray, pool: np.ndarray) -> Sketches:
        """From padded unit vectors and their pool of signs."""
        r = rotated(x, 0)
        d = r.shape[1]
        low = r.min(1, keepdims=True)
        step = np.maximum((r.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.floor((r - low) / step + np.random.default_rng([SEED, d]).random(d))
        level = np.clip(level, 0, (1 << PLANES) - 1).astype(np.uint8)
        planes = [packed(level >> b & 1) for b in range(PLANES)]
        numbers = np.stack([np.abs(r).sum(1) / math.sqrt(d), low[:, 0], step[:, 0], (low + step * level).sum(1)], 1)
        return cls(np.concatenate([packed(pool), packed(r > 0), *planes, np.ascontiguousarray(numbers).view(np.uint64)], 1))

    def estimates(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of all pairs of rows i (by code) and j (by planes), and their confidence bounds."""
        both = np.zeros((len(i), len(j)))
        for b in range(PLANES):
            both += (1 << b) * np.bitwise_count(self.code[i][:, None] & self.planes[j, b][None]).sum(2)
        inner = 2 * (self.low[j] * self.ones[i][:, None] + self.step[j] * both) - self.total[j]
        bound = self.of_code[i][:, None] + self.of_rounding[i][:, None] * self.step[j]
        return inner / math.sqrt(self.d) / self.factor[i][:, None], bound

    def reaching(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows i and j can reach the limit, by either one's code."""
        e, bound = self.estimates(i, j)
        back, other = self.estimates(j, i)
        return (e + bound >= LIMIT) & ((back + other).T >= LIMIT)


class Bands:
    """Subsets of the pool."""

    def __init__(self, largest: int):
        agree = 1 - math.acos(LIMIT) / math.pi  # chance that a sign is equal at the limit
        self.bits = max(4, math.ceil(math.log2(max(1, largest) / BUCKET_ROWS)))
        self.number = math.ceil(math.log(MISS) / math.log1p(-agree ** self.bits))
        rng = np.random.default_rng(SEED)
        self.chosen = np.stack([rng.choice(POOL, self.bits, replace=False) for _ in range(self.number)])
        mask = np.zeros((self.number, POOL), np.uint8)
        np.put_along_axis(mask, self.chosen, 1, 1)
        self.masks = packed(mask)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """One number for each row of signs and band."""
        return bits[:, self.chosen] @ (1 << np.arange(self.bits, dtype=np.int64))

    def met_before(self, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
        """Which pairs of rows of two pools share the key of an earlier band."""
        differ, out = a ^ b, np.zeros(len(a), bool)
        for mask in self.masks[:band]:
            out |= ~(differ & mask).any(1)
        return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sketched(classes: DataFrame, bands: Bands) -> DataFrame:
    """(row, label, dim, copies, sketch, keys) of every class."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                dims = b.column("dim").to_numpy()
                for dim in map(int, np.unique(dims)):
                    part = b.take(pa.array(np.flatnonzero(dims == dim)))
                    x = np.pad(units(matrix(part.column("v"))), ((0, 0), (0, padded(dim) - dim)))
                    bits = pool_bits(x)
                    words, keys = Sketches.of(x, bits).words, bands.keys(bits)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("row", "label", "dim", "copies")), pa.array([w.tobytes() for w in words], pa.binary()),
                         pa.array(list(keys), pa.list_(pa.int64()))], ["row", "label", "dim", "copies", "sketch", "keys"])

    return classes.select("row", "label", "dim", "copies", "v").mapInArrow(
        run, "row long, label string, dim int, copies long, sketch binary, keys array<long>")


BUCKET = ["label", "dim", "band", "key"]
TILE = [*BUCKET, "first", "last"]


def tiled(sketches: DataFrame) -> DataFrame:
    """Every row in every tile of its buckets: the pairs of its own block with each block of the bucket."""
    met = sketches.select("row", "label", "dim", "copies", "sketch", F.posexplode("keys").alias("band", "key"))
    large = written(met.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
                    .select(*BUCKET, F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), "embedding-large")
    dealt = (met.join(large, BUCKET, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
             .withColumn("b", F.pmod(F.xxhash64("row"), F.col("blocks"))))
    return dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *BUCKET, F.least("b", "o").alias("first"), F.greatest("b", "o").alias("last"), (F.col("b") > F.col("o")).alias("second"),
        "row", "copies", "sketch")


def runs(batches, keys: list[str]):
    """Tables of rows with equal keys, from batches that are sorted by them; single rows are passed over."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        columns = [t.column(k).combine_chunks() for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in columns:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(change), t.num_rows]
        for x, y in zip(edges[:-1], edges[1:]):
            if x or [c[0].as_py() for c in columns] != last:
                if sum(p.num_rows for p in held) > 1:
                    yield pa.concat_tables(held)
                held = []
            held.append(t.slice(x, y - x))
        last = [c[-1].as_py() for c in columns]
    if sum(p.num_rows for p in held) > 1:
        yield pa.concat_tables(held)


class Tile:
    """The rows of a tile, and its pairs that can reach the limit and did not meet before."""

    def __init__(self, table: pa.Table, bands: Bands):
        self.row, self.copies = (table.column(c).to_numpy() for c in ("row", "copies"))
        sketch = table.column("sketch").to_pylist()
        self.sketches = s = Sketches(np.frombuffer(b"".join(sketch), np.uint64).reshape(len(sketch), -1))
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        within = table.column("first")[0] == table.column("last")[0]
        left, right = (np.arange(len(second)),) * 2 if within else (np.flatnonzero(~second), np.flatnonzero(second))
        band = table.column("band")[0].as_py()
        found = [np.empty((2, 0), np.int64)]
        some = max(1, CELLS // max(1, len(right) * s.d // 64))
        for at in range(0, len(left), some):
            part = left[at:at + some]
            others = right[right > part[0]] if within else right
            if not len(others):
                continue
            i, j = np.nonzero(s.reaching(part, others))
            i, j = part[i], others[j]
            if within:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), CELLS // 8):
                x, y = i[k:k + CELLS // 8], j[k:k + CELLS // 8]
                new = ~bands.met_before(s.pool[x], s.pool[y], band)
                found.append(np.stack([x[new], y[new]]))
        self.i, self.j = np.concatenate(found, 1)


def rows_needed(tiles: DataFrame, bands: Bands) -> DataFrame:
    """(tile, row): the rows of each tile that hold a pair for exact recomputation."""
    def run(batches):
        for table in runs(batches, TILE):
            tile = Tile(table, bands)
            if len(tile.i):
                yield table.take(pa.array(np.unique(np.concatenate([tile.i, tile.j])))).combine_chunks().to_batches()[0]

    schema = tiles.schema
    return tiles.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(run, schema)


def cosines(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(1))
    some = max(1, CELLS // v.shape[1])
    dots = [np.einsum("ij,ij->i", v[i[k:k + some]], v[j[k:k + some]]) for k in range(0, len(i), some)]
    return np.concatenate(dots) / (size[i] * size[j]) if dots else np.empty(0)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links lead to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if np.array_equal(root, before):
            return root


def confirmed(needed: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """(u, v, n): u has n links in a tile (v null), or u and v are linked by a way within a tile."""
    def run(batches):
        for table in runs(batches, TILE):
            tile = Tile(table, bands)
            v = matrix(table.column("v"))
            v = v / np.abs(v).max(1, keepdims=True)
            is_link = cosines(v, tile.i, tile.j) >= LIMIT
            i, j = tile.i[is_link], tile.j[is_link]
            if not len(i):
                continue
            n = np.bincount(i, tile.copies[j], len(v)) + np.bincount(j, tile.copies[i], len(v))
            root = forest(len(v), i, j)
            some, tied = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([tile.row[some], tile.row[tied]])),
                 pa.array([*[None] * len(some), *tile.row[root[tied]].tolist()], pa.int64()),
                 pa.array(np.concatenate([n[some], np.zeros(len(tied))]).astype(np.int64))], ["u", "v", "n"])

    met = needed.join(classes.select("row", "v"), "row")
    return met.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id_col, n_links, component_id and kept (its component's smallest id is its own)."""
    v = F.col(vector_col).cast("array<double>")
    usable = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
              & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0.0))
    usable = F.coalesce(usable, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, F.col(label_col).cast("string")).alias("label"),
                          F.when(usable, v).alias("v"))
    known = rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = written(known.select(F.monotonically_increasing_id().alias("row"), "label", "v", F.size("v").alias("dim"), "low", "copies"),
                      "embedding-classes")
    largest = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bands = Bands(largest)
    needed = written(rows_needed(tiled(written(sketched(classes, bands), "embedding-sketches")), bands), "embedding-needed")
    found = written(confirmed(needed, classes, bands), "embedding-links")
    n = found.where(F.col("v").isNull()).groupBy(F.col("u").alias("row")).agg(F.sum("n").alias("n"))
    component = connected_components(found.where(F.col("v").isNotNull()).select("u", "v"))
    of_class = (classes.select("row", "label", "v", "low", "copies").join(n, "row", "left")
                .join(component.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row")))
    of_class = written(of_class.drop("row"), "embedding-judged")
    lowest = of_class.groupBy("component").agg(F.min("low").alias("lowest"))
    judged = of_class.join(lowest, "component").select("label", "v", "lowest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.join(judged, ["label", "v"], "left")
    component_id = F.coalesce("lowest", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
                      F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
